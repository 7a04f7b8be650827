"""What operators leave on disk on their way."""

from loomgraph.llm import frames
from loomgraph.llm.substring import substring_dedup


def test_only_one_process_is_spared_the_collector():
    assert [frames.one_process(m) for m in ("local", "local[4]", "local[*]", "local-cluster[3,2,1024]", "spark://a:7077", "yarn")] == [True] * 3 + [False] * 3


def test_substring_dedup_keeps_only_what_is_read_again(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, text), (2, "a b " + text), (3, "x " + " ".join(text.split()[:50])), (4, "other words")], "doc_id long, text string")
    since = frames.written()
    got = {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}
    assert got == {1: 90, 2: 90, 3: 50, 4: 0}
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in frames._written[since:]}
    assert left == {"shared", "heads", "occurrences", "spans", "checked", "doubtful"}

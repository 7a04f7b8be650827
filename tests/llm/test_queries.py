"""The registered opN queries against their SQL, and the pipeline stage by stage."""

import pytest

from loomgraph.llm.queries import QUERIES
from loomgraph.llm.sql import ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, same, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_registered():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES} and "pipeline" in e.queries()


def test_pipeline(spark, data):
    import corpus_pipeline as p
    from loomgraph.llm.frames import cut
    from loomgraph.llm.secrets import find_secrets
    from loomgraph.llm.simhash import _shingles, near_copies
    from loomgraph.llm.toxicity import toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rejected = {r.doc_id for r in toxicity(docs, labels, with_passages=False).filter("predicted = 1").collect()}
    kept = cut(p.drop_toxic(spark, docs, data))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    one = cut(p.drop_near_duplicates(spark, kept, data))
    leads = {r.doc_id: r.leader for r in near_copies(kept).collect()}
    texts = {r.doc_id: _shingles(r.text or "", 5) for r in kept.collect()}
    assert {r.doc_id for r in one.collect()} == set(leads.values()) and one.count() == one.select("doc_id").distinct().count()
    like = lambda a, b: len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
    assert all(like(i, k) and k <= i for i, k in leads.items())
    ids = sorted(texts)
    pairs = [(a, b) for a in ids for b in ids if a < b and like(a, b)]
    assert sum(leads[b] != b for _, b in pairs) >= 0.9 * len(pairs)
    before = {r.doc_id: r for r in one.collect()}
    clean = cut(p.redact_secrets(spark, one, data))
    assert clean.columns == docs.columns and clean.count() == one.count()
    for r in clean.collect():
        old = before[r.doc_id]
        assert not find_secrets(r.text) and (r.text == old.text) == (not find_secrets(old.text))
    mixed = cut(p.mix(spark, clean, data))
    assert mixed.columns == docs.columns and mixed.count() > 0
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.text in texts[r.doc_id] for r in mixed.collect())
    coded = p.tokens(spark, mixed, data).collect()
    assert len(coded) == mixed.count() and all(r.round_trip for r in coded)


def test_stages_on_messy_rows(spark, messy, none, data):
    import corpus_pipeline as p
    from loomgraph.llm.frames import cut

    for docs in (messy, none):
        for _, stage in p.STAGES:
            docs = cut(stage(spark, docs, data))
        assert docs.columns[0] == "doc_id"

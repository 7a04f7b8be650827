"""How much work steps do: tables written, rounds, files."""

import random
from pathlib import Path

from loomgraph import reasoning
from loomgraph.operators import infer, linking, paths
from loomgraph.sources import rdf
from loomgraph.streaming import state


def counted(monkeypatch, module):
    rows, real = [], module.written

    def written(df, name="table"):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "written", written)
    return rows


def brute(edges):
    known = set(edges)
    while True:
        new = {(a, d) for a, b in known for c, d in edges if b == c} - known
        if not new:
            return known
        known |= new


def test_closure_makes_each_pair_of_a_path_once(spark, monkeypatch):
    rows = counted(monkeypatch, infer)
    chain = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(40)], "s string, o string")
    assert infer.closure(chain).count() == 40 * 41 // 2 == sum(rows)


def test_closure_of_any_graph(spark):
    rng = random.Random(7)
    for n, m in ((6, 5), (9, 12), (5, 14)):
        edges = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)}
        assert sorted(map(tuple, infer.closure(spark.createDataFrame(sorted(edges), "s string, o string")).collect())) == sorted(brute(edges))
    ring = {(str(i), str((i + 1) % 5)) for i in range(5)} | {("x", "0")}  # one pair out of each node, and a cycle
    assert sorted(map(tuple, infer.closure(spark.createDataFrame(sorted(ring), "s string, o string")).collect())) == sorted(brute(ring))


def test_many_seeds_take_few_rounds(spark, monkeypatch):
    rounds = counted(monkeypatch, paths), counted(monkeypatch, infer)
    chain = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(20)], "s string, o string")
    seeds = spark.createDataFrame([(f"{i:02d}",) for i in range(0, 21) if i != 3], "x string")
    got = paths.reach(chain, seeds)
    assert sorted(map(tuple, got.collect())) == [(f"{i:02d}", f"{j:02d}") for i in range(20) for j in range(i + 1, 21) if i != 3]
    assert sum(map(len, rounds)) <= 9  # 21 when each step was a round


def test_growing_closure_takes_few_rounds(spark, tmp_path, monkeypatch):
    rounds = counted(monkeypatch, state)
    edges = [("a", "b"), ("b", "c"), ("d", "a"), ("c", "e"), ("e", "f"), ("f", "a"), ("g", "d"), ("f", "h"), ("x", "y"), ("y", "g")]
    growing = state.GrowingClosure(spark, str(tmp_path / "closure"))
    for batch, k in enumerate((0, 4, 8)):
        growing.extend(spark.createDataFrame(edges[k : k + 4], "s string, o string"), batch)
    assert sorted(map(tuple, growing.pairs().collect())) == sorted(brute(set(edges)))
    assert len(rounds) == 3  # one a batch; its rounds are the closure's


def test_batches_are_written_by_many_tasks(spark):
    files = []

    def start(stream, path):
        files.append(len(list(Path(path, "in").glob("part-*"))))
        return stream.writeStream.foreachBatch(lambda df, batch: None)

    reasoning._replayed(spark, spark.range(0, 900, 1, 4).withColumnRenamed("id", "seq").repartition(4), "seq", 3, start)
    assert files == [4, 8, 12]  # one file a batch before


def test_positive_pairs_are_the_scored_candidates(spark, monkeypatch):
    """Scored in stretches of the order, also across their ends, and never joined as pairs with the profiles."""
    monkeypatch.setattr(linking, "STRETCH", 16)
    rng = random.Random(3)
    names = ["ann smith", "anne smith", "bob stone", "rob stone", "smith", "stone mason", "carl 12", "carl 13", ""]
    rows = [(i, sorted({(w, 1.0 + len(w)) for w in rng.choice(names).split()}), [(f"n{rng.randrange(4)}", 2.0)]) for i in range(120)]
    known = spark.createDataFrame(rows, "pid long, words array<struct<item:string,w:double>>, around array<struct<item:string,w:double>>")
    want = linking.scored(linking.candidates(known, 5), known).filter("score >= 0.5").select("a", "b")
    got = linking.positive(known, 5, 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_of_ntriples_is_matched_once(spark):
    lines = ['<a> <p> "x﷒y\\\\ \\"z\\"\ny"@en . # a remark\n', "_:b <p> <c\\u0041> .", "# nothing", "", None, "<a> <p> <b> <c> ."]
    found = rdf.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"), malformed="drop")
    assert list(map(tuple, found.collect())) == [("a", "p", 'x﷒y\\ "z"\ny', True, "en", None), ("_:b", "p", "cA", False, None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rdf.LINE[:20]) == 1  # four times before, and as often as each term was used


def test_turtle_blocks_are_made_from_the_columns(spark):
    t = spark.createDataFrame([("a", "p", 'x "y" .'), ("a", "q", None), (None, "q", "z"), ("a b", "p", "_:n")], "s string, p string, o string")
    blocks = rdf.turtle(t)
    assert sorted(map(tuple, blocks.collect())) == [("<a>", "<a> <p> <x\\u0020\\u0022y\\u0022\\u0020.> ."), ("<a\\u0020b>", "<a\\u0020b> <p> _:n .")]
    assert "regexp_extract" not in blocks._jdf.queryExecution().optimizedPlan().toString()

"""Entity linking, the vector store, embeddings in blocks, streams with state: against brute force and plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import linking, skipgram, vector_store
from loomgraph.streaming import state


# Entity linking.


def typo(r, word):
    k = r.randrange(len(word) - 1)
    return r.choice([word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + word[k + 1 :], word[: k + 1] + word[k:], word.upper()])


def planted(n=60, copies=8, seed=4):
    """Mentions of people with two names and a town, some of them misspelled, and their true entity."""
    r = random.Random(seed)
    syllables = ["ka", "lo", "mir", "ten", "sa", "vu", "pel", "dor", "ni", "gra"]
    name = lambda: "".join(r.choice(syllables) for _ in range(3))
    rows, truth = [], {}
    for entity in range(n):
        first, last, town = name(), name(), f"town{r.randrange(12)}"
        for _ in range(copies):
            spelled = r.choice([f"{first} {last}", f"{last}, {first}", f"{typo(r, first)} {last}", f"{first} {typo(r, last)}", f"Dr. {first} {last}"])
            i = len(rows)
            rows.append((i, spelled, [f"town:{town}", None], "x"))
            truth[i] = entity
    return rows, truth


def test_links(spark):
    rows, truth = planted()
    rows += [(None, "nobody", ["town:town1"], "x"), (9001, None, None, "x"), (9002, "", [], "x"), rows[3]]
    m = spark.createDataFrame(rows, "id long, name string, around array<string>, pid string").repartition(4)
    got = linking.link_entities(m)
    found = {r.id: r.cluster for r in got.collect()}
    assert set(found) == set(truth) | {9001, 9002}
    quality = linking.pair_quality(got, spark.createDataFrame(list(truth.items()), "id long, entity long")).first()
    assert quality.mentions == len(truth) and quality.recall > 0.9 and quality.precision > 0.9
    assert all(min(i for i in found if found[i] == c) == c for c in set(found.values()))
    assert sorted(map(tuple, linking.link_entities(m.repartition(2)).collect())) == sorted(map(tuple, got.collect()))
    assert linking.link_entities(m.limit(0)).count() == 0


def test_quality_counts_pairs(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)], "id long, cluster long")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "id long, entity string")
    q = linking.pair_quality(clusters, truth).first()
    assert (q.mentions, q.precision, q.recall) == (5, 2 / 4, 2 / 4)


def test_collective_rounds(spark):
    """Equal names with no surroundings of their own are told apart by the clusters of what they are linked to."""
    rows = [(k, f"person{k}{'abcdef'[k]}", ["org:x" if k < 3 else "org:y"]) for k in range(6)] + [(10 + k, "the boss", [f"page:{k}"]) for k in range(4)]
    m = spark.createDataFrame(rows, "id long, name string, around array<string>")
    links = spark.createDataFrame([(10, 0), (11, 0), (12, 5), (13, 5)], "id long, other long")
    once = {r.id: r.cluster for r in linking.link_entities(m, same=0.8).collect()}
    twice = {r.id: r.cluster for r in linking.link_entities(m, links, rounds=2, same=0.75).collect()}
    assert len({once[i] for i in (10, 11, 12, 13)}) == 4
    assert twice[10] == twice[11] != twice[12] == twice[13]


def test_neighbourhoods_are_bounded(spark):
    """A thousand profiles with one rare word, all alike, meet their next few only, wherever they lie."""
    known = spark.range(1000).select(F.col("id").alias("pid"), F.array(F.struct(F.lit("same").alias("item"), F.lit(1.0).alias("w"))).alias("words"), F.array().cast("array<struct<item:string,w:double>>").alias("around")).repartition(7)
    pairs = linking.candidates(known, window=5)
    assert 1000 * 5 - 15 <= pairs.count() <= 4 * 5 * 1000 and pairs.filter("a >= b").count() == 0


def test_pivots(spark):
    edges = [(1, 2), (2, 1), (2, 3), (4, 5), (5, 6), (4, 6), (7, 7)]
    got = {r.node: r.cluster for r in linking.pivot_clusters(spark.range(1, 9).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(range(1, 9)) and got[4] == got[5] == got[6] and got[7] == 7 and got[8] == 8
    pairs = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    assert all(c == n or (n, c) in pairs for n, c in got.items())


# Vector store.


def vectors(spark, n=600, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 3
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [None] * dim), (n + 3, [float("nan")] * dim), (None, [1.0] * dim)], "uri long, vec array<double>")


def test_more_queries_than_a_pass_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_store, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, x[i % 20].tolist()) for i in range(40)], "uri long, vec array<double>")  # each vector twice
    path = str(tmp_path / "store")
    vector_store.build(df, path, lists=4, pieces=2)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in vector_store.search(spark, path, df, 5, probes=4, refine=8).collect():
        found.setdefault(r.query, []).append((r["rank"], r.uri))
    for i in range(40):
        near = sorted((-round(float(u[i % 20] @ u[j % 20]), 9), j) for j in range(40) if j != i)[:5]
        assert sorted(found[i]) == [(k, j) for k, (_, j) in enumerate(near, 1)]


def test_vector_store(spark, tmp_path):
    x, df = vectors(spark)
    path = str(tmp_path / "store")
    model = vector_store.build(df, path, lists=16, pieces=4)
    assert spark.read.parquet(f"{path}/rows").count() == 600 and len(model.centres) == 16
    assert np.allclose(vector_store.load(spark, path).centres, model.centres)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = df.filter("uri % 50 = 0")
    exact = {i: [j for j in np.argsort(-(u @ u[i]), kind="stable") if j != i][:10] for i in range(0, 600, 50)}
    whole = vector_store.search(spark, path, q, 10, probes=16, refine=60)
    got = {}
    for r in whole.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.uri)
    assert got == exact
    near = vector_store.search(spark, path, q, 10, probes=6, refine=8)
    asked = spark.createDataFrame([(i, int(j)) for i, js in exact.items() for j in js], "query long, uri long")
    assert vector_store.recall(near, asked).first().recall >= 0.9
    lists = vector_store.probed(spark, path, q.limit(1), 2).select("list").distinct().count()
    plan = vector_store.probed(spark, path, q.limit(1), 2)._jdf.queryExecution().toString()
    assert lists <= 2 and "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert vector_store.search(spark, path, df.filter("uri >= 600"), 3).count() == 0
    with pytest.raises(ValueError, match="vector"):
        vector_store.build(df.filter("uri >= 600"), str(tmp_path / "none"))


def test_codes_lose_no_answer(spark, tmp_path):
    """Codes of one byte for vectors alike in all directions: what is near by them is not near, at any number of rows."""
    x = np.random.default_rng(5).normal(size=(1500, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uri long, vec array<double>")
    path = str(tmp_path / "store")
    vector_store.build(df, path, lists=5, pieces=1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in vector_store.search(spark, path, df.filter("uri % 100 = 0"), 5, probes=5, refine=1).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.uri)
    assert found == {i: [j for j in np.argsort(-(u @ u[i]), kind="stable") if j != i][:5] for i in range(0, 1500, 100)}


def test_codes_are_near(spark):
    """Distances by codes are those to the vectors that the codes stand for."""
    x, df = vectors(spark, 300, 8)
    model = vector_store.fit(df.filter("uri < 300"), 6, 4)
    at, codes = model.encode(x)
    back = model.centres[at] + np.concatenate([b[codes[:, k]] for k, b in enumerate(model.books)], axis=1)
    for which in range(6):
        rows = np.flatnonzero(at == which)
        assert np.allclose(model.gaps(x[0], which, codes[rows]), ((back[rows] - x[0]) ** 2).sum(1))
    assert ((back - x) ** 2).sum() < 0.2 * ((x - x.mean(0)) ** 2).sum()


# Embeddings in blocks.


def communities(seed=2, groups=4, size=15):
    r = random.Random(seed)
    nodes = [f"n{g}_{k}" for g in range(groups) for k in range(size)]
    rows = []
    for a in nodes:
        for _ in range(40):
            near = r.random() < 0.9
            b = r.choice([n for n in nodes if n != a and (n.split("_")[0] == a.split("_")[0]) == near])
            rows.append((a, b, 1.0))
    return nodes, rows


def test_skipgram_finds_communities(spark):
    nodes, rows = communities()
    pairs = spark.createDataFrame(rows, "node string, other string, n double").groupBy("node", "other").agg(F.sum("n").alias("n"))
    for block_nodes in (1000, 20):
        v = {r.uri: np.array(r.vec) for r in skipgram.skipgram(pairs, dim=16, epochs=12, block_nodes=block_nodes).collect()}
        assert set(v) == set(nodes)
        unit = {n: x / np.linalg.norm(x) for n, x in v.items()}
        right = 0
        for n in nodes:
            best = sorted((m for m in nodes if m != n), key=lambda m: -float(unit[n] @ unit[m]))[:5]  # noqa: B023
            right += sum(m.split("_")[0] == n.split("_")[0] for m in best)
        assert right >= 0.8 * 5 * len(nodes), (block_nodes, right)


def test_skipgram_equals_a_plain_run(spark):
    """One block of the distributed run against the same steps over arrays, and any partitioning alike."""
    _, rows = communities(3, 2, 6)
    pairs = spark.createDataFrame(rows, "node string, other string, n double").groupBy("node", "other").agg(F.sum("n").alias("n"))
    a = {r.uri: list(r.vec) for r in skipgram.skipgram(pairs, dim=8, epochs=2).collect()}
    b = {r.uri: list(r.vec) for r in skipgram.skipgram(pairs.repartition(5), dim=8, epochs=2).collect()}
    assert a == b
    start = {r.uri: np.array(r.vec, dtype=np.float64) for r in skipgram.skipgram(pairs, dim=8, epochs=0).collect()}
    names = sorted(start)
    place = {n: k for k, n in enumerate(names)}
    first, second = np.stack([start[n] for n in names]), np.zeros((len(names), 8))
    sums = [np.zeros(len(names)), np.zeros(len(names))]
    got = sorted((r.node, r.other, r.n) for r in pairs.collect())
    weight = np.zeros(len(names))
    for _, o, n in got:
        weight[place[o]] += n
    for epoch in range(2):
        skipgram.train_block(first, sums[0], second, sums[1], np.array([place[x] for x, _, _ in got]), np.array([place[y] for _, y, _ in got]), np.array([n for *_, n in got]), weight**0.75, 0.1, 42 + 1_000_003 * epoch)
        first, second = first.astype(np.float32).astype(np.float64), second.astype(np.float32).astype(np.float64)
    assert all(np.allclose(a[n], first[place[n]], atol=1e-5) for n in names)


def test_skipgram_moves_few_rows(spark, monkeypatch):
    """A turn moves a row for each block and the pairs of two, and pairs are made once."""
    tables, real = [], skipgram.written
    monkeypatch.setattr(skipgram, "written", lambda df, name="table": tables.append((name, real(df, name))) or tables[-1][1])
    made = spark.sparkContext.accumulator(0)
    pairs = spark.range(400).selectExpr("concat('n', id % 40) AS node", "concat('n', (id * 7 + 3) % 40) AS other", "1.0D AS n").distinct()
    n = pairs.count()
    pairs = spark.createDataFrame(pairs.rdd.map(lambda r: made.add(1) or r), pairs.schema)
    assert skipgram.skipgram(pairs, dim=4, epochs=2, block_nodes=10).count() == 40
    assert made.value == n
    assert {t.count() for name, t in tables if name == "vectors"} == {8}


def test_alias_table():
    w = np.array([0.5, 3.0, 0.0, 1.5, 5.0])
    share, alias = skipgram.alias_table(w.copy())
    p = share.copy()
    for i, a in enumerate(alias):
        p[a] += 1 - share[i]
    assert np.allclose(p / len(w), w / w.sum())


def test_near_pairs(spark):
    walks = spark.createDataFrame([(["a", "b", "a", "c"],), (None,), (["z"],), (["a", None, "b"],)], "path array<string>")
    got = {(r.node, r.other): r.n for r in skipgram.near_pairs(walks, 2).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("a", "a"): 2, ("b", "c"): 1, ("c", "b"): 1, ("a", "c"): 1, ("c", "a"): 1}


# Streams with state.


def stream_of(session, df, order, parts, path):
    low, high = df.agg(F.min(order), F.max(order)).first()
    cuts = [low + (high - low + 1) * k // parts for k in range(parts + 1)]
    for a, b in zip(cuts, cuts[1:]):
        df.filter(F.col(order).between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return session.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_entities_of_a_stream(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.choice(["a", "a", "b", "c", None]), k, 1_700_000_000 + 600 * k - r.choice([0, 0, 0, 9000])) for k in range(60)]
    df = spark.createDataFrame(rows, "uri string, seq long, t long").select("uri", "seq", F.timestamp_seconds("t").alias("ts"))
    want = {}
    for slots in (1, 3):
        for uri in "abc":
            mine = [(t, k) for u, k, t in rows if u == uri]
            late = 0
            for s in range(slots):
                top = None
                for t, k in [x for x in mine if x[1] % slots == s]:
                    late += top is not None and t < top - 3600
                    top = t if top is None else max(top, t)
            want[uri] = (len(mine), late, min(mine)[1], max(mine)[1])
        for parts in (1, 4):
            session = spark.newSession()
            session.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)
            path = str(tmp_path / f"{slots}-{parts}")
            updates = state.entity_updates(stream_of(session, df, "seq", parts, path), slots)
            updates.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
            got = {r.uri: (r.n, r.late, r.first_seq, r.last_seq) for r in state.entity_table(spark.read.schema(updates.schema).parquet(f"{path}/out")).collect()}
            assert got == want


def test_growing_closure(spark, tmp_path):
    r = random.Random(5)
    edges = [(r.choice("abcdefg"), r.choice("abcdefg")) for _ in range(12)]
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in want if b == c} - want
        if not more:
            break
        want |= more
    frame = lambda rows: spark.createDataFrame(rows, "s string, o string")
    for size in (1, 5, 12):
        g = state.GrowingClosure(spark, str(tmp_path / str(size)))
        assert g.pairs().count() == 0
        for k in range(0, 12, size):
            g.extend(frame(edges[k : k + size] + [(None, "a")]), k)
        g.extend(frame(edges[k : k + size]), k)  # the last batch run again
        g.extend(frame(edges[:2]), 99)
        got = [tuple(x) for x in g.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == want


# Translation embeddings.


@pytest.mark.parametrize("method", ["transe", "distmult"])
def test_translation_equals_a_plain_run(spark, method):
    """Two epochs against plain numpy, from the same start and the same corrupted tails."""
    from loomgraph.config import EmbeddingConfig
    from loomgraph.operators.translate import _start, corrupted, train_translation

    r = random.Random(7)
    rows = sorted({(f"n{r.randrange(8)}", f"p{r.randrange(2)}", f"n{r.randrange(8)}") for _ in range(16)})
    facts = spark.createDataFrame(rows, "s string, p string, o string")
    cfg = EmbeddingConfig(embedding_dim=6, epochs=2)
    names = spark.createDataFrame([(n,) for n in sorted({x for s, _, o in rows for x in (s, o)})], "uri string")
    vec = {x.uri: np.array(x.v) for x in _start(names, "uri", 6, cfg.seed).collect()}
    rel = {x.p: np.array(x.v) for x in _start(facts.select("p").distinct(), "p", 6, cfg.seed + 1).collect()}
    for epoch in range(2):
        bad = {(x.s, x.p, x.o): x.bad for x in corrupted(facts, epoch, cfg.seed).collect()}
        assert set(bad) == set(rows) and all(any(b == o2 and p2 == p for _, p2, o2 in rows) or b == s for (s, p, _), b in bad.items())
        grads: dict = {}
        for (s, p, o), b in bad.items():
            if method == "transe":
                gap, lie = vec[s] + rel[p] - vec[o], vec[s] + rel[p] - vec[b]
                g = gap - 0.5 * lie
                steps = [("e", s, g), ("e", o, -gap), ("e", b, 0.5 * lie), ("r", p, g)]
            else:
                d = vec[b] - vec[o]
                steps = [("e", s, rel[p] * d), ("e", o, -vec[s] * rel[p]), ("e", b, vec[s] * rel[p]), ("r", p, vec[s] * d)]
            for kind, name, g in steps:
                grads.setdefault((kind, name), []).append(g)
        for kind, table in (("e", vec), ("r", rel)):
            for name in table:
                if (kind, name) in grads:
                    x = table[name] - 0.05 * np.mean(grads[kind, name], axis=0)
                    table[name] = x / max(1.0, np.linalg.norm(x))
    got = {x.uri: np.array(x.vec) for x in train_translation(facts.union(spark.createDataFrame([(None, "p0", "n1")], facts.schema)), cfg, method).collect()}
    assert set(got) == set(vec) and all(np.allclose(got[n], vec[n], atol=1e-5) for n in vec)


def test_translation_joins_once_and_leaves_no_tables(spark, monkeypatch):
    from loomgraph.config import EmbeddingConfig
    from loomgraph.operators import translate
    from loomgraph.plans import written

    names, real, before = [], translate.written, written.paths()
    monkeypatch.setattr(translate, "written", lambda df, name="table": names.append(name) or real(df, name))
    facts = spark.createDataFrame([(f"n{i % 5}", f"p{i % 2}", f"n{i % 3}") for i in range(12)], "s string, p string, o string")
    assert translate.train_translation(facts, EmbeddingConfig(embedding_dim=3, epochs=2)).count() == 5
    assert names == ["facts"] + ["gradients", "vectors", "vectors"] * 2
    assert len(written.paths() - before) == 3  # the facts and the last vectors


# Turtle in splits.


def test_turtle_in_splits(spark, tmp_path):
    """Every size of a split gives what the whole-file reader gives, up to the names of nodes without one."""
    import re

    from loomgraph.sources.turtle import TurtleError, parse_turtle, read_turtle, read_whole_turtle

    text = '''@prefix ex: <http://e/> . @base <http://b/> .
ex:a a ex:T ; # a remark with . and """ in it
  ex:p "x . y"@en , 'q.' , """long . with
lines . and "quotes" ""
  @prefix ex: <no> . """ , 1.5 , <rel.ative> ;
  ex:q [ ex:r _:b1 ; ex:s ( 1 "two." 3.0 ) ] .
PREFIX f:
  <http://f/>
f:x.y ex:p \'\'\'single . "double" """ three
end.\'\'\' . f:z f:p ex:a.b, "\\"."
  .
@prefix ex: <http://later/> .
ex:c ex:d ex:e .ex:f ex:g ex:h .
[] ex:p "last" .
'''
    for name, body in (("a.ttl", text), ("b.ttl", text.replace("ex:a", "ex:bb") * 1), ("c.ttl", "")):
        (tmp_path / name).write_text(body)
    shape = lambda rows: sorted(tuple(re.sub("_:n.*", "_:n", str(v)) for v in r) for r in rows)
    want = shape(read_whole_turtle(spark, str(tmp_path)).collect())
    assert len(want) == 2 * len(parse_turtle(text)) and len(want) > 40
    for size in ("19b", "300b"):
        session = spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", size)
        session.conf.set("spark.sql.files.openCostInBytes", "0b")
        got = read_turtle(session, str(tmp_path)).collect()
        assert shape(got) == want, size
        nodes = {r.s for r in got if r.s.startswith("_:n")}
        assert len(nodes) == len({r.s for r in read_whole_turtle(spark, str(tmp_path)).collect() if r.s.startswith("_:n")})
    (tmp_path / "broken.ttl").write_text('<a> <b> """never closed .\n<c> <d> <e> .\n')
    with pytest.raises(Exception, match="not closed|cannot read"):
        read_turtle(spark, str(tmp_path)).collect()
    assert issubclass(TurtleError, ValueError)

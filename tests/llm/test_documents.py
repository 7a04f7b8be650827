"""Operators on documents against plain models, on nulls, empty, long, repeated and clashing rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomgraph.llm.kernels import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(messy):
    return [(r.doc_id, r.text or "", r.source) for r in messy.select("doc_id", "text", "source").collect()]


def bag(items):
    return Counter(map(repr, items))


def repeats(ws, k):
    seen = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    hit = set()
    for i in range(len(ws) - k + 1):
        if seen[tuple(ws[i : i + k])] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def test_quality(messy, none):
    from loomgraph.llm.quality import quality_rules

    want = []
    for i, t, _ in rows(messy):
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r3, n = repeats(ws, 3), len(ws)
        failed = n < 50 or 100 * r3 > 50 * n
        want.append((i, n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r3, repeats(ws, 10), failed))
    got = quality_rules(messy).collect()
    assert bag(tuple(r)[:7] + (r.base_failed,) for r in got) == bag(want)
    assert all(r.kept == (not r.base_failed and 1000 * r.n_covered <= 300 * r.n_words and r.longest_repeat <= 200) for r in got)
    assert quality_rules(none).count() == 0


def thue_morse(n):
    """Two strings of n letters that any polynomial hash modulo a power of two confuses."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048])
def test_no_hash_stands_for_equality(spark, n):
    """Words and lines are told apart where sums modulo 2**64 are not, by every operator on words."""
    from loomgraph.llm.pieces import encode_documents
    from loomgraph.llm.quality import quality_rules
    from loomgraph.llm.substring import substring_dedup
    from loomgraph.llm.toxicity import Tokens

    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a} {b} {a}")], "doc_id long, text string")
    assert {r.doc_id: (r.n_dup_lines, r.longest_repeat) for r in quality_rules(docs).collect()} == {1: (0, 0), 2: (0, 1)}
    assert all(r.round_trip for r in encode_documents(docs).collect())
    lead = " ".join(f"w{i}" for i in range(34))
    two = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(two).collect()} == {0}
    letters = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(thue_morse(n))], "doc_id long, text string")
    ws = [list(t) for t in thue_morse(n)]
    seen = Counter(tuple(w[i : i + 35]) for w in ws for i in range(n - 34))
    want = [len({k for j in range(n - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}) for w in ws]
    assert [r.n_removed for r in substring_dedup(letters).orderBy("doc_id").collect()] == want
    tokens = Tokens(Texts(pa.array([a, b])), {})
    assert all(len(set(h.tolist())) == len(at) for at, h in list(tokens.features())[-1:])


def test_coverage_alone_rejects(spark):
    """A text that the base rule keeps, two fifths of it one paragraph of ten words or more said again."""
    from loomgraph.llm.quality import quality_rules

    words = [f"w{i}" for i in range(600)]
    text = " ".join([*words, *words[:150], "x", *[f"v{i}" for i in range(249)]])
    (r,) = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert not r.base_failed and r.longest_repeat == 150 and r.n_covered == 300 and r.n_words == 1000 and r.kept
    text = " ".join([*words[:400], *words[:180], "x", *[f"v{i}" for i in range(200)]])
    (r,) = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert not r.base_failed and r.longest_repeat <= 200 and not r.kept


def test_longest_repeats():
    from loomgraph.llm.quality import longest_repeats

    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = rng.integers(0, 40, 5)
        h = rng.integers(0, 3, counts.sum()).astype(np.uint64)
        ptr = np.concatenate([[0], np.cumsum(counts)])
        got = longest_repeats(h, ptr)
        for a, b in zip(ptr[:-1], ptr[1:]):
            s = h[a:b].tolist()
            for i in range(len(s)):
                best = max((next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), 0) for j in range(len(s)) if j != i), default=0)
                assert got[a + i] == best


def test_substring(messy, none):
    from loomgraph.llm.substring import substring_dedup

    docs = rows(messy)
    seen = Counter(tuple(ws[i : i + 35]) for ws in (WORD.findall(t) for _, t, _ in docs) for i in range(len(ws) - 34))
    want = []
    for i, t, _ in docs:
        ws = WORD.findall(t)
        gone = {k for j in range(len(ws) - 34) if seen[tuple(ws[j : j + 35])] > 1 for k in range(j, j + 35)}
        want.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    assert bag(map(tuple, substring_dedup(messy).collect())) == bag(want)
    digest = [(r.doc_id, r.kept_sha256) for r in substring_dedup(messy, digest=True).collect()]
    assert bag(digest) == bag((i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in want)
    assert substring_dedup(none).count() == 0


def removed_words(docs, window):
    """n_removed of each text by counting every window."""
    ws = [t.split() for t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    return [len({k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}) for w in ws]


@pytest.mark.parametrize("bits", [2, 5, 62])
def test_substring_with_collisions(spark, bits):
    """Nodes whose hashes collide are found out at their source coordinates, and what they hide is found by comparing words."""
    from loomgraph.llm.substring import substring_dedup

    rng = np.random.default_rng(17)
    parts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 25)) for _ in range(12)]
    docs = [" ".join(f"{p} x{i}" if rng.random() < 0.3 else p for p in rng.choice(parts, rng.integers(1, 8))) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = [r.n_removed for r in substring_dedup(df, window=8, anchor=3, node_bits=bits).orderBy("doc_id").collect()]
    assert got == removed_words(docs, 8) and 0 < sum(got)


def test_paths_are_compacted(spark):
    """A passage in several texts is one path, whatever is around it; a ring of windows has no head and stays as it is."""
    from loomgraph.llm.substring import _source, repeated_paths

    words = [f"w{i}" for i in range(400)]
    passage, ring = " ".join(words[:300]), " ".join(["a b c d e f g h i j"] * 20)
    texts = [f"l{i} {passage} r{i}" for i in range(3)] + [ring]
    src = _source(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    spans = repeated_paths(src, 35, 8)[2].collect()
    assert [(r.start, r.len, r.low) for r in spans if r.doc_id < 3] == [(1, 300, 0)] * 3
    assert len({r.path for r in spans if r.doc_id < 3}) == 1 and any(r.doc_id == 3 for r in spans)


@pytest.mark.parametrize("alphabet", [2, 5])
def test_substring_of_few_words(spark, alphabet):
    """Texts of few different words, where anchors tie and paths branch everywhere."""
    from loomgraph.llm.substring import substring_dedup

    rng = np.random.default_rng(alphabet)
    texts = [" ".join("abcdefg"[x] for x in rng.integers(0, alphabet, rng.integers(0, 120))) for _ in range(80)]
    texts += [t[10:90] for t in texts[:20]] + ["a " * 90, "a " * 40, "b a " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    k = 12
    seen = Counter(tuple(ws[i : i + k]) for ws in map(str.split, texts) for i in range(len(ws) - k + 1))
    got = {r.doc_id: r.kept_text for r in substring_dedup(docs, window=k, anchor=4).collect()}
    for i, t in enumerate(texts):
        ws = t.split()
        gone = {x for j in range(len(ws) - k + 1) if seen[tuple(ws[j : j + k])] > 1 for x in range(j, j + k)}
        assert got[i] == " ".join(w for x, w in enumerate(ws) if x not in gone)


def simhash(t):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] * bool(ws)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """Smallest index reachable over two or fewer differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("cap", [256, 1])
def test_simhash(messy, none, cap):
    from loomgraph.llm.simhash import simhash_groups

    docs = rows(messy)
    fps = [simhash(t) for _, t, _ in docs]
    of = groups(fps)
    names = {}
    for (i, _, _), g in zip(docs, of):
        if i is not None:
            names[g] = min(i, names.get(g, i))
    got = simhash_groups(messy, bucket_cap=cap).collect()
    assert bag((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == bag((i, f, names.get(g)) for (i, _, _), f, g in zip(docs, fps, of))
    assert simhash_groups(none).count() == 0


@pytest.mark.parametrize(("n", "want"), [(10**5, [0, 0, 0]), (10**9, [0, 1])])
def test_thresholds(spark, n, want):
    """The dynamic program trades probes for candidates as the corpus grows; every plan finds every pair."""
    from loomgraph.llm.simhash import near_pairs, plan_parts

    both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
    plan = plan_parts(both, n)
    assert sorted(t for _, t in plan) == want and sum(len(b) for b, _ in plan) == 64
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 30).tolist()
    fps = sorted({b ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (6, 2))} | set(base))
    for cap in (256, 1):
        pairs = {tuple(sorted(p)) for p in near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), plan, bucket_cap=cap).collect()}
        exact = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
        assert pairs <= exact and (cap == 1 or pairs == exact)
        index = {f: i for i, f in enumerate(fps)}
        root = list(range(len(fps)))
        for _ in fps:
            for a, b in pairs:
                root[index[a]] = root[index[b]] = min(root[index[a]], root[index[b]])
        assert len(set(root)) == len(set(groups(fps)))


def test_components(spark):
    from loomgraph.llm.components import connected_components

    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 3), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(51), 0) | dict.fromkeys((200, 201, 202), 200)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(messy, none):
    from loomgraph.llm.mixing import mix_sources

    docs = rows(messy)
    size = Counter()
    for _, t, s in docs:
        size[s] += len(WORD.findall(t))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, total, free = {}, 1.5 * sum(size.values()), set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if 2 * size[s] < weight[s] * level}
        target |= {s: 2.0 * size[s] for s in full}
        free -= full
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
    source = {i: s for i, _, s in docs}
    got = mix_sources(messy, block_words=64, shards=4).collect()
    assert len(got) == len(docs)
    assert bag((r.doc_id, r.size) for r in got) == bag((i, len(WORD.findall(t))) for i, t, _ in docs)
    taken = Counter()
    for r in got:
        words = sum(c.words for c in r.copies)
        assert words <= 2 * r.size and all(0 <= c.shard < 4 and 0 < c.words <= r.size for c in r.copies)
        if r.doc_id is not None:
            assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
            taken[source[r.doc_id]] += words
    for s in set(order) - {"s1", None}:  # those two hold rows without an id
        assert abs(taken[s] - target[s]) < 1, s
    again = mix_sources(messy.repartition(5), block_words=64, shards=4).collect()
    assert bag((r.doc_id, r.size, [tuple(c) for c in r.copies]) for r in got) == bag((r.doc_id, r.size, [tuple(c) for c in r.copies]) for r in again)
    assert mix_sources(none).count() == 0


def test_shards_are_assembled(spark):
    """Each shard of the mix lies whole in one partition, by slot, with the words that its blocks give it."""
    from pyspark.sql import functions as F

    from loomgraph.llm.mixing import mix_sources, shuffled

    docs = spark.createDataFrame([(i, f"w{i} " * 50, "en", f"s{i % 3}", 200) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        mixed = mix_sources(docs, carry=("text", "lang", "source", "n_chars"), block_words=100, shards=6)
        want = {r.shard: r.n for r in mixed.select(F.inline("copies")).groupBy("shard").agg(F.count("*").alias("n")).collect()}
        rows = shuffled(mixed).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(want) == 6 and {s: sum(r.shard == s for r in rows) for s in want} == want
    assert all(len({r.p for r in rows if r.shard == s}) == 1 for s in want)
    for p in {r.p for r in rows}:
        mine = [(r.shard, r.slot) for r in rows if r.p == p]
        assert mine == sorted(mine)


@pytest.mark.parametrize("shards", [1, 2, 7, 30])
def test_blocks_of_shards(spark, shards):
    """Each block of a round goes to one shard, shards hold equal numbers of blocks, and sources give their targets exactly."""
    from pyspark.sql import functions as F

    from loomgraph.llm.mixing import mix_sources

    rng = np.random.default_rng(21)
    data = [(i, " ".join(["w"] * int(rng.integers(0, 90 if i % 50 else 900))), ("a", "b", "c", None, "tiny")[i % 5] if i % 40 else "tiny") for i in range(700)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    seen = {}
    for seed in ("mix-1", "other"):
        got = mix_sources(docs, block_words=64, shards=shards, seed=seed)
        rows = got.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", "size", "target", F.inline_outer("copies")).collect()
        blocks, taken, target, parts = {}, Counter(), {}, {}
        for r in rows:
            target[r.source] = r.target
            if r.words:
                blocks.setdefault((r.source, r.epoch, r.block), set()).add(r.shard)
                taken[r.source] += r.words
                parts.setdefault((r.doc_id, r.epoch), []).append((r.first, r.first + r.words))
                assert r.first + r.words <= r.size
        assert all(len(x) == 1 for x in blocks.values())
        assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
        for spans in parts.values():
            spans.sort()
            assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        per = Counter(next(iter(x)) for x in blocks.values())
        assert set(per) == set(range(shards)) and max(per.values()) - min(per.values()) <= 1
        seen[seed] = {(r.doc_id, r.epoch, r.block, r.words) for r in rows if r.words}
    assert seen["mix-1"] != seen["other"]


def test_parts_spell_the_text(spark):
    from loomgraph.llm.mixing import mix_sources, shuffled

    rng = np.random.default_rng(22)
    gap = lambda: "".join(rng.choice([" ", "\n", "\t", "  "], rng.integers(1, 3)))
    texts = {i: gap() * (i % 2) + "".join(f"é{j}{gap()}" for j in range(int(rng.integers(1, 200)))) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mix_sources(docs, carry=("text", "lang", "source", "n_chars"), block_words=50, shards=3)
    where = {(r.doc_id, c.slot): (c.epoch, c.first) for r in mixed.select("doc_id", "copies").collect() for c in r.copies}
    parts = {}
    for r in shuffled(mixed).collect():
        epoch, first = where[r.doc_id, r.slot]
        assert r.n_chars == len(r.text)
        parts.setdefault((r.doc_id, epoch), []).append((first, r.text))
    assert all("".join(t for _, t in sorted(parts[i, 0])) == t for i, t in texts.items())
    assert all(t in texts[i] for (i, _), some in parts.items() for _, t in some)


def test_split_tree():
    from loomgraph.llm.mixing import split_tree

    rng = np.random.default_rng(0)
    quotas, room = np.array([50, 0, 7, 43]), np.array([30, 30, 40])
    total = np.zeros((4, 3))
    for _ in range(400):
        row, col, n = split_tree(quotas, room, rng)
        t = np.zeros((4, 3), dtype=np.int64)
        np.add.at(t, (row, col), n)
        assert (t.sum(axis=1) == quotas).all() and (t.sum(axis=0) == room).all() and (t >= 0).all()
        total += t
    assert np.abs(total / 400 - np.outer(quotas, room) / 100).max() < 0.5


def test_secrets(messy, none):
    from loomgraph.llm.secrets import scan_secrets

    got = scan_secrets(messy, redact="[x]")
    assert all(not r.spans for r in got.collect() if r.doc_id != 13) and got.count() == messy.count()
    assert scan_secrets(none).count() == 0


def test_language(messy, none):
    from loomgraph.llm.langid import language_id

    got = language_id(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 17):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de", "fr") and 0 <= r.score <= 1
    assert language_id(none).count() == 0
    assert {r.lang_pred for r in language_id(messy.withColumn("lang", messy.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")).collect()} == {"und"}


def test_toxicity(spark, messy, none):
    from loomgraph.llm.toxicity import toxicity

    labels = spark.createDataFrame([(i, i % 2, 7) for i in range(20)] + [(None, 1, 7), (4, None, 7), (5, 9, 7), (6, 1, 7), (6, 0, 7)], "doc_id long, toxic int, score int")
    for y in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity(messy, y).collect()
        assert len(got) == messy.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity(none, labels).count() == 0


def test_pieces(messy, none):
    from loomgraph.llm.pieces import decode_documents, encode_documents

    got = encode_documents(messy)
    assert all(r.round_trip for r in got.collect())
    assert bag(map(tuple, decode_documents(got).collect())) == bag((i, t) for i, t, _ in rows(messy))
    assert encode_documents(none).count() == 0 == decode_documents(encode_documents(none)).count()


def test_near_copies(spark, messy, none):
    """Every document has a leader like it; families are found whole, and what is alike in fewer shingles is left alone."""
    from loomgraph.llm.simhash import _shingles, near_copies

    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    rows, i = [], 0
    for family in range(12):
        base = [word() for _ in range(200)]
        for _ in range(1 + family * 3):
            copy = list(base)
            for at in rng.integers(0, 200, family % 3):
                copy[at] = word()
            rows.append((i, " ".join(copy)))
            i += 1
        rows.append((i, " ".join(w if k % 6 else word() for k, w in enumerate(base))))  # a sixth of the words changed
        i += 1
    texts = {k: _shingles(t, 5) for k, t in rows}
    got = {r.doc_id: r.leader for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    like = lambda a, b: len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
    assert set(got) == set(texts) and all(k <= d and got[k] == k and like(d, k) for d, k in got.items())
    led = [d for d in texts if any(like(d, k) for k in texts if k < d)]
    assert sum(got[d] != d for d in led) >= 0.9 * len(led) and all(got[d] == d for d in texts if d not in led)
    messy_got = near_copies(messy).collect()
    assert len(messy_got) == messy.filter("doc_id is not null").count()
    assert {r.leader for r in messy_got if r.doc_id in (1, 2, 3)} == {1} and {r.leader for r in messy_got if r.doc_id in (4, 5)} == {4}
    assert near_copies(none).count() == 0

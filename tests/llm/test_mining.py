"""Phrases, source divergence and license scans: messy rows, plain counts, hand-made cases."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, n string, id string, low string, value string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x") for r in rows], COLUMNS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Phrases.


def plain_phrases(rows, least, inside, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for w, a in counts.items():
            if len(w) < 2 or a < least:
                continue
            score, _, l, r = min((2000000 * a // (counts[w[:k]] + counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            longer = [b for v, b in counts.items() if len(w) < len(v) <= 4 and b >= least and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if not any(100 * b >= inside * a for b in longer):
                found.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def random_rows(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "été", "c-d", "e", "the", "ſ", "K"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!? "]) for _ in range(r.randint(0, 60)))
    return [(r.choice([None, 1, i]), r.choice([None, ""]) if r.random() < 0.1 else text(), r.choice([None, "und", "en", "en", "en", "fr"]), r.choice([None, "", "s1", "s2"])) for i in range(n)]


def test_phrases_against_plain_counts(spark):
    from loomgraph.llm.phrases import collocations

    for seed, least in ((1, 3), (2, 8)):
        rows = random_rows(seed)
        got = collocations(docs(spark, rows).repartition(3), least=least)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, 80)


def test_phrases_in_small_blocks(spark, monkeypatch):
    from loomgraph.llm import phrases

    rows = random_rows(3)
    want = plain_phrases(rows, 3, 80, top=5)
    monkeypatch.setattr(phrases, "BLOCK", 50)
    assert sorted(map(tuple, phrases.collocations(docs(spark, rows).repartition(2), least=3, top=5).collect())) == want


def test_phrases_are_named_without_joins(spark, monkeypatch):
    """Pairs are dealt once: nothing joins them with their names, and no table holds a row for each."""
    from loomgraph.llm import phrases

    made, cut = [], phrases.cut
    monkeypatch.setattr(phrases, "cut", lambda df, name="cut": made.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, name))
    _, levels = phrases.count_phrases(docs(spark, random_rows(3)), least=3)
    assert len(levels) == 4 and levels[1].count() > 0
    assert not [plan for _, plan in made if "Join" in plan]
    assert [c for c, _ in made].count(["block", "stream", "ids"]) == 3


def test_phrases_of_messy_rows(spark, messy, none):
    from loomgraph.llm.phrases import collocations

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in messy.collect()]
    assert sorted(map(tuple, collocations(messy, least=30).collect())) == plain_phrases(rows, 30, 80)
    assert collocations(none).count() == 0


def test_stream_pairs():
    import numpy as np

    from loomgraph.llm.phrases import _paired

    stream = np.array([-1, 0, 1, 0, 1, -1, 2, 0, -1, 3, 1, 1], dtype=np.int32)
    out, u, v, n = _paired(stream, np.array([0, 1, 3]), np.array([10, 11, 13]), False)
    assert dict(zip(zip(u.tolist(), v.tolist()), n.tolist())) == {(10, 11): 2, (11, 10): 1, (13, 11): 1, (11, 11): 1}
    runs = [x for x in " ".join(map(str, out)).split("-1") if x.strip()]
    assert [len(x.split()) for x in runs] == [3, 2] and runs[0].split()[0] == runs[0].split()[2]


def test_exact_scores(spark):
    """Counts whose products pass 64 bits."""
    from loomgraph.llm.phrases import scored_phrases

    big = 3 * 10**13
    first = spark.createDataFrame([(1, "en", "a", big + 1), (2, "en", "b", big)], "id long, lang string, word string, a long")
    second = spark.createDataFrame([(3, 1, 2, big - 1)], "id long, u long, v long, a long")
    (row,) = scored_phrases([first, second]).collect()
    assert (row.phrase, row.score, row.l, row.r) == ("a b", 2000000 * (big - 1) // (2 * big + 1), big + 1, big)


# Sources.


def plain_divergence(rows, least, top=50):
    counts, df, seen = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        lang, source = lang or "", source or ""
        seen.add((lang, source))
        counts[lang, source].update(ws)
        df[lang].update(set(ws))
    out = []
    for lang in {x for x, _ in seen}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        mine = sorted(s for x, s in seen if x == lang)

        def p(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, ps = p(sum((counts[lang, s] for s in mine), Counter())), {s: p(counts[lang, s]) for s in mine}
        for s in mine:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in mine if o != s)
            terms = sorted((-(ps[s][t] - q[t]), t.encode()) for t in kept if counts[lang, s][t] and ps[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_against_plain_counts(spark, monkeypatch):
    from loomgraph.llm import divergence

    rows = random_rows(4, 80) + [(1, "9 9", "solo", "only"), (2, None, "solo2", None)]
    got = divergence.source_divergence(docs(spark, rows).repartition(3), least=4, top=2)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 4, 2)
    for name, small in (("TRIE", 3), ("MERGED_ROWS", 7), ("STRETCH", 9), ("TILE", 2)):
        monkeypatch.setattr(divergence, name, small)
    assert sorted(map(tuple, divergence.source_divergence(docs(spark, rows).repartition(2), least=4).collect())) == plain_divergence(rows, 4)


def test_divergence_of_messy_rows(spark, messy, none):
    from loomgraph.llm.divergence import source_divergence

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in messy.collect()]
    assert sorted(map(tuple, source_divergence(messy, least=2).collect())) == plain_divergence(rows, 2)
    assert source_divergence(none).count() == 0


def test_trie():
    import numpy as np

    from loomgraph.llm.divergence import Trie

    r = random.Random(6)
    tries, want = [], defaultdict(lambda: [0, 0])
    for k in range(4):
        keys = sorted({bytes(r.choice(b"ab\x00\xc3") for _ in range(r.randint(0, 6))) for _ in range(60)} | {b"x" * 5000})
        groups = [("en", "s1"), ("en", f"s{k}")]
        leaf, group = np.array([r.randrange(len(keys)) for _ in range(200)]), np.array([r.randrange(2) for _ in range(200)])
        tries.append(Trie(keys, leaf, group, np.full(200, 2), np.ones(200, dtype=np.int64), groups))
        assert tries[-1].keys() == keys and sum(map(len, tries[-1].edges)) < sum(map(len, keys))
        for x, g in zip(leaf, group):
            want[keys[x], groups[g]] = [want[keys[x], groups[g]][0] + 2, want[keys[x], groups[g]][1] + 1]
    whole = Trie.merged(tries)
    assert whole.keys() == sorted({k for t in tries for k in t.keys()})
    found = {(whole.keys()[x], whole.groups[g]): [n, d] for x, g, n, d in zip(whole.leaf, whole.group, whole.n.tolist(), whole.docs.tolist())}
    assert found == dict(want) and Trie.merged([]).keys() == []


def test_long_division():
    import numpy as np

    from loomgraph.llm.divergence import _scaled

    counts, total = np.array([5, 7, 10**13, 8 * 10**15 - 1]), np.array([5, 8 * 10**15, 3 * 10**13 + 1, 8 * 10**15])
    assert _scaled(counts, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, total)]


# Licenses.


def plain_licenses(texts):
    """Every place of every template in every text, judged word for word; the votes of the rarest words."""
    from loomgraph.llm.licenses import BASE, LOOKUPS, TEMPLATES, WORD, words_of

    all_words = [re.findall(WORD, lower(t)) for t in texts]
    vocab = {w for _, t, _ in TEMPLATES for w in words_of(t)} | {w for p, _ in BASE for w in p.split()}
    df = Counter(w for ws in all_words for w in set(ws) & vocab)
    out = []
    for ws in all_words:
        base = [(i, label) for phrase, label in BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        best, labels = 0.0, {x for _, x in base}
        for label, text, keys in TEMPLATES:
            t = words_of(text)
            looked = sorted(set(t) & set(ws), key=lambda w: (df[w], w))[:LOOKUPS]
            key = set()
            for k in map(words_of, keys):
                at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
                key |= set(range(at, at + len(k)))
            for o in range(-len(t), len(ws)):
                same = {j for j in range(len(t)) if 0 <= o + j < len(ws) and ws[o + j] == t[j]}
                if key <= same and 2 * sum(any(t[j] == w for j in same) for w in looked) > len(looked):
                    labels.add(label)
                    best = max(best, len(same) / len(t))
        places = [i for i, _ in base]
        out.append((len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(best, 9)))
    return out


def test_licenses_against_plain_search(spark):
    from loomgraph.llm.licenses import TEMPLATES, scan_licenses

    r = random.Random(8)
    words = [w for _, t, _ in TEMPLATES for w in t.split()] + ["lorem", "été", "K", "İ", "x9", "the", "cc", "by"]
    texts = [None, "", " \n", "CC-BY cc by, CC.BY 4.0", "worK cc K by", "a" * 30_000 + " all rights RESERVED", "mit license"]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 6)):
            t = r.choice(TEMPLATES)[1].split() if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 12))]
            if r.random() < 0.4 and len(t) > 2:
                t = t[r.randint(0, 2) :]
            if r.random() < 0.3:
                t[r.randrange(len(t))] = r.choice(words)
            parts.append(" ".join(t))
        texts.append(r.choice([" ", "\n", ". "]).join(parts))
    rows = [(None if i % 7 == 0 else i // 2, t, "en", "s") for i, t in enumerate(texts)]
    got = scan_licenses(docs(spark, rows).repartition(2), carry=("source",)).collect()
    shape = lambda x: (x.n_words, len(x.base), min((b["at"] for b in x.base), default=None), max((b["at"] for b in x.base), default=None), x.base_labels, x.labels, round(x.score, 9))
    assert sorted(map(shape, got), key=repr) == sorted(plain_licenses(texts), key=repr)


def test_licenses_found(spark):
    from loomgraph.llm.licenses import scan_licenses

    mit = "Copyright (c) 2020 Ada\n\n Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including"
    rows = [(1, mit, "en", "s"), (2, "the mit license", "en", "s"), (3, "permission is granted to deal in software", "en", "s"), (4, "GNU GENERAL PUBLIC LICENSE VERSION 3", "en", "s"), (5, "von mit und license", "de", "s")]
    got = {r.doc_id: (r.labels, r.base_labels) for r in scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ("mit", ""), 2: ("mit", ""), 3: ("", ""), 4: ("gpl,gpl-3.0", "gpl"), 5: ("", "")}


def test_licenses_of_messy_rows(spark, messy, none):
    from loomgraph.llm.licenses import scan_licenses

    got = scan_licenses(messy)
    assert got.count() == messy.count() and got.filter("labels <> ''").count() == 0
    assert scan_licenses(none).count() == 0


def test_license_scan_is_native(spark, messy):
    """No Python worker in the plan."""
    from loomgraph.llm.licenses import scan_licenses

    plan = scan_licenses(messy)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_templates_hold_their_keys():
    import pytest

    from loomgraph.llm.licenses import TEMPLATES, _keys, words_of

    for _, text, phrases in TEMPLATES:
        assert _keys(words_of(text), phrases)
    for bad in (("absent",), ()):
        with pytest.raises(ValueError, match="key phrase"):
            _keys(["a", "b"], bad)


def test_spans():
    import numpy as np

    from loomgraph.llm.spans import spans, word_numbers

    data = np.frombuffer(b"ab  abcab", dtype=np.uint8)
    start, end, row = spans(data != 0x20, np.array([0, 2, 7, 7, 9]))
    assert (start.tolist(), end.tolist(), row.tolist()) == ([0, 4, 7], [2, 7, 9], [0, 1, 3])
    number, words = word_numbers(data, data != 0x20, start, end)
    assert number.tolist() == [0, 1, 0] and words == pa.array([b"ab", b"abc"], pa.large_binary())

"""Source divergence audit over mergeable radix tries.

Every partition counts its terms in a byte trie whose leaves hold a counter for each source. A trie is laid out in the order of
its bytes: of each key stand the number of bytes that it shares with the one before, the depth at which its branch leaves, and
the rest, its edges; counters stand beside in one array. Tries merge by merging these. A partition's tries are walked and their
leaves dealt by ranges of prefixes, languages first. In a range, equal leaves of all tries stand side by side and merge into one,
which is kept if enough documents of its language have the term. The merged leaves, still in byte order, are walked again in
stretches: a stretch adds up its share of each pair of sources and streams the candidate terms of each source, where equal values
already stand in the order that breaks their ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_rows, cut, forget
from .kernels import LOWER, Texts, column, pieces
from .spans import byte_class, spans, word_numbers

LETTER = ~byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: In how many documents of its language a kept term stands at least; the terms reported for a source.
LEAST, TOP = 30, 50
#: Leaf counters of a trie before it is walked and begun anew; rows of leaves merged at once; counters of a stretch; sources met at once.
TRIE, MERGED_ROWS, STRETCH, TILE = 2_000_000, 200_000, 200_000, 128

LEAF = "lang string, term string, source string, n long, docs long"
MERGED = "part int, before long, lang string, term string, total long, sources array<string>, counts array<long>"
PART = "lang string, source string, part string, item string, value long"


def _shared(keys: list[bytes]) -> np.ndarray:
    """How many bytes each key shares with the one before, by comparing one place of all keys at a time."""
    size = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    offs, data = np.append(0, np.cumsum(size)), np.frombuffer(b"".join(keys), dtype=np.uint8)
    out = np.zeros(len(keys), dtype=np.int64)
    limit = np.append(0, np.minimum(size[1:], size[:-1]))[: len(keys)]
    same = np.flatnonzero(limit > 0)
    while len(same):
        same = same[data[offs[same] + out[same]] == data[offs[same - 1] + out[same]]]
        out[same] += 1
        same = same[out[same] < limit[same]]
    return out


class Trie:
    """A radix trie over bytes in the order of its keys: shared[i] bytes of key i are those of key i - 1, edges hold the rest of
    each key; counters are (leaf, group, n, docs), by leaf and group, with the groups' names (language, source) in groups."""

    def __init__(self, keys: list[bytes], leaf: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray, groups: list[tuple[str, str]]):
        """keys in byte order, each once; counters of one leaf and group are added up."""
        self.shared = _shared(keys)
        self.edges = [key[same:] for key, same in zip(keys, self.shared.tolist())]
        code, at = np.unique(leaf * max(len(groups), 1) + group, return_inverse=True)
        self.leaf, self.group = code // max(len(groups), 1), code % max(len(groups), 1)
        self.n, self.docs = (np.bincount(at, weights=x, minlength=len(code)).astype(np.int64) for x in (n, docs))
        self.groups = groups

    def keys(self) -> list[bytes]:
        """The walk: every key from the path to its branch and its edges, in byte order."""
        out, path = [], b""
        for same, edge in zip(self.shared.tolist(), self.edges):
            path = path[:same] + edge
            out.append(path)
        return out

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        """One trie with the keys and counters of all."""
        walked = [t.keys() for t in tries]
        every = pa.array([k for keys in walked for k in keys], pa.large_binary()).dictionary_encode()
        order = np.asarray(pc.sort_indices(every.dictionary))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        leaf, at = place[np.asarray(every.indices)] if len(every) else np.zeros(0, np.int64), np.cumsum([0] + [len(k) for k in walked])
        names: dict[tuple[str, str], int] = {}
        codes = [np.array([names.setdefault(g, len(names)) for g in t.groups], dtype=np.int64) for t in tries]
        cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return Trie(
            every.dictionary.take(pa.array(order)).to_pylist(), cat([leaf[a : a + len(k)].astype(np.int64)[t.leaf] for a, k, t in zip(at, walked, tries)]),
            cat([c[t.group] for c, t in zip(codes, tries)]), cat([t.n for t in tries]), cat([t.docs for t in tries]), list(names),
        )


def _counted_piece(piece: pa.RecordBatch) -> Trie:
    """The trie of the terms of some whole texts."""
    texts = Texts(column(piece, "text"))
    data = LOWER[texts.data]
    solid = LETTER[data]
    start, end, row = spans(solid, texts.offs)
    number, words = word_numbers(data, solid, start, end)
    langs, sources = (pc.dictionary_encode(column(piece, c)) for c in ("lang", "source"))
    n_words, n_sources = max(len(words), 1), max(len(sources.dictionary), 1)
    group = np.asarray(langs.indices).astype(np.int64) * n_sources + np.asarray(sources.indices)
    order = np.asarray(pc.sort_indices(words)).astype(np.int64)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    number = place[number]
    found, n = np.unique(group[row] * n_words + number, return_counts=True)
    once = np.unique(row * n_words + number)  # a term of a document once
    docs = np.unique(group[once // n_words] * n_words + once % n_words, return_counts=True)[1]
    lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
    names = [(x, y) for x in lang_names for y in source_names]
    return Trie(words.take(pa.array(order)).to_pylist(), found % n_words, found // n_words, n, docs, names)


def _leaves(trie: Trie) -> pa.RecordBatch:
    """The walk of a trie, a row for each counter."""
    keys = pa.array(trie.keys(), pa.binary()).cast(pa.string())
    langs, sources = (pa.array([g[k] for g in trie.groups], pa.string()).take(pa.array(trie.group)) for k in (0, 1))
    return pa.RecordBatch.from_arrays([langs, keys.take(pa.array(trie.leaf)), sources, pa.array(trie.n), pa.array(trie.docs)], names=["lang", "term", "source", "n", "docs"])


def _counted(batches):
    """Record batches of (lang, source, text) to the leaves of tries."""
    tries, size = [], 0
    for piece in pieces(batches, "text"):
        tries.append(_counted_piece(piece))
        size += len(tries[-1].n)
        if size >= TRIE:
            tries = [Trie.merged(tries)]
            size = len(tries[0].n)
            if size >= TRIE // 2:
                yield _leaves(tries[0])
                tries, size = [], 0
    if tries:
        yield _leaves(Trie.merged(tries))


def _changes(rows: pa.Table) -> np.ndarray:
    """Where a row's language or term is not that of the row before; the first row is such."""
    out = np.ones(rows.num_rows, dtype=bool)
    for k in ("lang", "term"):
        c = rows.column(k)
        new = np.asarray(pc.not_equal(c[1:], c[:-1]))
        out[1:] = new if k == "lang" else out[1:] | new
    return out


def _summed(rows: pa.Table) -> pa.Table:
    """Sorted leaves with those of one language, term and source added up."""
    new = _changes(rows)
    sources = rows.column("source").combine_chunks().dictionary_encode()
    code, first, at = np.unique((np.cumsum(new) - 1) * max(len(sources.dictionary), 1) + np.asarray(sources.indices), return_index=True, return_inverse=True)
    out = rows.take(pa.array(first))
    for c in ("n", "docs"):
        total = np.zeros(len(code), dtype=np.int64)
        np.add.at(total, at, np.asarray(rows.column(c)))
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(total))
    return out


def _merging(least: int):
    def merge(batches):
        """Sorted leaves of a range to its merged ones that are kept, each with the number of counters of its language before it."""
        part, entries, lang_now = TaskContext.get().partitionId(), 0, None

        def kept(rows: pa.Table):
            nonlocal entries, lang_now
            rows = _summed(rows)
            begin = np.flatnonzero(_changes(rows))
            size = np.diff(np.append(begin, rows.num_rows))
            n, docs = (np.asarray(rows.column(c)) for c in ("n", "docs"))
            keep = np.add.reduceat(docs, begin) >= least
            if not keep.any():
                return
            mine = rows.take(pa.array(np.flatnonzero(np.repeat(keep, size))))
            head, size, total = rows.take(pa.array(begin[keep])), size[keep], np.add.reduceat(n, begin)[keep]
            before = []
            for lang, k in zip(head.column("lang").to_pylist(), size.tolist()):
                if lang != lang_now:
                    entries, lang_now = 0, lang
                before.append(entries)
                entries += k
            offs = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            lists = [pa.ListArray.from_arrays(offs, mine.column(c).combine_chunks()) for c in ("source", "n")]
            columns = [pa.array([part] * len(size), pa.int32()), pa.array(before, pa.int64()), *[head.column(c).combine_chunks() for c in ("lang", "term")], pa.array(total), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "before", "lang", "term", "total", "sources", "counts"])

        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) >= MERGED_ROWS:
                rows = pa.concat_tables(held)
                last = int(np.flatnonzero(_changes(rows))[-1])  # the last term may go on: its leaves so far become one for each source
                if last:
                    yield from kept(rows.slice(0, last))
                held = [_summed(rows.slice(last))]
        if sum(t.num_rows for t in held):
            yield from kept(pa.concat_tables(held))

    return merge


def term_tries(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The merged leaves of kept terms: stretch, lang, term, total, sources, counts. Stretches are runs of a language's terms in byte
    order, of about STRETCH counters each, however the ranges fell."""
    arrow_rows(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    leaves = cut(docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(_counted, LEAF), "leaves")
    ranges = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    merged = cut(ranges.mapInArrow(_merging(least), MERGED), "merged")
    forget(leaves)
    held = merged.groupBy("lang", "part").agg(F.sum(F.size("sources")).alias("held"))
    ahead = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = held.select("lang", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    stretch = F.floor((F.col("ahead") + F.col("before")) / STRETCH).cast("long").alias("stretch")
    return merged.join(held, ["lang", "part"]).select(stretch, "lang", "term", "total", "sources", "counts")


def _scaled(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / total) without passing 64 bits, for 0 < counts <= total < 9e15: long division by thousands."""
    quotient, rest = np.zeros_like(counts + total), counts + np.zeros_like(total)
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return 1 + quotient


def _walked(top: int):
    def walk(key, leaves: pa.Table, groups: pa.Table) -> pa.Table:
        """One stretch: the sums of its terms over each pair of sources, the smaller first, and the candidates of each source. Sources
        meet in tiles, so that the arrays are bounded whatever their number."""
        out: list[list] = [[], [], [], [], []]

        def emit(source, part, item, value):
            for c, x in zip(out, (lang, source, part, item, value)):
                c.append(x)

        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = ["lang", "source", "part", "item", "value"]
        if leaves.num_rows and groups.num_rows:
            lang = leaves.column("lang")[0].as_py()
            leaves, groups = leaves.sort_by("term"), groups.sort_by("source")
            sources = groups.column("source").to_pylist()
            size = np.asarray(groups.column("size").combine_chunks())
            terms, lists = leaves.column("term").to_pylist(), leaves.column("sources").combine_chunks()
            whole = int(groups.column("whole")[0].as_py())
            overall = _scaled(np.asarray(leaves.column("total").combine_chunks()) + 5, np.array([whole]))
            per = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(terms)), per)
            place = {s: i for i, s in enumerate(sources)}
            at = np.array([place[s] for s in lists.flatten().to_pylist()], dtype=np.int64)
            n = np.asarray(leaves.column("counts").combine_chunks().flatten())
            tiles = range(0, len(sources), TILE)

            def scaled(begin: int) -> np.ndarray:
                own = (at >= begin) & (at < begin + TILE)
                counts = np.full((min(TILE, len(sources) - begin), len(terms)), 5, dtype=np.int64)
                counts[at[own] - begin, row[own]] += n[own]
                return _scaled(counts, size[begin : begin + TILE][:, None])

            for begin in tiles:
                p = scaled(begin)
                mine = (at >= begin) & (at < begin + TILE)
                for i in range(len(p)):
                    have = row[mine & (at == begin + i)]
                    more = p[i, have] - overall[have]
                    have, more = have[more > 0], more[more > 0]
                    best = np.argsort(-more, kind="stable")[:top]  # leaves come in byte order, so ties stand in it
                    for t, value in zip(have[best].tolist(), more[best].tolist()):
                        emit(sources[begin + i], "term", terms[t], value)
                for other in range(begin, len(sources), TILE):
                    q = p if other == begin else scaled(other)
                    for i in range(len(p)):
                        sums = np.abs(q - p[i]).sum(axis=1).tolist()
                        for j, value in enumerate(sums):
                            if begin + i < other + j:
                                emit(sources[begin + i], "pair", sources[other + j], value)
        return pa.table({c: pa.array(x, k) for c, x, k in zip(names, out, kinds)})

    return walk


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each pair of a language's sources lies apart, and the terms that a source has
    most above its language.

    Null languages, sources and texts are read as empty strings; null and repeated ids and repeated rows are documents like any
    others, further columns play no part, whatever their names. A group without terms has its rows, with values of 0 if its
    language keeps no term; a language with one source has no pairs. Ties go to the smaller item in the order of its UTF-8 bytes.
    An empty table gives no rows; long texts are read whole."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    merged = cut(term_tries(docs, least), "stretches")
    occurring = docs.select(blank("lang"), blank("source")).groupBy("lang", "source").agg(F.count("*").alias("documents"))
    counted = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = merged.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    groups = occurring.select("lang", "source").join(counted, ["lang", "source"], "left").join(langs, "lang", "left")
    smooth = 5 * F.coalesce("kept", F.lit(0))
    groups = cut(groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + smooth).alias("size"), (F.coalesce("all", F.lit(0)) + smooth).alias("whole")), "groups")
    stretches = merged.select("stretch", "lang").distinct()
    beside = groups.filter("whole > 0").join(stretches, "lang").select(F.col("lang").alias("of"), F.col("stretch").alias("at"), "source", "size", "whole")
    parts = cut(merged.groupBy("lang", "stretch").cogroup(beside.groupBy("of", "at")).applyInArrow(_walked(top), PART), "parts")
    sums = cut(parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "sums")
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").filter("source <> item").withColumn("part", F.lit("pair"))
    pairs = pairs.join(sums, ["lang", "source", "part", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    columns = ["lang", "source", "part", "item", "value"]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda x: x.select(*columns).withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(parts.filter("part = 'term'")).filter(F.col("rank") <= top))

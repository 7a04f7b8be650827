"""Phrase collocations by hierarchical pair naming.

Words that are frequent in their language get ids. Then, level by level, two adjacent (k-1)-grams that overlap in all but their
ends are a pair of ids; pairs that are frequent over all documents get an id of their own through a join, and the ids replace the
pairs in the text. A name keeps the two ids it was made from, so parts of a phrase are found by following these parents, and
phrases that hold another are found by reading them backwards: no phrase is ever counted again.

Texts stand in blocks of about two million words of one language, each a row that holds its words as numbers; for the first level,
beside a row for each of its distinct words with a count. Further levels write the numbers and their names alone: each block's
distinct pairs are made from these whenever they are asked for. They are dealt once, by pair, with their block and count; what
is frequent gets a name there, which goes back to the blocks that the rows came from, and nothing is joined. A text is never shuffled
by its pairs, so a hot word or phrase is a row a block at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_rows, cut, forget
from .kernels import LOWER, Texts, column, pieces
from .spans import byte_class, spans, word_numbers

#: Words of a block. A text that has more is a block of its own.
BLOCK = 1 << 21
#: Rows of pairs that go to Spark at once.
PAIR_ROWS = 1 << 17
#: How often a phrase stands at least, its words at most, the share (in hundredths) of it in a longer one that drops it.
LEAST, LONGEST, INSIDE = 30, 4, 80

ENDS = byte_class([(ord(c), ord(c)) for c in ".,;:!?"] + [(0x0A, 0x0D)])
GAPS = byte_class([(0x20, 0x20), (0x09, 0x09)])

#: A block's row with its stream, and the rows of its words, numbered; a block's stream of later levels, with the names of its numbers;
#: the distinct pairs of such a stream, numbered.
FIRST = "block long, lang string, total long, stream binary, num int, word string, n long"
LATER = "block long, stream binary, ids binary"
PAIRS = "block long, num int, u long, v long, n long"


def _streams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of the words of all rows: row, whether a piece begins there, number; and the distinct words."""
    ends = ENDS[data]
    solid = ~(ends | GAPS[data])
    start, end, row = spans(solid, offs)
    cuts = np.append(0, np.cumsum(ends))
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (cuts[start[1:]] > cuts[end[:-1]]) | (row[1:] != row[:-1])
    return row, fresh, *word_numbers(data, solid, start, end)


class _Block:
    """Words of one language, gathered until they fill a block."""

    def __init__(self) -> None:
        self.size, self.parts = 0, []

    def add(self, numbers: np.ndarray, fresh: np.ndarray, words: pa.Array) -> None:
        used, local = np.unique(numbers, return_inverse=True)
        self.parts.append((local, fresh, words.take(pa.array(used))))
        self.size += len(numbers)

    def rows(self, block: int, lang: str) -> pa.RecordBatch:
        """-1 stands before each piece; the other numbers are those of the words."""
        coded = pa.chunked_array([w for *_, w in self.parts]).combine_chunks().dictionary_encode()
        places, begin, out = np.asarray(coded.indices), 0, []
        for local, fresh, words in self.parts:
            at = np.arange(len(local)) + np.cumsum(fresh)
            stream = np.full(len(local) + int(fresh.sum()), -1, dtype=np.int32)
            stream[at] = places[begin : begin + len(words)][local]
            out.append(stream)
            begin += len(words)
        stream, words = np.concatenate(out), coded.dictionary.cast(pa.string())
        n = np.bincount(stream[stream >= 0], minlength=len(words))
        head = [pa.array([block]), pa.array([lang], pa.string()), pa.array([self.size]), pa.array([stream.tobytes()], pa.binary())]
        tail = [pa.array(np.arange(len(words), dtype=np.int32)), words, pa.array(n)]
        return _flat(head, tail, ["block", "lang", "total", "stream", "num", "word", "n"], shared=2)


def _flat(head: list[pa.Array], tail: list[pa.Array], names: list[str], shared: int) -> pa.RecordBatch:
    """One row of head, then the rows of tail; the first `shared` columns of head stand in all rows, the others are null there."""
    more, out = len(tail[0]), []
    for k, x in enumerate(head):
        below = pa.array(np.zeros(more, dtype=np.int64))
        out.append(pa.concat_arrays([x, x.take(below) if k < shared else pa.nulls(more, x.type)]))
    out += [pa.concat_arrays([pa.nulls(1, x.type), x]) for x in tail]
    return pa.RecordBatch.from_arrays(out, names=names)


def _blocks(batches):
    """Record batches of (lang, text) to blocks, numbered within the partition."""
    base, made, open_blocks = TaskContext.get().partitionId() << 32, 0, {}
    for piece in pieces(batches, "text"):
        texts = Texts(column(piece, "text"))
        row, fresh, numbers, words = _streams(LOWER[texts.data], texts.offs)
        langs = pc.dictionary_encode(column(piece, "lang"))
        of_word = np.asarray(langs.indices)[row]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            mine = of_word == k
            if mine.any():
                block = open_blocks.setdefault(lang, _Block())
                block.add(numbers[mine], fresh[mine], words)
                if block.size >= BLOCK:
                    yield open_blocks.pop(lang).rows(base + made, lang)
                    made += 1
    for lang, block in open_blocks.items():
        yield block.rows(base + made, lang)
        made += 1


def _paired(stream: np.ndarray, num: np.ndarray, ids: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stream of pairs of a stream whose number num[i] is named ids[i] (others have no name): the new stream, and of
    each distinct pair both ids and its count. The pair at a place is of the names there and at the next place."""
    local = np.full(int(stream.max(initial=-1)) + 2, -1, dtype=np.int64)  # the last entry stands for -1
    local[num] = np.arange(len(num))
    x = local[stream]
    both = (x[:-1] >= 0) & (x[1:] >= 0)
    pairs, out = x[:-1][both] * len(num) + x[1:][both], np.zeros(0, dtype=np.int32)
    del x
    if last:
        distinct, n = np.unique(pairs, return_counts=True)
    else:
        distinct, at, n = np.unique(pairs, return_inverse=True, return_counts=True)
        y = np.full(len(both), -1, dtype=np.int32)
        y[both] = at
        keep = np.ones(len(y), dtype=bool)
        keep[1:] = both[1:] | both[:-1]  # one -1 parts two runs as well as many
        out = y[keep]
    return out, ids[distinct // max(len(num), 1)], ids[distinct % max(len(num), 1)], n


def _renamed(stream: np.ndarray, num: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stream with numbers of named words (pairs) only, and the name of each; one -1 parts what stands apart."""
    order = np.argsort(ids)  # so that the result does not depend on how the rows arrived
    num, ids = num[order], ids[order]
    local = np.full(int(stream.max(initial=-1)) + 2, -1, dtype=np.int32)  # the last entry stands for -1
    local[num] = np.arange(len(num), dtype=np.int32)
    x = local[stream]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] >= 0) | (x[:-1] >= 0)
    return x[keep], ids


def _pairs_of(row_stream: bytes, row_ids: bytes, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row_ids, dtype=np.int64)
    return _paired(np.frombuffer(row_stream, dtype=np.int32), np.arange(len(ids)), ids, last)


def _pair_rows(batches):
    """The distinct pairs of each block, in the order of their numbers."""
    for b in batches:
        for block, stream, ids in zip(*(column(b, c).to_pylist() for c in ("block", "stream", "ids"))):
            _, u, v, n = _pairs_of(stream, ids, True)
            for at in range(0, len(u), PAIR_ROWS):
                some = slice(at, at + PAIR_ROWS)
                num = np.arange(at, at + len(u[some]), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(num), block)), pa.array(num), *[pa.array(x[some], pa.int64()) for x in (u, v, n)]], names=["block", "num", "u", "v", "n"])


def _renaming(paired: bool):
    """A block with the names of its numbers: of its words at first, of its pairs from then on (paired)."""

    def step(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["block", "stream", "ids"], [pa.int64(), pa.binary(), pa.binary()]
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        stream = left.column("stream")[0].as_py()
        stream = _pairs_of(stream, left.column("ids")[0].as_py(), False)[0] if paired else np.frombuffer(stream, dtype=np.int32)
        num, ids = (np.asarray(right.column(c).combine_chunks()) for c in ("num", "id"))
        stream, ids = _renamed(stream, num, ids)
        return pa.table([pa.array([key[0].as_py()]), pa.array([stream.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=names)

    return step


def _named(each: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (block, num, keys, n): the names of frequent keys (id, keys, a); each block's numbers that have one (of, num, id); and
    the written table of both. Rows are dealt and sorted once; a key's name is the number of its first row."""
    same = Window.partitionBy(*keys)
    dealt = each.repartition(*keys).withColumn("row", F.monotonically_increasing_id())  # numbered after they are dealt, which takes less room
    rows = dealt.withColumn("a", F.sum("n").over(same)).filter(F.col("a") >= least)
    table = cut(rows.withColumn("id", F.min("row").over(same)).drop("n"), "named")
    return table.filter("row = id").select(*keys, "a", "id"), table.select(F.col("block").alias("of"), "num", "id"), table


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language: lang, n; the names of each level k from 1: level 1 (id, lang, word, a), others (id, u, v, a))."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    blocks = cut(rows.mapInArrow(_blocks, FIRST), "blocks")
    totals = cut(blocks.filter("total is not null and num is null").groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    names, hits, table = _named(blocks.filter("num is not null").select("block", "num", "lang", "word", "n"), ["lang", "word"], least)
    streams = blocks.filter("num is null").select("block", "stream")
    levels = []
    for k in range(2, longest + 1):
        renamed = cut(streams.groupBy("block").cogroup(hits.groupBy("of")).applyInArrow(_renaming(k > 2), LATER), "blocks")
        # Names stay without their places.
        levels.append(cut(names, "names"))
        forget(blocks, table)
        blocks = streams = renamed
        names, hits, table = _named(blocks.mapInArrow(_pair_rows, PAIRS), ["u", "v"], least)
    levels.append(cut(names, "names"))
    forget(blocks, table)
    return totals, levels


def _cuts(k: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a k-gram with parents L and R. Products are decimals: exact at any count."""
    parts = {2: [("L.a", "R.a")], 3: [("L.first", "R.a"), ("L.a", "R.last")]}.get(k) or [("L.first", "R.a"), ("L.left", "R.right"), ("L.a", "R.last")]
    score = "(cast(2000000 as decimal(7, 0)) * cast(x.a as decimal(20, 0))) div (cast({0} as decimal(20, 0)) + cast({1} as decimal(20, 0)))"
    return F.array_min(F.array(*[F.struct(F.expr(score.format(l, r)).alias("score"), F.lit(i).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for i, (l, r) in enumerate(parts, 1)]))


def scored_phrases(levels: list[DataFrame]) -> DataFrame:
    """Every candidate: lang, phrase, id, k, a, l, r, score, inside (the count of the most frequent phrase one word longer that
    holds it; any longer one is as frequent at most). At most four words."""
    if len(levels) > 4:
        raise ValueError("cuts are looked up for phrases of up to four words")
    first = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "a", F.col("a").alias("first"), F.col("a").alias("last"), F.col("a").alias("left"), F.col("a").alias("right"))
    out, parents = None, first
    for k, names in enumerate(levels[1:], 2):
        x, left, right = names.alias("x"), parents.alias("L"), parents.alias("R")
        mine = x.join(left, F.col("x.u") == F.col("L.id")).join(right, F.col("x.v") == F.col("R.id"))
        mine = mine.select(
            "x.id", "L.lang", F.concat_ws(" ", "L.phrase", "R.tail").alias("phrase"), "R.tail", "x.a", "L.first", "R.last",
            F.col("L.a").alias("left"), F.col("R.a").alias("right"), _cuts(k).alias("cut"),
        )
        mine = cut(mine, f"phrases{k}")
        if k < len(levels):
            above = levels[k].select(F.explode(F.array("u", "v")).alias("id"), F.col("a").alias("c")).groupBy("id").agg(F.max("c").alias("inside"))
            found = mine.join(above, "id", "left")
        else:
            found = mine.withColumn("inside", F.lit(None).cast("long"))
        found = found.select("lang", "phrase", "id", F.lit(k).alias("k"), "a", "cut.l", "cut.r", "cut.score", "inside")
        out, parents = found if out is None else out.unionByName(found), mine
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is `und` and falls together with a language of that name; rows count as often as they
    are repeated, ids and further columns play no part, whatever their names. Ties go to more occurrences, then to the
    smaller phrase in the order of its UTF-8 bytes. Empty tables and texts without frequent phrases give no rows. Very long texts
    are read whole, as blocks of their own."""
    totals, levels = count_phrases(docs, least, longest)
    kept = scored_phrases(levels).filter(F.col("inside").isNull() | (100 * F.col("inside") < inside * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked within slices of a language first: no task sorts all of a hot language's phrases.
    slices = max(1, sum(x.count() for x in levels[1:]) // 100_000)
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

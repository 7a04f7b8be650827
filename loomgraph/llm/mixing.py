"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream of its documents in permuted order, cut into blocks of `block_words` words; a further round of the
stream begins where the target exceeds the source. The target fixes the source's exact quota: all blocks of its full rounds
and, of the last one, the first blocks of a permutation of them, the last of these in part. The blocks drawn are split among
the output shards by a binary tree: each node hands its left half a multivariate-hypergeometric draw of its blocks, so that
shards are filled as by drawing blocks blindly without return. A source's drawn blocks are permuted once more, each shard
takes the next run of them, as long as the tree says, and orders what it has by a hash of document and block. A word is taken
if its block falls in a shard's run, and nowhere else is that decided.

Positions in a permuted stream come from a radix tree over the permutation's hash: sums of each prefix, then running sums
among at most 256 siblings. No window holds a whole source.
"""

from __future__ import annotations

from hashlib import md5
from math import ceil, gcd, log, sqrt
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .frames import arrow_rows, cut
from .kernels import Texts, Words, column, pieces

# The weights, repeating by source, the share of all words, and the most repeats.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED, CHUNK_SOURCES = 4096, 1 << 20, "mix-1", 1000
#: Blocks of a mix at most, as draws take numbers under 10**9: blocks of very large mixes are longer instead.
MOST_BLOCKS = 1 << 28


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the further column size: its words."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("size", LongType())])

    def run(batches):
        for b in pieces(batches, text_col):
            words = Words(Texts(column(b, text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words.count.astype(np.int64))], names=[*names, "size"])

    return docs.mapInArrow(run, schema)


def ranked(sources: DataFrame) -> DataFrame:
    """sources with sid from 0, by code point, null last: ranges are counted first, then numbered apart."""
    order = F.asc_nulls_last("source")
    parts = max(1, sources.count() // 100_000)
    t = cut(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranges")
    before = t.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    own = t.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    return own.join(F.broadcast(before.select("part", "before")), "part").withColumn("sid", F.col("before") + F.col("r") - 1).drop("part", "before", "r")


def water_fill(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """sources (sid, source_size) with target: shares by weight, none above `repeats` times its source's size.

    Each pass holds at their cap the sources that the level so far lifts above it; one aggregation a pass."""
    table = sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    table = cut(table.withColumn("cap", repeats * F.col("source_size").cast("double")), "caps")
    total = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        capped = F.col("cap") < F.col("w") * F.lit(level)
        n, cap, w = table.agg(
            F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0))
        ).first()
        if n == held or w == 0:
            break
        held, level = n, (total - cap) / w
    over = F.col("cap") < F.col("w") * F.lit(level)
    return table.withColumn("target", F.when(over, F.col("cap")).otherwise(F.col("w") * F.lit(level))).drop("w", "cap")


def split_tree(quotas: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, blocks) of a table with row sums `quotas` and column sums `room`, drawn by halving the columns: each
    left half takes a multivariate-hypergeometric draw of the node's blocks. Rows without blocks leave a node's work."""
    upto = np.append(0, np.cumsum(room))
    rows = np.flatnonzero(quotas)
    out, stack = [], [(rows, quotas[rows], 0, len(room))]
    while stack:
        rows, have, a, b = stack.pop()
        if not len(rows):
            continue
        if b - a == 1:
            out.append((rows, np.full(len(rows), a), have))
            continue
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(have, int(upto[mid] - upto[a]), method="marginals")
        for some, lo, hi in ((have - left, mid, b), (left, a, mid)):
            at = np.flatnonzero(some)
            stack.append((rows[at], some[at], lo, hi))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _affine(seed: str, use: str, source: str | None, n: int) -> tuple[int, int]:
    """(step, shift) of the permutation i -> (i * step + shift) % n of a source's blocks, from md5."""
    number = lambda what: int(md5(f"{seed}|{use}-{what}|{source or ''}".encode()).hexdigest()[:7], 16)
    if n < 2:
        return 1, 0
    step = 1 + number("step") % n
    while gcd(step, n) > 1:
        step += 1
    return step, number("shift") % n


def drawn(sources: DataFrame, block_words: int, seed: str) -> DataFrame:
    """sources (sid, source, source_size, target) with what they give: rounds, rest (words of the last, partial round),
    blocks of a round, drawn blocks in all, and the permutation of a round's blocks."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in sources.schema)}, rounds long, rest long, blocks long, drawn long, step long, shift long, deal_step long, deal_shift long"

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for source, size, target in zip(pdf["source"], pdf["source_size"].tolist(), pdf["target"].tolist()):
                words = int(target + 0.5)
                rounds, rest = divmod(words, size) if size else (0, 0)
                blocks = -(-size // block_words)
                step, shift = _affine(seed, "block", source, blocks)
                # Blocks of the partial round, the short last one of the stream among them or not.
                some, last = -(-rest // block_words), size - (blocks - 1) * block_words
                place = ((blocks - 1) * step + shift) % max(blocks, 1)
                if rest and place < some and rest > some * block_words - (block_words - last):
                    some += 1
                n = rounds * blocks + some
                out.append((rounds, rest, blocks, n, step, shift, *_affine(seed, "deal", source, n)))
            names = ("rounds", "rest", "blocks", "drawn", "step", "shift", "deal_step", "deal_shift")
            yield pdf.assign(**dict(zip(names, np.array(out, dtype=np.int64).reshape(-1, len(names)).T)))

    return sources.mapInPandas(run, schema)


def deal(sources: DataFrame, block_words: int, shards: int | None, shard_words: int, seed: str) -> DataFrame:
    """sources with runs: by groups of shards, how many of the source's permuted drawn blocks go to each.

    The tree has two tiers, groups of shards and shards, of about the square root of all shards each. The upper one is drawn
    over chunks of sources on the driver, then over each chunk's sources where they are; the lower one group by group."""
    t = cut(drawn(sources, block_words, seed).withColumn("chunk", (F.col("sid") / CHUNK_SOURCES).cast("long")), "quotas")
    chunks = sorted((r.chunk, r.n) for r in t.groupBy("chunk").agg(F.sum("drawn").alias("n")).collect())  # a row for 1000 sources
    total = sum(n for _, n in chunks)
    shards = shards or max(1, round(total * block_words / shard_words))
    fan = ceil(sqrt(shards))
    begin = lambda s: s * (total // shards) + min(s, total % shards)  # noqa: E731  # shards differ by one block at most
    room = np.diff([begin(min(g, shards)) for g in range(0, shards + fan, fan)])
    number = crc32(seed.encode())
    given: dict[int, np.ndarray] = {c: np.zeros(len(room), dtype=np.int64) for c, _ in chunks}
    for row, col, n in zip(*split_tree(np.array([n for _, n in chunks], dtype=np.int64), room, np.random.default_rng([number, 0]))):
        given[chunks[row][0]][col] = n

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        chunk = int(pdf["chunk"].iloc[0])
        row, col, n = split_tree(pdf["drawn"].to_numpy(np.int64), given[chunk], np.random.default_rng([number, 1, chunk]))
        return pd.DataFrame({"sid": pdf["sid"].to_numpy()[row], "grp": col, "n": n})

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        grp = int(pdf["grp"].iloc[0])
        first = grp * fan
        mine = np.diff([begin(s) for s in range(first, min(first + fan, shards) + 1)])
        row, col, n = split_tree(pdf["n"].to_numpy(np.int64), mine, np.random.default_rng([number, 2, grp]))
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], n[order]
        cuts = np.searchsorted(row, np.arange(len(pdf) + 1))
        upto = [np.cumsum(n[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame({"sid": pdf["sid"], "grp": grp, "n": pdf["n"], "shards": [first + col[a:b] for a, b in zip(cuts[:-1], cuts[1:])], "upto": upto})

    tiers = t.groupBy("chunk").applyInPandas(upper, "sid long, grp long, n long")
    tiers = tiers.groupBy("grp").applyInPandas(lower, "sid long, grp long, n long, shards array<long>, upto array<long>")
    # At most as many shards as the source has blocks, or as there are.
    runs = tiers.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("grp", "n", "shards", "upto"))).alias("runs"))
    runs = runs.withColumn("ends", F.aggregate("runs", F.expr("array(0L)"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"]))))
    return t.drop("chunk").join(runs, "sid", "left")


def _order(seed: str):
    """The permutation: documents of a source follow each other by this hash of their id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = (),
    block_words: int = BLOCK_WORDS, shards: int | None = None, shard_words: int = SHARD_WORDS, seed: str = SEED,
    share: float = SHARE, repeats: int = REPEATS,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, and the columns named in carry.

    copies is an array of (epoch, block, first, words, shard, slot): each block by which the mix takes words of the document,
    which they are, and where they go; slot orders a shard. Documents are taken in part only where a block ends or the quota
    does. Sources weigh 3, 1, 2 by code point, null last, and share `share` times all words; none exceeds `repeats` times its
    own, and the excess goes to the others by weight.

    Null or empty texts have size 0 and no copies. Null ids are permuted by their texts. Rows equal in id and text follow each
    other in their stream, and each is taken at most `repeats` times. Empty tables give an empty result. Columns that are not
    named are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    kept = [docs[c].alias(f"carry_{c}") for c in carry if c != text_col]
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"), *kept)
    sized = word_counts(src)
    sized = sized.withColumn("h", _order(seed))
    sized = sized.withColumnRenamed("text", f"carry_{text_col}") if text_col in carry else sized.drop("text")
    if not carry:
        sized = cut(sized, "sizes")
    slim = sized.select("source", "size", "h") if not carry else cut(sized.select("source", "size", "h"), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ids = cut(ranked(totals), "sources")
    n = ids.agg(F.sum("n")).first()[0] or 0
    words = share * (ids.agg(F.sum("source_size")).first()[0] or 0)
    block_words = max(block_words, ceil(words / MOST_BLOCKS))
    quotas = cut(deal(water_fill(ids.drop("n"), share, repeats), block_words, shards, shard_words, seed), "shards")
    depth = ceil(log(max(1.0, n / 1000), 256))
    leaf = F.substring("h", 1, 2 * depth).alias("p")
    named = ids.select(F.col("source").alias("s"), "sid")

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    placed = numbered(sized).select("*", leaf)
    # Running sums among siblings of the radix tree, level by level.
    sums = cut(numbered(slim.groupBy("source", leaf).agg(F.sum("size").alias("size"))).select("sid", "p", "size"), "prefixes") if depth else None
    start = F.sum("size").over(Window.partitionBy("sid", "p").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("at", F.coalesce(start, F.lit(0)))
    if depth:
        offsets = sums.select("sid", "p").withColumn("off", F.lit(0).cast("long"))
        for d in range(1, depth + 1):
            level = sums.groupBy("sid", F.substring("p", 1, 2 * d).alias("q")).agg(F.sum("size").alias("size"))
            before = F.sum("size").over(Window.partitionBy("sid", F.substring("q", 1, 2 * d - 2)).orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
            level = level.select("sid", "q", F.coalesce(before, F.lit(0)).alias("b"))
            offsets = offsets.withColumn("q", F.substring("p", 1, 2 * d)).join(level, ["sid", "q"]).withColumn("off", F.col("off") + F.col("b")).drop("b", "q")
        placed = placed.join(cut(offsets, "offsets"), ["sid", "p"]).withColumn("at", F.col("at") + F.col("off"))
    placed = placed.join(quotas.drop("source"), "sid")
    begin, end = F.col("at"), F.col("at") + F.col("size")
    last = F.col("blocks") - 1
    one = F.greatest(F.col("blocks"), F.lit(1))
    short = F.lit(block_words) - (F.col("source_size") - last * block_words)

    def taken(epoch: int):
        def of_block(block):
            rank = F.pmod(block * F.col("step") + F.col("shift"), one)
            low, high = F.greatest(begin, block * block_words), F.least(end, (block + 1) * block_words)
            before = rank * block_words - F.when(F.pmod(last * F.col("step") + F.col("shift"), one) < rank, short).otherwise(0)
            size = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
            gives = F.when(F.lit(epoch) < F.col("rounds"), size).when(F.lit(epoch) == F.col("rounds"), F.greatest(F.least(F.col("rest") - before, size), F.lit(0))).otherwise(0)
            words = F.greatest(F.least(block * block_words + gives, high) - low, F.lit(0))
            # The place among the drawn blocks after their second permutation, then the group and the shard whose run it is in.
            spot = F.pmod((epoch * F.col("blocks") + rank) * F.col("deal_step") + F.col("deal_shift"), F.greatest(F.col("drawn"), F.lit(1)))
            group = F.size(F.filter("ends", lambda e: e <= spot))
            run = F.try_element_at(F.col("runs"), group)
            inner = spot - F.try_element_at(F.col("ends"), group)
            shard = F.try_element_at(run["shards"], F.size(F.filter(run["upto"], lambda u: u <= inner)) + 1)
            slot = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.lit(str(epoch)), block.cast("string")).cast("binary"))
            return F.struct(F.lit(epoch).alias("epoch"), block.alias("block"), (low - begin).alias("first"), words.alias("words"), shard.alias("shard"), slot.alias("slot"))

        return F.transform(F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words)), of_block)

    copies = F.filter(F.concat(*map(taken, range(repeats))), lambda c: (c["words"] > 0) & c["shard"].isNotNull())
    none = F.expr("array()").cast("array<struct<epoch:int,block:bigint,first:bigint,words:bigint,shard:bigint,slot:string>>")
    copies = F.when(F.col("size") > 0, copies).otherwise(none)
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def shuffled(mixed: DataFrame) -> DataFrame:
    """doc_id, lang, source, text, n_chars, shard, slot: the documents of a mix that carries these columns, one
    row for each part that a block gives, dealt to the shards: each shard lies whole in one partition, in the order of its
    slots. Shards are of equal size, so none is hot. A part keeps the blanks before its words, the last one those after them,
    so that the parts of a document spell it; null texts and texts without words give no rows."""
    rows = mixed.select("doc_id", "size", "lang", "source", "text", "n_chars", F.inline("copies"))
    stop = F.col("first") + F.col("words")
    # Split at the ends of the first words, which keeps every character; only documents taken in part are.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (stop + 1).cast("int"))
    length = F.col("words") + F.when(stop == F.col("size"), 1).otherwise(0)
    rows = rows.withColumn("part", F.when(F.col("words") < F.col("size"), F.array_join(F.slice(parts, (F.col("first") + 1).cast("int"), length.cast("int")), "")))
    text, chars = F.coalesce("part", "text"), F.when(F.col("part").isNull(), F.col("n_chars").cast("long")).otherwise(F.length("part").cast("long"))
    return rows.select("doc_id", "lang", "source", text.alias("text"), chars.alias("n_chars"), "shard", "slot").repartition("shard").sortWithinPartitions("shard", "slot")

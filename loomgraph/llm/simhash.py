"""SimHash near-duplicates with the generalised pigeonhole principle.

The 64 fingerprint bits are grouped by correlation into parts. With thresholds t_i (-1, 0, 1, ..)
that sum to radius - parts + 1, two fingerprints within the radius differ in at most t_i bits in
some part i. A dynamic program gives each part its threshold so that probes and estimated
candidates cost least, for one to four parts; each fingerprint probes every value within t_i of
its own in part i, and candidates are verified on all bits. Then links become components.

A part value that more than `bucket_cap` fingerprints hold is not compared pair by pair: two
fingerprints within two bits have a common neighbour within one, so all that probe it are grouped
by their 65 neighbours instead. That is as exact and linear in the fingerprints.

Tables that grow with the corpus are joined by merging, at every size: none of them is sent to the driver as a broadcast.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .frames import arrow_rows, cut, release, written
from .kernels import Texts, Words, column, normalised, pieces

BITS, RADIUS, SHINGLE, SEED, BUCKET_CAP = 64, 2, 3, 42, 256


def fingerprints(raw: bytes, start: np.ndarray, end: np.ndarray, ptr: np.ndarray, k: int, seed: int) -> np.ndarray:
    """SimHash of each row from normalised bytes and word spans; zero for rows without words."""
    count = np.diff(ptr)
    row = np.repeat(np.arange(len(count)), count)
    i = np.arange(len(start))
    short = (count < k)[row] if len(row) else np.zeros(0, bool)
    take = np.where(short, i == ptr[:-1][row], i + k <= ptr[1:][row]) if len(row) else short
    first = np.flatnonzero(take)
    last = np.where(short[first], ptr[1:][row[first]] - 1, first + k - 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist())], dtype=np.uint64)
    n = np.bincount(row[first], minlength=len(count))
    out = np.zeros(len(count), dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = (np.cumsum(n) - n)[full]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n[full][:, None], axis=1)
        out[full] = packed.reshape(-1, 8).copy().view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint(k: int, seed: int):
    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            texts = Texts(column(b, "text"))
            words = Words(texts)
            out, _, start, end = normalised(texts, words, lower=True)
            fp = fingerprints(out.tobytes(), start, end, words.ptr, k, seed)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def _bit_counts(batches):
    """Per task: how often bits i and j are both one, and the number of fingerprints as (-1, -1)."""
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        h = np.asarray(column(b, "fp")).view(np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
        total += bits.T @ bits
        n += len(h)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))],
        names=["i", "j", "c"],
    )


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of equal size (or one more), correlated bits together.

    Each group starts from the free bit that is least correlated with the others and takes the
    free bits most correlated with it; bit 0 is the lowest."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for g in range(parts):
        size = len(free) // (parts - g)
        mine = [min(free, key=lambda b: (corr[b][free].sum(), b))]
        free.remove(mine[0])
        while len(mine) < size:
            nxt = max(free, key=lambda b: (corr[b][mine].mean(), -b))
            mine.append(nxt)
            free.remove(nxt)
        groups.append(sorted(mine))
    return groups


def allocate(widths_p: list[np.ndarray], n: int, radius: int) -> tuple[float, list[int]]:
    """(cost of a fingerprint, thresholds) that cost least: probes plus estimated candidates.

    widths_p holds each part's probabilities that a bit of two fingerprints differs; a part with
    threshold t costs its number of probe values and n times the chance of t differing bits or fewer."""
    cost = []
    for p in widths_p:
        dist = np.zeros(radius + 2)
        dist[0] = 1
        for q in p:
            dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
            dist[0] *= 1 - q
        probes = np.cumsum([comb(len(p), t) for t in range(radius + 1)])
        cost.append([0.0] + [float(probes[t] + 0.2 * n * dist[: t + 1].sum()) for t in range(radius + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, ts) in best.items():
            for give in range(radius + 2 - used):
                new = (so_far + c[give], [*ts, give - 1])
                if used + give not in nxt or new < nxt[used + give]:
                    nxt[used + give] = new
        best = nxt
    return best[radius + 1]


def plan_parts(both: np.ndarray, n: int, radius: int = RADIUS, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    options = []
    for parts in range(1, most_parts + 1):
        groups = group_bits(both, n, parts)
        cost, ts = allocate([differ[g] for g in groups], n, radius)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(options)[2]


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks with up to `most` of the bits set, as signed longs."""
    out = [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(bits, k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _longs(values: list[int]):
    return F.from_json(F.lit(str(values)), "array<bigint>")


def near_pairs(uniq: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """a, b: links between distinct fingerprints `fp`. All pairs within the radius, but within two bits those that meet only
    in a part value held by more than bucket_cap fingerprints are linked through a common third."""
    whole = [sum(1 << b for b in bits) for bits, _ in plan]
    whole = [m - (1 << 64) if m >= 1 << 63 else m for m in whole]
    fp = F.col("fp")
    held = F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(whole)])
    data = uniq.select(fp, F.inline(held))

    def probe(i: int, mask: int, flips: list[int]):
        own = fp.bitwiseAND(F.lit(mask))
        return F.transform(_longs(flips), lambda f: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(f).alias("key")))

    probes = [probe(i, m, _flips(bits, t)) for i, ((bits, t), m) in enumerate(zip(plan, whole))]
    asked = uniq.select(fp, F.inline(F.concat(*probes)))
    on = ["part", "key"]
    crowded = cut(data.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > bucket_cap).select(*on), "crowded") if radius <= 2 else None
    if crowded is not None and crowded.limit(1).count():
        hot = asked.join(crowded, on).select("fp").distinct()
        data = data.join(crowded, on, "left_anti")
    else:
        hot = None
    d, q = data.select("part", "key", F.col("fp").alias("a")), asked.select("part", "key", F.col("fp").alias("b"))
    pairs = d.join(q.hint("merge"), on).filter(F.col("a") < F.col("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    if hot is not None:
        near = F.transform(_longs(_flips(list(range(BITS)), 1)), lambda f: fp.bitwiseXOR(f))
        hubs = hot.select(fp, F.explode(near).alias("hub")).groupBy("hub").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
        pairs = pairs.unionByName(hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b"))
    return pairs


def rooted_fingerprints(uniq: DataFrame, radius: int, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """uniq (distinct fp, further columns) with root: the smallest fingerprint reachable by links of up to `radius` bits."""
    counts = uniq.select("fp").mapInArrow(_bit_counts, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in counts:  # 4097 rows at any size
        if r.i < 0:
            n = r.c
        else:
            both[r.i, r.j] = r.c
    roots = connected_components(near_pairs(uniq.select("fp"), plan_parts(both, n, radius), radius, bucket_cap))
    return cut(uniq.join(roots.hint("merge"), uniq["fp"] == roots["node"], "left").select(uniq["*"], F.coalesce("root", "fp").alias("root")), "roots")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, bucket_cap: int = BUCKET_CAP,
) -> DataFrame:
    """doc_id, fp (long), component_id: one row per input row.

    Texts are lower-cased in A-Z; shingles of `shingle` words, repeats included, are hashed by
    XXH64; texts with fewer words are one shingle, texts without words have fingerprint zero and
    are linked like any other. Fingerprints within two bits link; component_id is the smallest id
    reachable. Null texts have no words. Rows with a null id get their component's id but never
    name one (null only if a component has no id at all). Repeated rows share a component. Empty
    tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    fps = cut(src.mapInArrow(_fingerprint(shingle, seed), "doc_id long, fp long"), "fps")
    uniq = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "uniq")
    rooted = rooted_fingerprints(uniq, RADIUS, bucket_cap)
    names = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = cut(rooted.join(names.hint("merge"), "root").select("fp", "component_id"), "names")
    return fps.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: Near copies: words of a shingle of their fingerprints and of their similarity, least similarity; of each pass the radius and the
#: seed of its fingerprints. Fingerprints of several seeds miss different pairs.
SKETCH_WORDS, SIMILAR_WORDS, SIMILARITY, PASSES = 2, 5, 0.8, ((2, SEED), (6, SEED), (6, SEED + 1))


def _shingles(text: str, k: int) -> set[int]:
    """Hashes of a text's runs of k words in lower case (A-Z); of all its words if they are fewer."""
    texts = Texts(pa.array([text]))
    words = Words(texts)
    raw, _, start, end = normalised(texts, words, lower=True)
    raw, n = raw.tobytes(), len(start)
    if not n:
        return set()
    spans = zip(start[: max(1, n - k + 1)].tolist(), end[min(k, n) - 1 :].tolist())
    return {xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans}


#: Texts that may become leaders of a group in a round, their characters together (the first counts always), and members
#: of a group that are compared in one stretch.
LEADERS, LEADER_CHARS, STRETCH = 32, 4 << 20, 4096


def _like(a: set[int], b: set[int], least: float) -> bool:
    return len(a & b) >= least * len(a | b)


def _compare(k: int, least: float):
    """Rows sorted by stretch, a stretch's possible leaders first: for each member the first leader that it is like, if any.
    A possible leader that is like an earlier one leads nothing."""

    def run(batches):
        stretch, leaders = None, []
        for b in pieces(batches, "text"):
            out = []
            names = ("root", "salt", "member", "t", "doc", "text")
            for root, salt, member, t, doc, text in zip(*(column(b, c).to_pylist() for c in names)):
                if (root, salt) != stretch:
                    stretch, leaders = (root, salt), []
                mine = _shingles(text, k)
                found = next(((lt, d) for lt, d, theirs in leaders if _like(mine, theirs, least)), None)
                if member:
                    out.append((t, *(found or (None, None))))
                elif found is None:
                    leaders.append((t, doc, mine))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["t", "leader_t", "leader"])

    return run


def _led(src: DataFrame, members: DataFrame, k: int, least: float) -> DataFrame:
    """t, leader_t, leader of the texts in groups of several (members: root, t, doc).

    In rounds: the undecided texts of least id in each group are its possible leaders, in that order; a text like an earlier
    leader is led by it, the others of them lead, and so does each all other members that are like it and none before.
    A group's members are dealt to stretches of bounded size, each with the possible leaders before it."""
    several = members.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    members = cut(members.join(several.hint("merge"), "root"), "members")
    texts = src.join(members.select("t", F.col("doc").alias("doc_id"), "root").hint("merge"), ["t", "doc_id"]).dropDuplicates(["t"])
    left = cut(texts.select("root", "t", F.col("doc_id").alias("doc"), "text"), "undecided")
    out = []
    while left.limit(1).count():
        order = Window.partitionBy("root").orderBy("doc", "t")
        first = left.select("root", "doc", "t", F.length("text").alias("size")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS)
        first = first.withColumn("before", F.sum("size").over(order) - F.col("size")).filter((F.col("before") <= LEADER_CHARS) | (F.col("rank") == 1))
        parts = left.groupBy("root").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("parts"))
        rows = left.join(parts.hint("merge"), "root")
        member = rows.select("root", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("member"), "t", "doc", "text")
        lead = rows.join(first.select("root", "t").hint("merge"), ["root", "t"], "left_semi")
        lead = lead.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("member"), "t", "doc", "text")
        dealt = member.unionByName(lead).repartition("root", "salt").sortWithinPartitions("root", "salt", "member", "doc", "t")
        told = cut(dealt.mapInArrow(_compare(k, least), "t string, leader_t string, leader long"), "compared")
        out.append(told.filter("leader_t is not null"))
        left = cut(left.join(told.filter("leader_t is null").select("t").hint("merge"), "t", "left_semi"), "undecided")
    decided = out[0] if out else members.select("t", F.col("t").alias("leader_t"), F.col("doc").alias("leader")).limit(0)
    for more in out[1:]:
        decided = decided.unionByName(more)
    return decided


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SIMILAR_WORDS,
    sketch_words: int = SKETCH_WORDS, passes: tuple[tuple[int, int], ...] = PASSES,
) -> DataFrame:
    """doc_id, t (md5 of the text), leader: one row per input row with an id; leader is the id of the document that stands for it.

    A document is only given a leader whose shingles of `words` words are like its own (Jaccard) to `similarity` or more;
    equal texts are led by the least id. Candidates come from fingerprints of shingles of `sketch_words` words, which few
    changed words move less: the first of the passes (radius, seed) takes links of few bits, where families of any size are found in linear
    time, each further pass the leaders that are left, a wider radius or fingerprints of another seed. Of the texts of a component, the one of least id leads
    all that are like it, then the least of the others, until each has a leader.

    Null texts count as empty; texts without words are like each other and like no others. Rows without an id take no part.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).filter("doc_id is not null").withColumn("t", F.md5(F.col("text").cast("binary")))
    ids = cut(src.select("doc_id", "t"), "ids")
    left = cut(ids.groupBy("t").agg(F.min("doc_id").alias("doc")), "texts")
    leads, sketches = left.select("t", F.col("t").alias("leader_t"), F.col("doc").alias("leader")), {}
    for radius, seed in passes:
        since = written()
        if seed not in sketches:
            made = src.select(F.col("t").alias("doc_id"), "text").mapInArrow(_fingerprint(sketch_words, seed), "doc_id string, fp long")
            sketches[seed] = cut(made.select(F.col("doc_id").alias("t"), "fp").distinct(), "sketches")
        known = cut(left.join(sketches[seed].hint("merge"), "t"), "sketched")
        rooted = rooted_fingerprints(known.select("fp").distinct(), radius)
        found = cut(_led(src, known.join(rooted.hint("merge"), "fp").select("root", "t", "doc"), words, similarity), "led")
        moved = found.filter("t <> leader_t").select(F.col("t").alias("leader_t"), F.col("leader_t").alias("next_t"), F.col("leader").alias("next"))
        leads = leads.join(moved.hint("merge"), "leader_t", "left").select("t", F.coalesce("next_t", "leader_t").alias("leader_t"), F.coalesce("next", "leader").alias("leader"))
        leads = cut(leads, "leads")
        left = cut(left.join(moved.select(F.col("leader_t").alias("t")).hint("merge"), "t", "left_anti"), "texts")
        # What a pass wrote on its way is read by nothing any more.
        release(spark, since, keep=(leads, left, *sketches.values()))
    return ids.join(leads.select("t", "leader").hint("merge"), "t").select("doc_id", "t", "leader")

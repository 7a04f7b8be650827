"""Entity linking across documents: which mentions, spelled in many ways, are of one entity.

Mentions with equal spelling and equal surroundings fall together first, so that a name that a third of all mentions bear costs one
profile. Candidate pairs come from sorted neighbourhoods: profiles stand in order of a key and meet the next few; the keys are their
rarest words, their whole name, and their surroundings. Pairs are scored by what they share, weighed by its rarity, in their names and
in the graph around them, where neighbours that are mentions count by the cluster they were put in. Clusters come from
correlation clustering by pivots, which needs no number of clusters and does not chain links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.partitions import places
from ..plans.written import written

#: How many profiles follow one in a sorted neighbourhood that it is compared with.
WINDOW = 12
#: Profiles in a stretch of a sorted neighbourhood.
STRETCH = 4096
#: Of a pair's score: the share of its words, of its letters, of its neighbours; and the score from which two are one entity.
WORDS, LETTERS, AROUND, SAME = 0.55, 0.15, 0.3, 0.65
#: The share of a word's letters from which another spelling counts.
NEAR = 0.65


def name_words(name: Column) -> Column:
    """The words of a name in lower case, numbers without leading zeros, each once and sorted."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(plain, r"(?<![\p{L}\p{N}])0+(?=[0-9])", ""), " "), lambda w: w != "")))


def _weights(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(pid, column, total): each profile's items as (item, weight), a weight being the logarithm of how rare the item is."""
    each = rows.select("pid", F.explode(column).alias("item"))
    rare = each.groupBy("item").agg(F.count("*").alias("df")).select("item", F.log(F.lit(1.0 + n) / F.col("df")).alias("w"))
    return each.join(rare, "item").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("item", "w"))).alias(column))


def _neighbourhood(rows: DataFrame, keys: list[str], same: str | None, window: int) -> DataFrame:
    """(a, b): profiles within `window` places of each other in the order of the keys (and alike in the column `same`)."""
    x = places(rows, keys)
    same_columns = [same] if same else []
    ahead = x.select(F.col("pid").alias("b"), "place", *[F.col(c).alias("same") for c in same_columns])
    back = x.select(F.col("pid").alias("a"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + window)).alias("place"), *[F.col(c).alias("same") for c in same_columns])
    pairs = back.join(ahead, ["place", *(["same"] if same else [])]).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def profiles(mentions: DataFrame) -> DataFrame:
    """pid, words, around, ids counted: mentions (id, name, around) with equal words and surroundings, under their least id."""
    around = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("around", F.array().cast("array<string>")))))
    x = mentions.filter("id is not null").select("id", name_words(F.col("name")).alias("words"), around.alias("around"))
    return x.groupBy("words", "around").agg(F.min("id").alias("pid"), F.count("*").alias("n"))


def _orders(known: DataFrame) -> list[tuple[DataFrame, list[str], str | None]]:
    """The rows, keys and common column of the three neighbourhoods: by each of a profile's two rarest words, by name, by surroundings.
    Further columns of known stay."""
    heavy = F.slice(F.transform(F.array_sort("words", lambda x, y: F.when(x["w"] > y["w"], -1).when(x["w"] < y["w"], 1).when(x["item"] < y["item"], -1).otherwise(1)), lambda x: x["item"]), 1, 2)
    name = F.array_join(F.transform("words", lambda x: x["item"]), " ")
    near = F.array_join(F.transform("around", lambda x: x["item"]), " ")
    whole = known.select("pid", name.alias("name"), near.alias("near"), "words", "around")
    by_word = known.select("pid", name.alias("name"), near.alias("near"), "words", "around", F.explode(heavy).alias("word"))
    return [(by_word, ["word", "near", "name", "pid"], "word"), (whole, ["name", "near", "pid"], None), (whole, ["near", "name", "pid"], None)]


def positive(known: DataFrame, window: int = WINDOW, same: float = SAME) -> DataFrame:
    """(a, b), a before b, each once: the candidates whose score is `same` or more.

    Profiles are dealt to stretches of their order, each with the first few of the next, and scored there with those that follow
    them, so that what grows is the profiles that are sent and not the pairs."""
    found, stretch = None, max(STRETCH, window)
    for rows, keys, common in _orders(known):
        x = places(rows, keys).select("pid", "words", "around", "place", *([F.col(common).alias("common")] if common else []))
        at = F.floor(F.col("place") / stretch)
        x = x.withColumn("stretch", F.explode(F.when((F.col("place") % stretch < window) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))))
        ahead = Window.partitionBy("stretch").orderBy("place").rowsBetween(1, window)
        one = F.struct("pid", "words", "around", *(["common"] if common else []))
        x = x.withColumn("next", F.collect_list(one).over(ahead)).filter(at == F.col("stretch"))
        x = x.select(F.col("pid").alias("p"), "words", "around", *(["common"] if common else []), F.explode("next").alias("y"))
        x = x.filter("p <> y.pid" + (" and common = y.common" if common else ""))
        swap = F.col("p") > F.col("y.pid")  # the lesser is a, as in candidates
        sides = [F.when(swap == first, F.col(f"y.{c}")).otherwise(F.col(c)).alias(f"{n}_{c}") for n, first in (("a", True), ("b", False)) for c in ("words", "around")]
        pairs = x.select(F.least("p", "y.pid").alias("a"), F.greatest("p", "y.pid").alias("b"), *sides)
        pairs = pairs.filter(_score() >= same).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def candidates(known: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b), a before b, each once: profiles that share one of their two rarest words, whose names are neighbours in the
    alphabet, or whose surroundings are. At most 4 * window pairs for a profile, whatever its words."""
    pairs = None
    for rows, keys, common in _orders(known):
        x = _neighbourhood(rows.drop("words", "around"), keys, common, window)
        pairs = x if pairs is None else pairs.unionByName(x)
    return pairs.distinct()


def _shared(a: str, b: str) -> Column:
    """The weight of what both arrays of (item, weight) hold, of that of what either does; 0 if both are empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["w"])
    both = total(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, total(F.array_union(a, b))), F.lit(0.0))


def _alike(a: str, b: str) -> Column:
    """The weight of the words of both arrays that the other one has, in the same letters or nearly: a word of letters counts by the
    share of its letters that need no change, from NEAR on; one with a digit only if it is the same."""
    plain = lambda w: ~w.rlike("[0-9]") & (F.length(w) >= 4)

    def best(x: Column, other: str) -> Column:
        near = lambda y: 1 - F.levenshtein(x["item"], y["item"]) / F.greatest(F.length(x["item"]), F.length(y["item"]))
        one = lambda y: F.when(x["item"] == y["item"], 1.0).when(plain(x["item"]) & plain(y["item"]) & (near(y) >= NEAR), near(y)).otherwise(0.0)
        return x["w"] * F.coalesce(F.array_max(F.transform(other, one)), F.lit(0.0))

    found = lambda c, other: F.aggregate(c, F.lit(0.0), lambda s, x: s + best(x, other))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["w"])
    return F.coalesce(F.try_divide(found(a, b) + found(b, a), total(a) + total(b)), F.lit(0.0))


def scored(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, score): 0 to 1, from words, letters and neighbours. Names without a word share nothing."""
    side = lambda c: known.select(F.col("pid").alias(c), F.col("words").alias(f"{c}_words"), F.col("around").alias(f"{c}_around"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _score().alias("score"))


def _score() -> Column:
    """The score of a row with a_words, a_around, b_words and b_around."""
    text = lambda c: F.array_join(F.transform(f"{c}_words", lambda x: x["item"]), " ")
    longest = F.greatest(F.length(text("a")), F.length(text("b")))
    letters = F.when(longest > 0, 1 - F.levenshtein(text("a"), text("b")) / longest).otherwise(0.0)
    return WORDS * _alike("a_words", "b_words") + LETTERS * letters + AROUND * _shared("a_around", "b_around")


def pivot_clusters(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """(node, cluster): correlation clustering of nodes (node) by their positive edges (a, b).

    Nodes have a random order; one that comes before all its neighbours is a pivot, takes those neighbours that no earlier pivot
    takes, and all of them leave. Rounds go on while edges are left, some log of their number. Loops, repeated and reversed edges
    change nothing; nodes without edges are clusters of their own."""
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("r"), F.col(c).alias("node"))
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left, done = written(both, "edges"), None
    while left.limit(1).count():
        first = left.groupBy("a").agg(F.min(rank("b")).alias("low"))
        pivots = first.filter(rank("a") < F.col("low")).select(F.col("a").alias("pivot"))
        own = pivots.select(F.col("pivot").alias("node"), F.col("pivot").alias("cluster"))
        taken = left.join(pivots, F.col("b") == F.col("pivot")).groupBy(F.col("a").alias("node")).agg(F.min(rank("pivot"))["node"].alias("cluster"))
        placed = written(own.unionByName(taken), "placed")
        done = placed if done is None else done.unionByName(placed)
        gone = placed.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "edges")
    if done is None:
        return nodes.select("node", F.col("node").alias("cluster")).distinct()
    return nodes.select("node").distinct().join(done, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def link_entities(mentions: DataFrame, links: DataFrame | None = None, rounds: int = 2, window: int = WINDOW, same: float = SAME) -> DataFrame:
    """(id, cluster) of mentions (id, name, around): cluster is the least id of the mentions that are taken for one entity.

    around holds what stands near a mention, as strings; links (id, other) names other mentions near it, which from the second round on
    count by their cluster. Null names have no words, null surroundings are empty, rows with a null id are left out, an id repeated
    with other words belongs to the least cluster of its rows; further columns are ignored, an empty table gives an empty result."""
    m = mentions.select("id", "name", "around")
    x = m
    for turn in range(rounds if links is not None else 1):
        if turn:
            near = links.select("id", F.col("other").alias("o")).join(out.select(F.col("id").alias("o"), "cluster"), "o")  # noqa: F821
            extra = near.groupBy("id").agg(F.collect_set(F.concat(F.lit("cluster:"), F.col("cluster").cast("string"))).alias("more"))
            x = m.join(extra, "id", "left").select("id", "name", F.concat(F.coalesce("around", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("around"))
        p = written(profiles(x), "profiles")
        n = p.count()
        none = F.array().cast("array<struct<item:string,w:double>>")
        weighed = p.select("pid", "n").join(_weights(p, "words", n), "pid", "left").join(_weights(p, "around", n), "pid", "left")
        known = written(weighed.select("pid", F.coalesce("words", none).alias("words"), F.coalesce("around", none).alias("around")), "known")
        found = pivot_clusters(known.select(F.col("pid").alias("node")), written(positive(known, window, same), "edges"))
        keys = x.filter("id is not null").select("id", name_words(F.col("name")).alias("words"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce("around", F.array().cast("array<string>"))))).alias("around"))
        members = keys.join(p.select("words", "around", F.col("pid").alias("node")), ["words", "around"]).join(found, "node")
        least = members.groupBy("cluster").agg(F.min("id").alias("least"))
        out = written(members.join(least, "cluster").groupBy("id").agg(F.min("least").alias("cluster")), "clusters")
    return out


def pair_quality(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (mentions, precision, recall) over pairs: clusters (id, cluster) against truth (id, entity). Pairs are counted from the
    sizes of groups, never made."""
    x = clusters.join(truth, "id")
    pairs = lambda *keys: x.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    both, found, right = (pairs(*k).select(F.col("p").alias(c)) for c, k in (("both", ("cluster", "entity")), ("found", ("cluster",)), ("right", ("entity",))))
    rows = x.agg(F.count("*").alias("mentions"))
    out = rows.join(F.broadcast(both)).join(F.broadcast(found)).join(F.broadcast(right))  # single rows
    return out.select("mentions", F.coalesce(F.try_divide("both", "found"), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide("both", "right"), F.lit(1.0)).alias("recall"))

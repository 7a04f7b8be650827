"""Reachability over edges: frontiers that start from given nodes only, and the closure where none are given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import written
from .infer import closure


def reach(edges: DataFrame, seeds: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """(s, o), each once: o is reached from s over one or more edges (s, o).

    With seeds, a table of nodes (x), only pairs with s (backward: o) among them are made: a semi-naive frontier, of which each
    round joins the pairs found last with the edges, so the work follows what the seeds reach and not the graph; the rounds grow
    with the longest way from a seed. Without seeds, it is the closure, and so it is, kept to the seeds, where these are half or more of
    the nodes with edges: its rounds are fewer by far. Cycles end; edges with a null end are no edges, null seeds reach
    nothing, repeated edges and seeds change nothing, empty tables give an empty result."""
    known_edges = edges.select("s", "o").filter("s is not null and o is not null").distinct()
    if seeds is None:
        return closure(known_edges)
    a, b = ("o", "s") if backward else ("s", "o")
    step = written(known_edges.select(F.col(a).alias("m"), F.col(b).alias("to")))
    start = seeds.select(F.col("x").alias("m")).filter("m is not null").distinct()
    sources = step.select("m").distinct()
    some, every = sources.join(start, "m", "left_semi").count(), sources.count()
    if some and 2 * some >= every:
        pairs = closure(known_edges)
        return pairs if some == every else pairs.join(start.select(F.col("m").alias(a)), a, "left_semi").select("s", "o")
    new = written(start.join(step, "m").select(F.col("m").alias("root"), "to"))
    known = new
    while new.limit(1).count():
        found = new.select("root", F.col("to").alias("m")).join(step, "m").select("root", "to").distinct()
        new = written(found.join(known, ["root", "to"], "left_anti"))
        known = known.unionByName(new)
    return known.select(F.col("root").alias(a), F.col("to").alias(b)).select("s", "o")


def nodes(triples: DataFrame) -> DataFrame:
    """x: every subject and object, once."""
    return triples.select(F.col("s").alias("x")).unionByName(triples.select(F.col("o").alias("x"))).filter("x is not null").distinct()


def _only(pairs: DataFrame, end: str, seeds: DataFrame | None) -> DataFrame:
    return pairs if seeds is None else pairs.join(seeds.select(F.col("x").alias(end)), end, "left_semi").select("s", "o")


def _swapped(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))


def path_pairs(path: tuple, triples: DataFrame, start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """(s, o): the ends of the ways that a path takes through triples, from nodes of start and to nodes of end where these are
    given (tables of x).

    A path is ('iri', p), ('not', [p], [p backwards]), ('inv', path), ('seq', [path]), ('alt', [path]), ('opt', path), ('plus', path) or
    ('star', path). Sequences and alternatives keep repeated pairs; the last three give each pair once, and of these the optional
    and the starred one join every node of the graph (and of start and end) with itself."""
    kind = path[0]
    if kind == "iri":
        return _only(_only(triples.filter(F.col("p") == path[1]).select("s", "o"), "s", start), "o", end)
    if kind == "not":
        parts = [x for x, ps in ((triples.select("p", "s", "o"), path[1]), (triples.select("p", F.col("o").alias("s"), F.col("s").alias("o")), path[2])) if ps is not None]
        parts = [x.filter(~F.col("p").isin(ps)) if ps else x for x, ps in zip(parts, [ps for ps in path[1:] if ps is not None])]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return _only(_only(out.select("s", "o"), "s", start), "o", end)
    if kind == "inv":
        return _swapped(path_pairs(path[1], triples, end, start))
    if kind == "alt":
        out, *rest = [path_pairs(x, triples, start, end) for x in path[1]]
        for x in rest:
            out = out.unionByName(x)
        return out
    if kind == "seq":
        parts = path[1] if start is not None or end is None else path[1][::-1]
        forward = parts is path[1]
        out = path_pairs(parts[0], triples, start, None) if forward else path_pairs(parts[0], triples, None, end)
        for k, x in enumerate(parts[1:], 2):
            recursive = x[0] in ("plus", "star", "opt")
            out = written(out) if recursive else out
            met = out.select(F.col("o" if forward else "s").alias("x")).distinct() if recursive else None
            last = k == len(parts)
            if forward:
                out = out.withColumnRenamed("o", "m").join(path_pairs(x, triples, met, end if last else None).withColumnRenamed("s", "m"), "m").select("s", "o")
            else:
                out = out.withColumnRenamed("s", "m").join(path_pairs(x, triples, None, met).withColumnRenamed("o", "m"), "m").select("s", "o")
        return out
    backward = start is None and end is not None
    seeds = end if backward else start
    steps = path_pairs(path[1], triples)
    if kind == "opt":
        out = _only(steps, "o" if backward else "s", seeds)
    else:
        out = reach(steps, seeds, backward)
    if kind != "plus":
        own = nodes(triples) if seeds is None else seeds.select("x").filter("x is not null").distinct()
        # What is reached from itself is among the nodes joined with themselves, and reach gives each pair once.
        out = out.distinct() if kind == "opt" else out
        out = out.filter("s <> o").unionByName(own.select(F.col("x").alias("s"), F.col("x").alias("o")))
    return out if seeds is end else _only(out, "o", end)

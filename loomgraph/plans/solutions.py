"""Tables of solutions, some of whose variables may be unbound (null), and their joins.

Two solutions agree if they bind no variable to different values; an unbound variable agrees with everything. A join on such
variables would be an OR of conditions, which only nested loops can answer. Here both sides are split by which of these variables
are null, so that every pair of parts has plain keys, and the parts are joined by hashing and put together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .written import written


@dataclass
class Solutions:
    """df has a column for each variable; those in sure are bound in every row."""

    df: DataFrame
    sure: set[str]


#: A further condition of a join, of the columns by variable.
Condition = Callable[[dict[str, Column]], Column]


def _parts(df: DataFrame, loose: list[str]) -> list[tuple[frozenset[str], DataFrame]]:
    """df split by which of the variables loose are null."""
    out = []
    for nulls in product((False, True), repeat=len(loose)):
        part = df
        for v, null in zip(loose, nulls):
            part = part.filter(F.col(v).isNull() if null else F.col(v).isNotNull())
        out.append((frozenset(v for v, null in zip(loose, nulls) if null), part))
    return out


def join(a: Solutions, b: Solutions, how: str = "inner", condition: Condition | None = None) -> Solutions:
    """inner, left, semi or anti: solutions of both that agree (and meet the condition); minus: those of a that agree with none of b with
    which they share a bound variable. Without shared variables an inner join gives all pairs, as the query asks."""
    shared = [c for c in a.df.columns if c in b.df.columns]
    loose_a, loose_b = ([c for c in shared if c not in x.sure] for x in (a, b))
    more = [c for c in b.df.columns if c not in shared]
    sure = a.sure | (b.sure if how == "inner" else set())
    if how == "inner" and condition is None and not loose_a and not loose_b:
        return Solutions(a.df.join(b.df, shared) if shared else a.df.crossJoin(b.df), sure)
    left, right = (written(x.df) if loose_a or loose_b else x.df for x in (a, b))
    right = right.select(*[F.col(c).alias(f"__{c}") for c in right.columns])
    lefts = _parts(left, loose_a)
    rights = [(frozenset(c[2:] for c in nulls), part) for nulls, part in _parts(right, [f"__{c}" for c in loose_b])]

    def on(left_nulls: frozenset[str], right_nulls: frozenset[str]) -> tuple[bool, Column]:
        keys = [c for c in shared if c not in left_nulls | right_nulls]
        test = F.lit(True)
        for c in keys:
            test = test & (F.col(c) == F.col(f"__{c}"))
        if condition is not None:
            env = {c: F.col(c) for c in a.df.columns} | {c: F.col(f"__{c}") for c in more} | {c: F.col(f"__{c}") for c in left_nulls}
            test = test & condition(env)
        return bool(keys), test

    value = lambda c: F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in loose_a else F.col(c)
    if how == "left" and not loose_a and not loose_b:
        return Solutions(left.join(right, on(frozenset(), frozenset())[1], "left").select(*a.df.columns, *[F.col(f"__{c}").alias(c) for c in more]), sure)
    out: list[DataFrame] = []
    for left_nulls, part in lefts:
        rest = part
        for right_nulls, other in rights:
            keyed, test = on(left_nulls, right_nulls)
            if how in ("inner", "left"):
                out.append(part.join(other, test, "inner").select(*map(value, a.df.columns), *[F.col(f"__{c}").alias(c) for c in more]))
            elif how == "semi":
                out.append(rest.join(other, test, "left_semi"))
            if how in ("left", "semi", "anti") or how == "minus" and keyed:
                rest = rest.join(other, test, "left_anti")
        if how == "left":
            out.append(rest.select(*a.df.columns, *[F.lit(None).cast(b.df.schema[c].dataType).alias(c) for c in more]))
        elif how in ("anti", "minus"):
            out.append(rest)
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return Solutions(df, sure)

"""Classification of ontologies in the EL profile: conjunctions, existential restrictions, role hierarchies and chains.

Axioms are brought into normal form with fresh names: a part of an expression is named by its own text, so that rows are
normalised apart from each other and equal parts get equal names. Subsumptions are then saturated by completion rules, which run as
joins (see rules).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.written import written
from .rules import evaluate

THING, NOTHING = "owl:Thing", "owl:Nothing"
TOKEN = re.compile(r"\s+|(?P<op>[()])|(?P<word>[^\s()]+)")

#: The completion rules. subs(X, A): X is a part of A; link(R, X, Y): every X has an R that is a Y.
COMPLETION = """
subs(X, X) :- class(X).
subs(X, B) :- subs(X, A), sub(A, B).
subs(X, C) :- subs(X, A), both(A, B, C), subs(X, B).
link(R, X, B) :- subs(X, A), right(A, R, B).
subs(X, B) :- link(R, X, Y), left(R, A, B), subs(Y, A).
subs(X, Z) :- link(R, X, Y), subs(Y, Z), empty(Z).
link(S, X, Y) :- link(R, X, Y), role(R, S).
link(T, X, Z) :- link(R, X, Y), chain(R, S, T), link(S, Y, Z).
"""


class ConceptError(ValueError):
    """An expression outside the profile, or broken."""


def parse_concept(text: str) -> tuple | str:
    """A name, ('and', parts in order, each once) or ('some', role, filler), from OWL functional syntax."""
    tokens = [m[0] for m in TOKEN.finditer(text) if m.lastgroup]
    at = 0

    def expression():
        nonlocal at
        if at >= len(tokens) or tokens[at] in "()":
            raise ConceptError(f"not a class expression: {text!r}")
        word = tokens[at]
        at += 1
        if at >= len(tokens) or tokens[at] != "(":
            return word
        at += 1
        parts = []
        while at < len(tokens) and tokens[at] != ")":
            parts.append(expression())
        if at >= len(tokens):
            raise ConceptError(f"not closed: {text!r}")
        at += 1
        if word == "ObjectIntersectionOf" and parts:
            flat = sorted({p for x in parts for p in (x[1] if isinstance(x, tuple) and x[0] == "and" else [x])}, key=concept_text)
            return flat[0] if len(flat) == 1 else ("and", tuple(flat))
        if word == "ObjectSomeValuesFrom" and len(parts) == 2 and isinstance(parts[0], str):
            return ("some", *parts)
        raise ConceptError(f"{word} with {len(parts)} parts is outside the profile: {text!r}")

    out = expression()
    if at != len(tokens):
        raise ConceptError(f"more than one expression: {text!r}")
    return out


def concept_text(c: tuple | str) -> str:
    if isinstance(c, str):
        return c
    return f"ObjectIntersectionOf({' '.join(map(concept_text, c[1]))})" if c[0] == "and" else f"ObjectSomeValuesFrom({c[1]} {concept_text(c[2])})"


def _name(c: tuple | str) -> str:
    return c if isinstance(c, str) else f"_:{concept_text(c)}"


def normal_forms(kind: str, components: list[str]) -> list[tuple[str, str, str, str]]:
    """(form, a, b, c) of one axiom: sub a b; both a b c (a and b are c); right a r b (every a has an r in b); left r a b (what has an
    r in a is a b); role r s; chain r s t. Kinds of axioms outside the profile give none."""
    out: list[tuple[str, str, str, str]] = []

    def below(c) -> str:
        """Axioms by which whatever is a c has its name."""
        if isinstance(c, tuple) and c[0] == "and":
            names = [below(x) for x in c[1]]
            done = names[0]
            for k, n in enumerate(names[1:], 2):
                whole = _name(c) if k == len(names) else f"_:{' & '.join(names[:k])}"
                out.append(("both", done, n, whole))
                done = whole
        elif isinstance(c, tuple):
            out.append(("left", c[1], below(c[2]), _name(c)))
        return _name(c)

    def above(c) -> str:
        """Axioms by which whatever has the name is a c."""
        if isinstance(c, tuple) and c[0] == "and":
            out.extend(("sub", _name(c), above(x), "") for x in c[1])
        elif isinstance(c, tuple):
            out.append(("right", _name(c), c[1], above(c[2])))
        return _name(c)

    def inclusion(a: str, b: str) -> None:
        out.append(("sub", below(parse_concept(a)), above(parse_concept(b)), ""))

    if kind == "SubClassOf":
        for sup in components[1:]:
            inclusion(components[0], sup)
    elif kind == "EquivalentClasses":
        for a in components:
            for b in components:
                if a != b:
                    inclusion(a, b)
    elif kind == "DisjointClasses":
        for k, a in enumerate(components):
            for b in components[k + 1 :]:
                inclusion(f"ObjectIntersectionOf({a} {b})", NOTHING)
    elif kind == "ObjectPropertyDomain":
        inclusion(f"ObjectSomeValuesFrom({components[0]} {THING})", components[1])
    elif kind == "SubObjectPropertyOf":
        *chain, last = components
        for k, r in enumerate(chain[1:], 2):
            out.append(("chain", chain[0] if k == 2 else f"_:{'.'.join(chain[: k - 1])}", r, last if k == len(chain) else f"_:{'.'.join(chain[:k])}"))
        if len(chain) == 1:
            out.append(("role", chain[0], last, ""))
    elif kind == "TransitiveObjectProperty":
        out.append(("chain", components[0], components[0], components[0]))
    return out


def normalise(axioms: DataFrame) -> DataFrame:
    """(form, a, b, c), each once, of axioms (axiom_type, components). Expressions are in OWL functional syntax."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [f for kind, parts in zip(batch["axiom_type"], batch["components"]) if kind is not None and parts is not None for f in normal_forms(kind, [p for p in parts if p is not None])]
            yield pd.DataFrame(found, columns=["form", "a", "b", "c"])

    return axioms.select("axiom_type", "components").mapInPandas(rows, "form string, a string, b string, c string").distinct()


def classify(axioms: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(child, parent): every subsumption between different named classes that follows from the axioms; a class that can have no member
    is below every class, and is given with the parent `owl:Nothing` only.

    classes(uri) adds names that no axiom uses. Repeated axioms change nothing, rows with a null are left out, an empty table gives no rows;
    broken expressions raise."""
    n = written(normalise(axioms), "axioms")  # parsed once, read by every form
    form = lambda kind, *cols: n.filter(F.col("form") == kind).select(*cols)
    named = n.select(
        F.explode(
            F.when(F.col("form") == "sub", F.array("a", "b")).when(F.col("form") == "both", F.array("a", "b", "c")).when(F.col("form") == "right", F.array("a", "c")).when(F.col("form") == "left", F.array("b", "c")).otherwise(F.array())
        ).alias("x")
    )
    if classes is not None:
        named = named.unionByName(classes.select(F.col("uri").alias("x")))
    named = named.filter("x is not null").distinct()
    one = n.sparkSession.range(1)
    relations = {
        "class": named.unionByName(one.select(F.lit(THING).alias("x"))),
        "sub": form("sub", "a", "b").unionByName(named.select(F.col("x").alias("a"), F.lit(THING).alias("b"))),
        "both": form("both", "a", "b", "c"),
        "right": form("right", "a", "b", "c"),
        "left": form("left", "a", "b", "c"),
        "role": form("role", "a", "b"),
        "chain": form("chain", "a", "b", "c"),
        "empty": one.select(F.lit(NOTHING).alias("x")),
    }
    s = evaluate(COMPLETION, relations, {"subs"})["subs"].select(F.col("c0").alias("child"), F.col("c1").alias("parent"))
    s = s.filter("not startswith(child, '_:') and not startswith(parent, '_:') and child <> parent").filter(~F.col("child").isin(THING, NOTHING) & (F.col("parent") != THING))
    empty = F.max(F.col("parent") == NOTHING).over(Window.partitionBy("child"))
    return s.withColumn("none", empty).filter((F.col("parent") == NOTHING) | ~F.col("none")).select("child", "parent")


def direct(hierarchy: DataFrame) -> DataFrame:
    """The subsumptions of a classified hierarchy with nothing strictly between; equivalent classes have the same parents, and no edge
    to each other."""
    h = written(hierarchy.select("child", "parent"), "hierarchy")
    back = h.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    strict = written(h.join(back, ["child", "parent"], "left_anti"), "hierarchy")
    middle = strict.select("child", F.col("parent").alias("m")).join(strict.select(F.col("child").alias("m"), "parent"), "m").select("child", "parent")
    return strict.join(middle.distinct(), ["child", "parent"], "left_anti")


def equivalent(hierarchy: DataFrame) -> DataFrame:
    """(a, b), a before b: classes that are below each other."""
    h = hierarchy.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    return h.join(h.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").filter("a < b")

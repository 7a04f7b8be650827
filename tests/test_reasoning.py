"""Paths, groups within groups, rules, supports and classification against brute force."""

import itertools
import random

import pytest

from loomgraph.operators import el, paths, rules
from loomgraph.plans.sparql import Parser, SparqlError, sparql


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Paths.


def plain_path(path, t):
    """Pairs of a path, as a list with repetitions."""
    kind, nodes = path[0], {x for s, _, o in t for x in (s, o)}
    if kind == "iri":
        return [(s, o) for s, p, o in t if p == path[1]]
    if kind == "not":
        ahead = [(s, o) for s, p, o in t if path[1] is not None and p not in path[1]]
        return ahead + [(o, s) for s, p, o in t if path[2] is not None and p not in path[2]]
    if kind == "inv":
        return [(o, s) for s, o in plain_path(path[1], t)]
    if kind == "alt":
        return [x for p in path[1] for x in plain_path(p, t)]
    if kind == "seq":
        out = plain_path(path[1][0], t)
        for p in path[1][1:]:
            out = [(s, z) for s, o in out for y, z in plain_path(p, t) if o == y]
        return out
    step = set(plain_path(path[1], t))
    if kind == "opt":
        return sorted(step | {(n, n) for n in nodes})
    found = set(step)
    while True:
        more = {(a, d) for a, b in found for c, d in step if b == c} - found
        if not more:
            break
        found |= more
    return sorted(found | ({(n, n) for n in nodes} if kind == "star" else set()))


PATHS = ("<p>+", "<p>*", "<p>?", "(<p>/<q>)+", "^<p>/<q>", "(<p>|<q>)*", "<p>|<q>|<p>", "!(<p>)", "!(<p>|^<q>)", "!^<p>", "(^<p>/<q>*)?", "<p>/<q>?/<r>+", "<q>+/^<p>")


@pytest.mark.parametrize("text", PATHS)
def test_paths(spark, text):
    r = random.Random(len(text))
    rows = sorted({(r.choice("abcdef"), r.choice("pqr"), r.choice("abcdef")) for _ in range(14)})
    t = triples(spark, rows + rows[:2])
    path = Parser(text).path()
    want = sorted(plain_path(path, rows + rows[:2]))
    assert answers(sparql(f"SELECT ?x ?y WHERE {{ ?x {text} ?y }}", t)) == want
    for a in "ab":
        assert answers(sparql(f"SELECT ?y WHERE {{ <{a}> {text} ?y }}", t)) == sorted((o,) for s, o in want if s == a)
        assert answers(sparql(f"SELECT ?x WHERE {{ ?x {text} <{a}> }}", t)) == sorted((s,) for s, o in want if o == a)
    assert answers(sparql(f"SELECT ?x WHERE {{ ?x {text} ?x }}", t)) == sorted((s,) for s, o in want if s == o)
    both = sorted((s, o, z) for s, o in want for y, p, z in rows + rows[:2] if p == "r" and y == s)
    assert answers(sparql(f"SELECT ?x ?y ?z WHERE {{ ?x <r> ?z . ?x {text} ?y }}", t)) == both


def test_reach_of_messy_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", None), (None, "a"), ("b", "c"), ("b", "c"), ("c", "c")], "s string, o string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "x string")
    assert answers(paths.reach(e, seeds)) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert answers(paths.reach(e, seeds, backward=True)) == [("a", "a"), ("b", "a")]
    assert answers(paths.reach(e)) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "c")]
    assert paths.reach(e.limit(0), seeds).count() == 0 == paths.reach(e, seeds.limit(0)).count()


# Groups within groups.

ROWS = [("a", "lim", "5"), ("b", "lim", "2"), ("c", "lim", "x"), ("a", "val", "3"), ("b", "val", "3"), ("a", "val", "9"), ("a", "tag", "t"), ("c", "tag", "u"), ("t", "is", "1")]


def ask(spark, text):
    return answers(sparql(text, triples(spark, ROWS)))


def test_filters_in_optional(spark):
    got = ask(spark, "SELECT ?x ?l ?v WHERE { ?x <lim> ?l . OPTIONAL { ?x <val> ?v . FILTER(?v + 0 < ?l + 0) } }")
    assert got == [("a", "5", "3"), ("b", "2", None), ("c", "x", None)]
    got = ask(spark, "SELECT ?x ?v WHERE { ?x <lim> ?l . OPTIONAL { ?x <val> ?v . FILTER(?v > 5) } FILTER(BOUND(?v) || ?x = 'c') }")
    assert got == [("a", "9"), ("c", None)]


def test_exists_and_minus(spark):
    assert ask(spark, "SELECT ?x WHERE { ?x <lim> ?l FILTER EXISTS { ?x <val> ?v FILTER(?v > ?l + 1) } }") == [("a",)]
    assert ask(spark, "SELECT ?x WHERE { ?x <lim> ?l FILTER NOT EXISTS { ?x <tag> ?v } }") == [("b",)]
    assert ask(spark, "SELECT ?x WHERE { ?x <lim> ?l FILTER(!EXISTS { ?x <tag> ?v } && ?l = 2) }") == [("b",)]
    assert ask(spark, "SELECT ?x WHERE { ?x <lim> ?l MINUS { ?x <val> ?v FILTER(?v = 9) } }") == [("b",), ("c",)]
    assert len(ask(spark, "SELECT ?x WHERE { ?x <lim> ?l MINUS { ?y <val> ?z } }")) == 3  # no variable in common removes nothing
    # An unbound variable of either side is no reason to differ.
    got = ask(spark, "SELECT ?x ?t WHERE { ?x <lim> ?l OPTIONAL { ?x <tag> ?t } MINUS { ?y <is> ?n . OPTIONAL { ?x <tag> ?y FILTER(?n = 1) } BIND(?y AS ?t) } }")
    assert got == [("b", None), ("c", "u")]


def test_values_bind_subquery_having(spark):
    assert ask(spark, "SELECT ?x ?l WHERE { VALUES (?x ?l) { ('a' UNDEF) (UNDEF '2') ('c' '5') } ?x <lim> ?l }") == [("a", "5"), ("b", "2")]
    assert ask(spark, "SELECT ?x ?d WHERE { ?x <val> ?v . BIND(?v * 2 - 1 AS ?d) FILTER(?d >= 5) }") == [("a", 17.0), ("a", 5.0), ("b", 5.0)]
    assert ask(spark, "SELECT ?x ?w WHERE { ?x <tag> ?t . BIND(CONCAT(UCASE(?t), SUBSTR('xyz', 2, 1), STR(?x)) AS ?w) }") == [("a", "Tya"), ("c", "Uyc")]
    got = ask(spark, "SELECT ?x (SUM(?v) / COUNT(?v) AS ?m) (MAX(?v) AS ?top) WHERE { ?x <val> ?v } GROUP BY ?x HAVING(COUNT(*) > 1 && SUM(?v) = 12)")
    assert got == [("a", 6.0, "9")]
    got = ask(spark, "SELECT ?x ?l ?n WHERE { ?x <lim> ?l { SELECT ?x (COUNT(?v) AS ?n) WHERE { ?x <val> ?v } GROUP BY ?x } }")
    assert got == [("a", "5", 2), ("b", "2", 1)]
    assert ask(spark, "SELECT (IF(?l > 3, 'big', 'small') AS ?k) (COALESCE(?q, ?x) AS ?c) WHERE { ?x <lim> ?l OPTIONAL { ?x <none> ?q } FILTER(?l NOT IN ('x')) }") == [("big", "a"), ("small", "b")]
    assert ask(spark, "SELECT (COUNT(*) AS ?n) WHERE { ?x <val> ?v }") == [(3,)]


def test_unbound_on_both_sides(spark):
    """Joins of variables that may be unbound on either side, against the definition."""
    r = random.Random(3)
    rows = sorted({(r.choice("abc"), p, r.choice("abc")) for _ in range(14) for p in [r.choice("pqrst")]})
    of = lambda p: [(s, o) for s, q, o in rows if q == p]
    left = [{"x": s, "y": o} for s, o in of("p")] + [{"x": s} for s, _ in of("q")] + [{"z": o} for _, o in of("t")]
    right = [{"y": s, "z": o} for s, o in of("r")] + [{"y": s, "x": o} for s, o in of("s")]
    want = [{**a, **b} for a in left for b in right if all(a[k] == b[k] for k in a.keys() & b.keys())]
    q = "{ { ?x <p> ?y } UNION { ?x <q> ?u0 } UNION { ?u1 <t> ?z } } { { ?y <r> ?z } UNION { ?y <s> ?x } }"
    got = answers(sparql(f"SELECT ?x ?y ?z WHERE {{ {q} }}", triples(spark, rows)))
    assert got == sorted(((w.get("x"), w.get("y"), w.get("z")) for w in want), key=repr)


@pytest.mark.parametrize("text", [
    "SELECT ?x WHERE { ?x <p> ?y . FILTER(?nowhere = 1) }", "SELECT ?x WHERE { ?x <p>+/ ?y }", "SELECT ?x WHERE { BIND(1 AS ?x) }", "SELECT ?x WHERE { ?x <p> ?y . BIND(1 AS ?y) }",
    "SELECT ?x WHERE { ?x <p> ?y . FILTER(EXISTS { ?x <q> ?z } || ?y = 1) }", "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x <p> ?y }", "SELECT ?x WHERE { ?x <p> ?y } HAVING(?x = 1)", "SELECT ?x WHERE { ?x <p> ?y . FILTER(COUNT(?x) > 1) }",
    "SELECT ?x WHERE { ?x <p> ?y . FILTER(FOO(?x)) }", "SELECT ?x WHERE { ?x 'lit' ?y }", "SELECT WHERE { ?x <p> ?y }", "SELECT ?x WHERE { ?x <p> ?y } nonsense",
])
def test_what_is_refused(spark, text):
    with pytest.raises(SparqlError):
        sparql(text, triples(spark, ROWS)).collect()


def test_inner_groups_match_given_values_only(spark):
    """Of what an optional, excluded or tested group has, only what a narrow group around it can agree with is joined."""
    rows = [(f"o{i}", "in", f"p{i % 3}") for i in range(12)] + [(f"p{i % 3}", "by", f"s{i}") for i in range(6)] + [(f"s{i}", "at", f"n{i % 2}") for i in range(6)]
    t = triples(spark, rows + [(f"o{i}", "of", f"c{i % 4}") for i in range(12)] + [(f"c{i}", "at", f"n{i % 2}") for i in range(4)] + [("o0", "in", "p0")])
    of = {o: c for o, p, c in answers(t) if p == "of"}
    at = {x: n for x, p, n in answers(t) if p == "at"}
    pairs = [(o, p, s) for o, q, p in answers(t) if q == "in" for x, r, s in answers(t) if r == "by" and x == p]
    inner = "{ ?o <in> ?p . ?p <by> ?s . ?s <at> ?m . FILTER(?m = ?n) }"
    outer = "?c <at> ?n . FILTER(?n IN ('n1', 'n7')) ?o <of> ?c"
    got = sparql(f"SELECT ?o ?p ?s WHERE {{ {outer} . OPTIONAL {inner} }}", t)
    mine = {o for o, c in of.items() if at[c] == "n1"}
    want = [x for x in pairs if x[0] in mine and at[x[2]] == "n1"]
    assert answers(got) == sorted(want + [(o, None, None) for o in mine - {x[0] for x in want}], key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2  # the orders asked for, and the places of their customers
    assert answers(sparql(f"SELECT ?o WHERE {{ {outer} . FILTER EXISTS {inner} }}", t)) == sorted({(x[0],) for x in want})
    got = answers(sparql(f"SELECT ?o WHERE {{ {outer} MINUS {{ ?o <in> ?p . ?p <by> 's5' }} }}", t))
    assert got == sorted((o,) for o in mine - {x[0] for x in pairs if x[2] == "s5"})


# Rules.

PROGRAM = """
% what is reached, what is not, and pairs of nodes that reach each other
reach(X, Y) :- edge(X, Y).
reach(X, Z) :- reach(X, Y), reach(Y, Z), X != "skip".
apart(X, Y) :- node(X), edge(X, _), other(Y, X), not reach(X, Y).
same(X, Y) :- reach(X, Y), reach(Y, X).
even(X, X) :- node(X).
even(X, Z) :- odd(X, Y), edge(Y, Z).
odd(X, Z) :- even(X, Y), edge(Y, Z).
"""


def plain_rules(program, relations):
    """The least fixpoint, group by group, by trying all bindings."""
    known = {n: {tuple(map(str, r)) for r in rows if None not in r} for n, rows in relations.items()}
    parsed = rules.parse(program)
    for group in rules.groups(parsed):
        while True:
            found = set()
            for r in parsed:
                if r.head.name not in group:
                    continue
                bindings = [{}]
                for a in r.body:
                    more = []
                    for b in bindings:
                        for row in known.get(a.name, ()):
                            new = dict(b)
                            if all((new.setdefault(t.value, v) if t.variable else t.value) == v for t, v in zip(a.terms, row)):
                                more.append(new)
                    bindings = more
                value = lambda t, b: b[t.value] if t.variable else t.value
                for b in bindings:
                    if all({"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: float(x) < float(y)}[op](value(x, b), value(y, b)) for op, x, y in r.tests):
                        if not any(all(not t.variable or t.value not in b or b[t.value] == v for t, v in zip(a.terms, row)) and all(t.variable or t.value == v for t, v in zip(a.terms, row)) for a in r.negated for row in known.get(a.name, ())):
                            found.add((r.head.name, tuple(value(t, b) for t in r.head.terms)))
            new = {(n, row) for n, row in found if row not in known.get(n, set())}
            if not new:
                break
            for n, row in new:
                known.setdefault(n, set()).add(row)
    return known


def random_graph(seed, n=7, m=9):
    r = random.Random(seed)
    names = [str(k) for k in range(n)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(m)]
    return {"edge": edges + edges[:1] + [(None, "1")], "node": [(x,) for x in names], "other": [(a, b) for a in names for b in names if a != b and r.random() < 0.6]}


def frames(spark, relations):
    return {n: spark.createDataFrame(rows, ", ".join(f"x{k} string" for k in range(len(rows[0])))) for n, rows in relations.items()}


def test_rules(spark):
    for seed in (1, 2):
        relations = random_graph(seed)
        want = plain_rules(PROGRAM, relations)
        got = rules.evaluate(PROGRAM, frames(spark, relations))
        assert set(got) == {"reach", "apart", "same", "even", "odd"}
        for name, df in got.items():
            assert answers(df) == sorted(want.get(name, set()))


def test_questions(spark):
    relations = random_graph(5)
    f, want = frames(spark, relations), plain_rules(PROGRAM, relations)
    assert answers(rules.ask(PROGRAM, f, 'reach("1", X)')) == sorted((b,) for a, b in want["reach"] if a == "1")
    assert answers(rules.ask(PROGRAM, f, 'even(X, "2")')) == sorted((a,) for a, b in want["even"] if b == "2")
    assert answers(rules.ask(PROGRAM, f, 'same("3", "3")')) == sorted({() for x in want.get("same", ()) if x == ("3", "3")})
    assert answers(rules.ask(PROGRAM, f, 'apart("1", Y)')) == sorted((b,) for a, b in want.get("apart", ()) if a == "1")
    assert answers(rules.ask(PROGRAM, f, "odd(X, X)")) == sorted((a,) for a, b in want["odd"] if a == b)
    assert answers(rules.ask(PROGRAM, f, "edge(X, Y)")) == sorted({e for e in relations["edge"] if None not in e})


def test_questions_derive_only_what_they_ask_for(spark):
    """On a long chain, a question from one end derives as many rows as it answers, not the whole closure."""
    chain = [(str(k), str(k + 1)) for k in range(30)]
    program = "reach(X, Y) :- edge(X, Y). reach(X, Z) :- reach(X, Y), edge(Y, Z)."
    asked, answer, start, constants = rules.magic(rules.parse(program), rules.parse('reach("25", X) :- reach("25", X).')[0].head)
    f = {n: rules._positions(r) for n, r in frames(spark, {"edge": chain}).items()} | {start: spark.createDataFrame([tuple(constants)], "c0 string")}
    out = rules._evaluated(asked, f, None, False)
    assert out[answer].count() == 5 and sum(df.count() for df in out.values()) < 15
    given = frames(spark, {"edge": chain, "reach": [("25", "extra")]})
    assert ("extra",) in answers(rules.ask(program, given, 'reach("25", X)'))


def test_owl_rl(spark):
    rows = {
        "triple": [("rex", "bites", "tom"), ("tom", "within", "yard"), ("yard", "within", "town"), ("ann", "knows", "bob"), ("rex", "owner", "ann")], "subproperty": [("bites", "meets")],
        "transitive": [("within",)], "symmetric": [("knows",)], "inverse": [("within", "holds")], "chain": [("owner", "knows", "known")], "domain": [("bites", "Dog")], "range": [("holds", "Thing")], "subclass": [("Dog", "Pet"), ("Pet", "Animal")],
    }
    out = rules.evaluate(rules.OWL_RL, frames(spark, rows))
    got = set(answers(out["triple"]))
    assert got - set(rows["triple"]) == {
        ("rex", "meets", "tom"), ("tom", "within", "town"), ("yard", "holds", "tom"), ("town", "holds", "yard"), ("town", "holds", "tom"), ("bob", "knows", "ann"), ("rex", "known", "bob"),
    }
    assert set(answers(out["type"])) == {("rex", "Dog"), ("rex", "Pet"), ("rex", "Animal"), ("tom", "Thing"), ("yard", "Thing")}


@pytest.mark.parametrize("program", [
    "p(X) :- q(X), not p(X).", "p(X, Y) :- q(X).", "p(X) :- q(X), r(Y).", "p(X) :- q(X, X).", "p(X).", "p(X) :- missing(X).", "p(X) :- q(X", "p(X) :- q(X), X ! Y.", "p(X) :- q(X), not r(Y).", "P :- q(X).",
])
def test_bad_rules(spark, program):
    with pytest.raises(rules.RuleError):
        rules.evaluate(program, frames(spark, {"q": [("a",)], "r": [("b",)]}))


def test_atoms_of_one_variable_narrow_the_others(spark, monkeypatch):
    """Statements of predicates that are not transitive are not joined with each other."""
    joined, real = [], rules._narrowed
    monkeypatch.setattr(rules, "_narrowed", lambda *a: joined.append((a[0], real(*a))) or joined[-1][1])
    facts = [(f"x{i % 7}", "other", f"x{i % 5}") for i in range(35)] + [("a", "in", "b"), ("b", "in", "c")]
    f = frames(spark, {"triple": facts, "transitive": [("in",)]})
    program = "triple(X, P, Z) :- transitive(P), triple(X, P, Y), triple(Y, P, Z)."
    assert answers(rules.evaluate(program, f)["triple"]) == sorted(set(facts) | {("a", "in", "c")})
    assert max(t.count() for _, scans in joined[:2] for t in scans) == 2


def test_supports(spark):
    """Every minimal support, checked by leaving facts out: a support is enough, no part of it is, and there is no other."""
    program = "reach(X, Y) :- edge(X, Y). reach(X, Z) :- reach(X, Y), reach(Y, Z). tied(X) :- reach(X, Y), mark(Y, X)."
    for seed in (1, 4):
        r = random.Random(seed)
        edges = sorted({(r.choice("abcd"), r.choice("abcd")) for _ in range(6)})
        relations = {"edge": edges, "mark": [("a", "b"), ("c", "b"), ("d", "a")]}
        facts = [(n, row) for n, rows in relations.items() for row in rows]
        holds = {}
        for size in range(len(facts) + 1):
            for some in itertools.combinations(facts, size):
                given = {"edge": [], "mark": []}
                for n, row in some:
                    given[n].append(row)
                for name, rows in plain_rules(program, given).items():
                    for row in rows if name in ("reach", "tied") else ():
                        if not any(set(x) <= set(some) for x in holds.get((name, row), [])):
                            holds.setdefault((name, row), []).append(some)
        for name in ("reach", "tied"):
            got = [(row[:-1], tuple(row[-1])) for row in map(tuple, rules.supports(program, frames(spark, relations), name).collect())]
            want = [(row, tuple(sorted(f"{n}({', '.join(x)})" for n, x in some))) for (k, row), each in holds.items() if k == name for some in each]
            assert sorted(got) == sorted(want)
    with pytest.raises(rules.RuleError):
        rules.supports("p(X) :- q(X), not r(X).", frames(spark, {"q": [("a",)], "r": [("b",)]}), "p")


# Classification.


def plain_classes(axioms, names):
    """Saturation over the normal forms by trying everything, with rules written out apart from the program."""
    forms = {f for kind, parts in axioms for f in el.normal_forms(kind, parts)}
    every = set(names) | {x for f in forms if f[0] in ("sub", "both", "right", "left") for x in ({"sub": f[1:3], "both": f[1:4], "right": (f[1], f[3]), "left": (f[2], f[3])}[f[0]])} | {el.THING}
    s = {x: {x, el.THING} for x in every}
    link = set()
    while True:
        size = (sum(map(len, s.values())), len(link))
        for x in every:
            for kind, a, b, c in forms:
                if kind == "sub" and a in s[x]:
                    s[x].add(b)
                elif kind == "both" and {a, b} <= s[x]:
                    s[x].add(c)
                elif kind == "right" and a in s[x]:
                    link.add((b, x, c))
        for r, x, y in list(link):
            if el.NOTHING in s[y]:
                s[x].add(el.NOTHING)
            for kind, a, b, c in forms:
                if kind == "left" and a == r and b in s[y]:
                    s[x].add(c)
                elif kind == "role" and a == r:
                    link.add((b, x, y))
                elif kind == "chain" and a == r:
                    link |= {(c, x, z) for q, w, z in list(link) if q == b and w == y}
        if size == (sum(map(len, s.values())), len(link)):
            break
    out = set()
    for x in every - {el.THING, el.NOTHING}:
        if not x.startswith("_:"):
            out |= {(x, el.NOTHING)} if el.NOTHING in s[x] else {(x, y) for y in s[x] - {x, el.THING} if not y.startswith("_:")}
    return out


def random_concept(r, depth=2):
    if depth == 0 or r.random() < 0.4:
        return r.choice("ABCDEF")
    if r.random() < 0.5:
        return f"ObjectIntersectionOf({random_concept(r, depth - 1)} {random_concept(r, depth - 1)} {r.choice('ABC')})"
    return f"ObjectSomeValuesFrom({r.choice('rst')} {random_concept(r, depth - 1)})"


def test_classification(spark):
    for seed in (1, 2, 3):
        r = random.Random(seed)
        axioms = [("SubClassOf", [random_concept(r), random_concept(r)]) for _ in range(9)] + [("EquivalentClasses", ["E", random_concept(r)]), ("DisjointClasses", ["A", "F", "D"])]
        axioms += [("SubObjectPropertyOf", ["r", "s"]), ("SubObjectPropertyOf", ["r", "s", "t"]), ("TransitiveObjectProperty", ["t"]), ("ObjectPropertyDomain", ["s", "B"]), ("Other", ["x"])]
        df = spark.createDataFrame(axioms + axioms[:2] + [(None, ["A"]), ("SubClassOf", None)], "axiom_type string, components array<string>").repartition(3)
        got = el.classify(df, spark.createDataFrame([("Lonely",), (None,)], "uri string"))
        want = plain_classes(axioms, {"Lonely"})
        assert set(answers(got)) == want
        strict = {(a, b) for a, b in want if (b, a) not in want}
        assert set(answers(el.direct(got))) == {(a, b) for a, b in strict if not any((a, m) in strict and (m, b) in strict for m in {x for x, _ in strict})}
        assert set(answers(el.equivalent(got))) == {(a, b) for a, b in want if (b, a) in want and a < b}


def test_classification_by_hand(spark):
    axioms = [
        ("EquivalentClasses", ["Parent", "ObjectIntersectionOf(Person ObjectSomeValuesFrom(hasChild Person))"]), ("SubClassOf", ["Mother", "ObjectIntersectionOf(Woman ObjectSomeValuesFrom(hasChild Person))"]),
        ("SubClassOf", ["Woman", "Person"]), ("DisjointClasses", ["Person", "Stone"]), ("SubClassOf", ["Golem", "ObjectIntersectionOf(Person Stone)"]), ("SubClassOf", ["GolemOwner", "ObjectSomeValuesFrom(owns Golem)"]),
    ]
    got = el.classify(spark.createDataFrame(axioms, "axiom_type string, components array<string>"))
    assert set(answers(got)) == {("Mother", "Parent"), ("Mother", "Woman"), ("Mother", "Person"), ("Woman", "Person"), ("Parent", "Person"), ("Golem", el.NOTHING), ("GolemOwner", el.NOTHING)}
    assert el.classify(spark.createDataFrame([], "axiom_type string, components array<string>")).count() == 0
    for bad in ("ObjectUnionOf(A B)", "ObjectSomeValuesFrom(r)", "(A", "ObjectIntersectionOf(A", "A B", ""):
        with pytest.raises(el.ConceptError):
            el.parse_concept(bad)


def test_given_relations_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def slow(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(6)], "a string, b string").mapInPandas(slow, "a string, b string")
    got = rules.evaluate("since(X, Y) :- next(X, Y). since(X, Z) :- since(X, Y), next(Y, Z).", {"next": edges})["since"]
    assert got.count() == 21 and seen.value == 6

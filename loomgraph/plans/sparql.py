"""SELECT queries over triples: a small syntax tree, compiled to DataFrame joins that Catalyst plans.

Supported: PREFIX, SELECT [DISTINCT] variables, * and (expression AS ?v) with COUNT, SUM, MIN, MAX and AVG, triple patterns with `;`,
`,` and `a`, property paths (`/ | ^ + * ? !`), FILTER with [NOT] EXISTS, OPTIONAL, UNION, MINUS, BIND, VALUES, subqueries,
GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import path_pairs
from . import solutions
from .solutions import Solutions
from .written import written

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)|(?P<num>\d+(?:\.\d+)?)"""
    r"""|(?P<op>&&|\|\||!=|<=|>=|[{}().;,=<>!*+/^|?-])|(?P<name>[A-Za-z_][\w-]*:[\w.-]*[\w-]|[A-Za-z_][\w-]*:|:[\w.-]*\w|[A-Za-z_]\w*)"""
)
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")
TESTS = ("BOUND", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS")
VALUES = ("STR", "STRLEN", "UCASE", "LCASE", "CONCAT", "SUBSTR", "COALESCE", "IF", "ABS", "FLOOR", "CEIL", "ROUND")
NUMERIC = ("STRLEN", "ABS", "FLOOR", "CEIL", "ROUND")


class SparqlError(ValueError):
    """The query is outside the supported part of the language, or broken."""


@dataclass
class Group:
    """Parts in the order written: ('bgp', patterns), ('union', groups), ('optional', group), ('minus', group),
    ('bind', expression, name), ('values', names, rows), ('select', query); and the filters, which hold for the whole group."""

    parts: list[tuple] = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Select:
    items: list  # ('all',), ('var', name) or ('expr', expression, name)
    distinct: bool
    where: Group
    group_by: list[str]
    having: list
    order_by: list[tuple[str, bool]]
    limit: int | None
    offset: int


def is_select(query: str) -> bool:
    """What counts as a query; everything else is a question for a translator."""
    return query.strip().upper().startswith(("SELECT", "PREFIX"))


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"cannot read {text[at:at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i, self.prefixes = 0, {}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def word(self, *words: str) -> bool:
        kind, value = self.peek()
        if kind == "name" and value.upper() in words:
            self.i += 1
            return True
        return False

    def op(self, value: str) -> bool:
        if self.peek() == ("op", value):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.op(value):
            raise SparqlError(f"expected {value!r}, found {self.peek()[1]!r}")

    def parse(self) -> Select:
        while self.word("PREFIX"):
            _, name = self.next()
            _, iri = self.next()
            self.prefixes[name.rstrip(":")] = iri[1:-1]
        if not self.word("SELECT"):
            raise SparqlError("only SELECT queries are supported")
        out = self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        distinct = self.word("DISTINCT")
        items: list = []
        while True:
            kind, value = self.peek()
            if kind == "var":
                items.append(("var", self.variable()))
            elif self.op("*"):
                items.append(("all",))
            elif self.op("("):
                items.append(("expr", *self.named()))
            else:
                break
        if not items:
            raise SparqlError("nothing is selected")
        self.word("WHERE")
        out = Select(items, distinct, self.group(), [], [], [], None, 0)
        while True:
            if self.word("GROUP"):
                self.word("BY")
                while self.peek()[0] == "var":
                    out.group_by.append(self.variable())
            elif self.word("HAVING"):
                while self.op("("):
                    out.having.append(self.either())
                    self.need(")")
            elif self.word("ORDER"):
                self.word("BY")
                while self.peek()[0] == "var" or self.peek()[1].upper() in ("ASC", "DESC"):
                    if self.peek()[0] == "var":
                        out.order_by.append((self.variable(), True))
                    else:
                        up = self.next()[1].upper() == "ASC"
                        self.need("(")
                        out.order_by.append((self.variable(), up))
                        self.need(")")
            elif self.word("LIMIT"):
                out.limit = int(self.next()[1])
            elif self.word("OFFSET"):
                out.offset = int(self.next()[1])
            else:
                return out

    def variable(self) -> str:
        kind, value = self.next()
        if kind != "var":
            raise SparqlError(f"not a variable: {value!r}")
        return value[1:]

    def named(self) -> tuple:
        """expression AS ?name), after the open bracket."""
        e = self.either()
        if not self.word("AS"):
            raise SparqlError("an expression needs AS ?name")
        name = self.variable()
        self.need(")")
        return e, name

    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.word("SELECT"):
            g.parts.append(("select", self.select()))
            self.need("}")
            return g
        while not self.op("}"):
            if self.word("FILTER"):
                g.filters.append(self.single())
            elif self.word("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.word("BIND"):
                self.need("(")
                g.parts.append(("bind", *self.named()))
            elif self.word("VALUES"):
                g.parts.append(self.values())
            elif self.peek() == ("op", "{"):
                sides = [self.group()]
                while self.word("UNION"):
                    sides.append(self.group())
                g.parts.append(("union", sides))
            elif self.peek()[0] == "end":
                raise SparqlError("a group is not closed")
            else:
                if not g.parts or g.parts[-1][0] != "bgp":
                    g.parts.append(("bgp", []))
                self.triples(g.parts[-1][1])
            self.op(".")
        return g

    def values(self) -> tuple:
        if self.peek()[0] == "var":
            names, many = [self.variable()], False
        else:
            self.need("(")
            names, many = [], True
            while not self.op(")"):
                names.append(self.variable())
        rows = []
        self.need("{")
        while not self.op("}"):
            if many:
                self.need("(")
            rows.append([None if self.word("UNDEF") else self.term()[1] for _ in names])
            if many:
                self.need(")")
        return ("values", names, rows)

    def triples(self, patterns: list[tuple]) -> None:
        s = self.term()
        while True:
            p = self.term() if self.peek()[0] == "var" else self.path()
            while True:
                patterns.append((s, p if p[0] in ("var", "iri") else ("path", p), self.term()))
                if not self.op(","):
                    break
            if not self.op(";"):
                break
            if self.peek() in (("op", "."), ("op", "}")):
                break

    def path(self) -> tuple:
        sides = [self.steps()]
        while self.op("|"):
            sides.append(self.steps())
        return ("alt", sides) if len(sides) > 1 else sides[0]

    def steps(self) -> tuple:
        out = [self.step()]
        while self.op("/"):
            out.append(self.step())
        return ("seq", out) if len(out) > 1 else out[0]

    def step(self) -> tuple:
        inverse = self.op("^")
        if self.op("("):
            p = self.path()
            self.need(")")
        elif self.op("!"):
            p = self.negated()
        else:
            p = self.term(predicate=True)
            if p[0] != "iri":
                raise SparqlError(f"not a predicate: {p[1]!r}")
        for sign, kind in (("+", "plus"), ("*", "star"), ("?", "opt")):
            if self.op(sign):
                p = (kind, p)
                break
        return ("inv", p) if inverse else p

    def negated(self) -> tuple:
        """Predicates other than those named, and backwards if any are named so."""
        ahead: list[str] = []
        back: list[str] = []
        several = self.op("(")
        while True:
            side = back if self.op("^") else ahead
            side.append(self.term(predicate=True)[1])
            if not several or not self.op("|"):
                break
        if several:
            self.need(")")
        return ("not", ahead if ahead or not back else None, back or None)

    def term(self, predicate: bool = False):
        kind, value = self.next()
        if (kind, value) == ("op", "-") and self.peek()[0] == "num":
            return ("lit", "-" + self.next()[1])
        if kind == "var":
            return ("var", value[1:])
        if kind == "iri":
            return ("iri", value[1:-1])
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "num":
            return ("lit", value)
        if kind == "name":
            if predicate and value == "a":
                return ("iri", RDF_TYPE)
            prefix, colon, local = value.partition(":")
            if colon and prefix in self.prefixes:
                return ("iri", self.prefixes[prefix] + local)
        raise SparqlError(f"not a term: {value!r}")

    def either(self):
        left = self.both()
        while self.op("||"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.single()
        while self.op("&&"):
            left = ("and", left, self.single())
        return left

    def single(self):
        """A condition: a negation, EXISTS, a test, or a comparison of two values."""
        if self.op("!"):
            return ("not", self.single())
        if self.word("EXISTS"):
            return ("exists", self.group(), False)
        if self.peek()[1].upper() == "NOT" and self.tokens[self.i + 1 :][:1] and self.tokens[self.i + 1][1].upper() == "EXISTS":
            self.i += 2
            return ("exists", self.group(), True)
        left = self.sum()
        kind, value = self.peek()
        if kind == "op" and value in ("=", "!=", "<", "<=", ">", ">="):
            self.next()
            return ("cmp", value, left, self.sum())
        negated = self.word("NOT")
        if self.word("IN"):
            self.need("(")
            items = [self.sum()]
            while self.op(","):
                items.append(self.sum())
            self.need(")")
            return ("not", ("in", left, items)) if negated else ("in", left, items)
        return left

    def sum(self):
        left = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            left = ("arith", self.next()[1], left, self.product())
        return left

    def product(self):
        left = self.operand()
        while self.peek() in (("op", "*"), ("op", "/")):
            left = ("arith", self.next()[1], left, self.operand())
        return left

    def operand(self):
        kind, value = self.peek()
        if self.op("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.op("-"):
            return ("arith", "-", ("num", 0.0), self.operand())
        if kind == "num":
            self.next()
            return ("num", float(value))
        name = value.upper()
        if kind == "name" and self.tokens[self.i + 1 : self.i + 2] == [("op", "(")]:
            self.i += 2
            if name in AGGREGATES:
                distinct = self.word("DISTINCT")
                e = ("agg", name, None if self.op("*") else self.sum(), distinct)
            elif name in TESTS + VALUES:
                args = [self.either()]
                while self.op(","):
                    args.append(self.either())
                e = args[0] if name == "STR" else ("call", name, args)
            else:
                raise SparqlError(f"unknown function {name}")
            self.need(")")
            return e
        return self.term()


#: The columns of a solution by variable, with the numeric ones among them; aggregates stand under their own syntax.
Env = dict


def _env(df: DataFrame) -> Env:
    return {c: (F.col(c), t in ("double", "bigint", "int")) for c, t in df.dtypes}


def _variables(e) -> set[str]:
    """Variables of an expression; those of a group in EXISTS are its own."""
    if isinstance(e, tuple):
        if e[0] == "var":
            return {e[1]}
        return set() if e[0] == "exists" else set().union(*map(_variables, e[1:]), set())
    return set().union(*map(_variables, e)) if isinstance(e, list) else set()


def _value(e, env: Env) -> tuple[Column, bool]:
    """A value and whether it is a number."""
    kind = e[0]
    if kind == "var":
        if e[1] not in env:
            raise SparqlError(f"unknown variable ?{e[1]}")
        return env[e[1]]
    if kind == "num":
        return F.lit(e[1]), True
    if kind in ("lit", "iri"):
        return F.lit(e[1]), False
    if kind == "agg":
        if repr(e) not in env:
            raise SparqlError("an aggregate stands where none is allowed")
        return env[repr(e)]
    if kind == "arith":
        a, b = (_number(x, env) for x in e[2:])
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]], True
    if kind == "call" and e[1] in VALUES:
        return _called(e[1], e[2], env), e[1] in NUMERIC or e[1] in ("COALESCE", "IF") and all(_value(x, env)[1] for x in e[2][e[1] == "IF" :])
    return _condition(e, env), False


def _number(e, env: Env) -> Column:
    col, numeric = _value(e, env)
    return col.cast("double") if numeric else col.try_cast("double")


def _text(e, env: Env) -> Column:
    return _value(e, env)[0].cast("string")


def _called(name: str, args: list, env: Env) -> Column:
    if name in ("ABS", "FLOOR", "CEIL", "ROUND"):
        return {"ABS": F.abs, "FLOOR": F.floor, "CEIL": F.ceil, "ROUND": F.round}[name](_number(args[0], env)).cast("double")
    if name == "STRLEN":
        return F.length(_text(args[0], env)).cast("double")
    if name == "SUBSTR":
        whole = F.lit(2**31 - 1) if len(args) < 3 else _number(args[2], env).cast("int")
        return F.substring(_text(args[0], env), _number(args[1], env).cast("int"), whole)
    if name in ("UCASE", "LCASE"):
        return (F.upper if name == "UCASE" else F.lower)(_text(args[0], env))
    if name == "CONCAT":
        return F.concat(*[_text(x, env) for x in args])
    test = [_condition(args[0], env)] if name == "IF" else []
    values = [_value(x, env) for x in args[len(test) :]]
    if not all(n for _, n in values):
        values = [(c.cast("string"), n) for c, n in values]
    return F.when(test[0], values[0][0]).when(~test[0], values[1][0]) if test else F.coalesce(*[c for c, _ in values])


def _condition(e, env: Env) -> Column:
    kind = e[0]
    if kind == "or":
        return _condition(e[1], env) | _condition(e[2], env)
    if kind == "and":
        return _condition(e[1], env) & _condition(e[2], env)
    if kind == "not":
        return ~_condition(e[1], env)
    if kind == "exists":
        raise SparqlError("EXISTS stands alone or under && only")
    if kind == "in":
        return _any([("cmp", "=", e[1], x) for x in e[2]], env)
    if kind == "call" and e[1] in TESTS:
        if e[1] == "BOUND":
            return env[e[2][0][1]][0].isNotNull() if e[2][0][1] in env else F.lit(False)
        args = [_text(a, env) for a in e[2]]
        if e[1] == "REGEX":
            flags = "(?i)" if len(e[2]) > 2 and "i" in e[2][2][1] else ""
            return args[0].rlike(flags + e[2][1][1])
        return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[e[1]](args[0], args[1])
    if kind != "cmp":
        raise SparqlError(f"not a condition: {e[1]!r}")
    numeric = any(_value(x, env)[1] for x in e[2:])
    a, b = (_number(x, env) if numeric else _text(x, env) for x in e[2:])
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]


def _any(conditions: list, env: Env) -> Column:
    out = _condition(conditions[0], env)
    for c in conditions[1:]:
        out = out | _condition(c, env)
    return out


def _columns(df: DataFrame, terms: list[tuple[str, tuple]]) -> DataFrame:
    """Constants become pushed filters, variables columns; a variable used twice must agree."""
    names: dict[str, str] = {}
    for col, (kind, value) in terms:
        if kind != "var":
            df = df.filter(F.col(col) == value)
        elif value in names:
            df = df.filter(F.col(names[value]) == F.col(col))
        else:
            names[value] = col
    if not names:
        return df.select(F.lit(1).alias("__found")).limit(1).drop("__found")
    return df.select(*[F.col(c).alias(v) for v, c in names.items()])


def _recursive(path: tuple) -> bool:
    return path[0] in ("plus", "star", "opt") or any(_recursive(x) for x in (path[1] if path[0] in ("seq", "alt") else path[1:] if path[0] == "inv" else ()))


def _matched(pattern: tuple, triples: DataFrame, found: Solutions | None) -> tuple[DataFrame, Solutions | None]:
    """The solutions of one pattern. A path starts from the nodes that a constant or an earlier pattern gives its ends."""
    s, p, o = pattern
    if p[0] != "path":
        return _columns(triples, list(zip("spo", pattern))), found
    one = lambda value: triples.sparkSession.range(1).select(F.lit(value).alias("x"))
    seeds: list[DataFrame | None] = [one(t[1]) if t[0] != "var" else None for t in (s, o)]
    if _recursive(p[1]) and seeds == [None, None] and found is not None:
        end = next((k for k, t in enumerate((s, o)) if t[1] in found.sure), None)
        if end is not None:
            found = Solutions(written(found.df), found.sure)  # read twice: for the seeds and for the join
            seeds[end] = found.df.select(F.col((s, o)[end][1]).alias("x")).distinct()
    return _columns(path_pairs(p[1], triples, *seeds), [("s", s), ("o", o)]), found


def _ordered(patterns: list[tuple], bound: set[str]) -> list[tuple]:
    """Greedy: next comes the pattern that joins what is bound, with most constants and bound variables; paths that repeat come
    late, when their ends are bound."""
    left, out, bound = list(patterns), [], set(bound)
    while left:
        def rank(p):
            terms = [t for t in p if t[0] == "var"]
            joins = any(t[1] in bound for t in terms)
            path = p[1][0] == "path"
            fixed = sum(t[0] not in ("var", "path") for t in p)
            return (joins or not bound, not (path and _recursive(p[1][1])) or fixed > 0, fixed * 2 + sum(t[1] in bound for t in terms), p[0][0] != "var")

        best = max(left, key=rank)
        left.remove(best)
        out.append(best)
        bound |= {t[1] for t in best if t[0] == "var"}
    return out


def _values(names: list[str], rows: list[list], spark: SparkSession) -> Solutions:
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    return Solutions(df, {n for k, n in enumerate(names) if all(r[k] is not None for r in rows)})


def _united(groups: list[Group], triples: DataFrame) -> Solutions:
    sides = [_evaluate(x, triples)[0] for x in groups]
    df = sides[0].df
    for x in sides[1:]:
        df = df.unionByName(x.df, allowMissingColumns=True)
    return Solutions(df, set.intersection(*[x.sure for x in sides]))


def _conjuncts(e) -> list:
    if e[0] == "not" and e[1][0] == "exists":
        return [("exists", e[1][1], not e[1][2])]
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _tested(found: Solutions, tests: list) -> solutions.Condition | None:
    """The filters of an inner group that name variables outside of it, as a condition of the join with what is outside."""
    if not tests:
        return None
    numeric = {c: n for c, (_, n) in _env(found.df).items()}

    def condition(columns: dict[str, Column]) -> Column:
        env = {c: (col, numeric.get(c, False)) for c, col in columns.items()}
        out = _condition(tests[0], env)
        for e in tests[1:]:
            out = out & _condition(e, env)
        return out

    return condition


def _narrow(g: Group) -> bool:
    """Whether a constant, VALUES or a filter leaves fewer solutions than the patterns of a group have."""
    named = any(t[0] not in ("var", "path") for kind, *part in g.parts if kind == "bgp" for s, _, o in part[0] for t in (s, o))
    return named or any(kind == "values" for kind, *_ in g.parts) or any(e[0] != "exists" for x in g.filters for e in _conjuncts(x))


#: The values that a group around another one leaves for a variable, and how many they are.
Given = dict[str, tuple[DataFrame, int]]


def _given(g: Group, found: Solutions, inner: Group, tests: bool) -> tuple[Solutions, Given]:
    """What the solutions found in a narrow group give the variables of a group within it, which is asked for what agrees with them
    only: a variable of both, and (with tests) one that a filter of the inner group sets equal to one of the outer."""
    mine = {t[1] for kind, *part in inner.parts if kind == "bgp" for s, _, o in part[0] for t in (s, o) if t[0] == "var"}
    pairs = {v: v for v in mine & found.sure}
    for e in [c for x in inner.filters for c in _conjuncts(x)] if tests else []:
        if e[0] == "cmp" and e[1] == "=" and all(x[0] == "var" for x in e[2:]):
            for a, b in ((e[2][1], e[3][1]), (e[3][1], e[2][1])):
                if a in mine - set(found.df.columns) and b in found.sure and found.df.schema[b].dataType.simpleString() == "string":
                    pairs[a] = b
    if not pairs or not _narrow(g):
        return found, {}
    found = Solutions(written(found.df), found.sure)  # read for the values and for the join
    values = {v: written(found.df.select(F.col(w).alias(v)).distinct(), "given") for v, w in pairs.items()}
    return found, {v: (x, x.count()) for v, x in values.items()}


def _early(found: Solutions, filters: list) -> tuple[Solutions, list]:
    """The filters whose variables are all bound for good hold before optional parts as well as after them; the others are left."""
    left = []
    for e in filters:
        if e[0] != "exists" and _variables(e) and _variables(e) <= found.sure:
            found = Solutions(found.df.filter(_condition(e, _env(found.df))), found.sure)
        else:
            left.append(e)
    return found, left


def _evaluate(g: Group, triples: DataFrame, outer: frozenset[str] = frozenset(), given: Given | None = None) -> tuple[Solutions, list]:
    """The solutions of a group, and those of its filters that need variables of the group around it (outer). Patterns need only match
    the given values; they start from the variable that has fewest."""
    found: Solutions | None = None
    put = lambda x: x if found is None else solutions.join(found, x)
    given, filters = given or {}, [c for x in g.filters for c in _conjuncts(x)]
    for kind, *part in g.parts:
        if found is not None and kind in ("optional", "minus"):
            found, filters = _early(found, filters)
        if kind == "bgp":
            fewest = min(given, key=lambda v: (given[v][1], v), default=None)
            for p in _ordered(part[0], set(found.df.columns) if found else {fewest} if fewest else set()):
                df, found = _matched(p, triples, found)
                for v in [c for c in df.columns if c in given]:
                    df = df.join(given[v][0], v, "left_semi")
                found = put(Solutions(df, set(df.columns)))
        elif kind == "union":
            found = put(_united(part[0], triples))
        elif kind == "select":
            found = put(_selected(part[0], triples))
        elif kind == "values":
            found = put(_values(*part, triples.sparkSession))
        elif found is None:
            raise SparqlError(f"{kind.upper()} needs a pattern before it")
        elif kind == "optional":
            found, values = _given(g, found, part[0], True)
            inner, tests = _evaluate(part[0], triples, frozenset(found.df.columns), values)
            found = solutions.join(found, inner, "left", _tested(inner, tests))
        elif kind == "minus":
            found, values = _given(g, found, part[0], False)
            found = solutions.join(found, _evaluate(part[0], triples, given=values)[0], "minus")
        elif kind == "bind":
            e, name = part
            if name in found.df.columns:
                raise SparqlError(f"?{name} is bound already")
            found = Solutions(found.df.withColumn(name, _value(e, _env(found.df))[0]), found.sure)
    if found is None:
        raise SparqlError("a group needs a pattern")
    later = []
    found, filters = _early(found, filters)
    for e in filters:
        if e[0] == "exists":
            found, values = _given(g, found, e[1], True)
            inner, tests = _evaluate(e[1], triples, frozenset(found.df.columns), values)
            found = solutions.join(found, inner, "anti" if e[2] else "semi", _tested(inner, tests))
        elif _variables(e) - set(found.df.columns) and _variables(e) <= set(found.df.columns) | outer:
            later.append(e)
        else:
            found = Solutions(found.df.filter(_condition(e, _env(found.df))), found.sure)
    return found, later


def _aggregates(e) -> list:
    if isinstance(e, tuple):
        return [e] if e[0] == "agg" else [x for y in e[1:] for x in _aggregates(y)]
    return [x for y in e for x in _aggregates(y)] if isinstance(e, list) else []


def _aggregated(e, env: Env) -> Column:
    _, name, inner, distinct = e
    if name == "COUNT":
        col = F.lit(1) if inner is None else _value(inner, env)[0]
        return F.count_distinct(col) if distinct else F.count(col)
    if inner is None:
        raise SparqlError(f"{name} needs a variable")
    if name in ("SUM", "AVG"):
        number = _number(inner, env)
        return {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg}.get((name, distinct), lambda c: F.sum_distinct(c) / F.count_distinct(c))(number)
    return (F.min if name == "MIN" else F.max)(_value(inner, env)[0])


def _selected(q: Select, triples: DataFrame) -> Solutions:
    found, _ = _evaluate(q.where, triples)
    df = found.df
    named = [i for i in q.items if i[0] == "expr"]
    aggs = {repr(e): e for e in _aggregates([i[1] for i in named] + q.having)}
    whole = any(i[0] == "all" for i in q.items)
    visible = [c for c in df.columns if not c.startswith("__")]
    if aggs or q.group_by:
        if whole or any(i[0] == "var" and i[1] not in q.group_by for i in q.items):
            raise SparqlError("a selected variable is neither grouped nor aggregated")
        env = _env(df)
        for v in q.group_by:
            if v not in env:
                raise SparqlError(f"unknown variable ?{v}")
        if aggs:
            df = df.groupBy(*q.group_by).agg(*[_aggregated(e, env).alias(f"__a{k}") for k, e in enumerate(aggs.values())])
        else:
            df = df.select(*q.group_by).distinct()
        env = _env(df)
        env |= {key: env[f"__a{k}"] for k, key in enumerate(aggs)}
        for e in q.having:
            df = df.filter(_condition(e, env))
    else:
        if q.having:
            raise SparqlError("HAVING needs groups")
        env = _env(df)
    names = visible if whole else [i[1] if i[0] == "var" else i[2] for i in q.items]
    for _, e, name in named:
        df = df.withColumn(name, _value(e, env)[0])
        env[name] = (F.col(name), _env(df)[name][1])
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    order = [F.col(v).asc() if up else F.col(v).desc() for v, up in q.order_by]
    if order and not q.distinct:
        df = df.orderBy(*order)
    df = df.select(*names)
    if q.distinct:
        df = df.distinct()
        df = df.orderBy(*order) if order else df
    if q.offset:
        df = df.offset(q.offset)
    counts = {i[2] for i in named if i[1][0] == "agg" and i[1][1] == "COUNT"}
    return Solutions(df.limit(q.limit) if q.limit is not None else df, (found.sure | counts) & set(names))


def compile_select(q: Select, triples: DataFrame) -> DataFrame:
    return _selected(q, triples.select("s", "p", "o")).df


def sparql(query: str, triples: DataFrame) -> DataFrame:
    """The answer to a SELECT query over triples (s, p, o), a column for each variable. Statements with a null end match no pattern
    that names or joins that end; repeated statements give repeated answers, but for paths that repeat."""
    return compile_select(Parser(query).parse(), triples)

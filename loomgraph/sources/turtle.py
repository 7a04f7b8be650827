"""Turtle: a reader that cuts files at the ends of statements, many tasks a file, and one of whole files. The writer's blocks are
plans of their own (rdf.turtle)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.written import written

# Names of the vocabulary.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})"""
    r"""|(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"""
    r"""|(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-]))?)?)"""
    r"""|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_SIMPLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
COLUMNS = "s string, p string, o string, o_is_literal boolean, o_lang string, o_type string"


class TurtleError(ValueError):
    """The file is no Turtle from here on."""


def unescaped(text: str) -> str:
    """Escapes undone in one pass, so that an escaped backslash is no part of another one."""
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _SIMPLE.get(m[1], m[1]), text)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"cannot read {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]
    while True:
        yield "end", ""


class Reader:
    """Statements of one text: (s, p, o, o_is_literal, o_lang, o_type). Nodes without a name are numbered after `origin`."""

    def __init__(self, text: str, origin: str = "", base: str = ""):
        self.tokens, self.base, self.prefixes, self.found, self.nodes = _tokens(text), base, {}, [], 0
        self.origin = hashlib.md5(origin.encode()).hexdigest()[:8]
        self.kind, self.value = next(self.tokens)

    def take(self) -> tuple[str, str]:
        out = self.kind, self.value
        self.kind, self.value = next(self.tokens)
        return out

    def need(self, mark: str) -> None:
        if self.value != mark or self.kind != "mark":
            raise TurtleError(f"expected {mark!r}, found {self.value!r}")
        self.take()

    def node(self) -> str:
        self.nodes += 1
        return f"_:n{self.origin}-{self.nodes}"

    def iri(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            value = unescaped(value[1:-1])
            return urljoin(self.base, value) if self.base else value
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"not an IRI: {value!r}")

    def statements(self) -> Iterator[tuple]:
        while self.kind != "end":
            word = self.value.lower()
            if word in ("@prefix", "prefix") and self.kind in ("at", "word"):
                self.take()
                name = self.take()[1][:-1]
                self.prefixes[name] = self.iri()
                if word[0] == "@":
                    self.need(".")
            elif word in ("@base", "base") and self.kind in ("at", "word"):
                self.take()
                self.base = self.iri()
                if word[0] == "@":
                    self.need(".")
            else:
                alone = (self.kind, self.value) == ("mark", "[")
                s = self.term()[0]
                if not (alone and self.value == "."):
                    self.verbs(s)
                self.need(".")
            yield from self.found
            self.found = []

    def verbs(self, s: str) -> None:
        while True:
            if (self.kind, self.value) == ("word", "a"):
                self.take()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.found.append((s, p, *self.term()))
                if self.value != "," or self.kind != "mark":
                    break
                self.take()
            while (self.kind, self.value) == ("mark", ";"):
                self.take()
            if self.kind == "end" or self.kind == "mark" and self.value in ".]":
                return
            if self.kind not in ("iri", "name") and (self.kind, self.value) != ("word", "a"):
                raise TurtleError(f"not a predicate: {self.value!r}")

    def term(self) -> tuple[str, bool, str | None, str | None]:
        """(value, is a literal, language, type)."""
        if self.kind in ("iri", "name"):
            return self.iri(), False, None, None
        kind, value = self.take()
        if kind == "blank":
            return value, False, None, None
        if kind in ("text", "long"):
            text = unescaped(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "at":
                return text, True, self.take()[1][1:], None
            if self.kind == "type":
                self.take()
                return text, True, None, self.iri()
            return text, True, None, None
        if kind == "number":
            return value, True, None, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if kind == "word" and value in ("true", "false"):
            return value, True, None, XSD + "boolean"
        if (kind, value) == ("mark", "["):
            node = self.node()
            if self.value != "]":
                self.verbs(node)
            self.need("]")
            return node, False, None, None
        if (kind, value) == ("mark", "("):
            head = last = None
            while self.value != ")" or self.kind != "mark":
                item, node = self.term(), self.node()
                if last is None:
                    head = node
                else:
                    self.found.append((last, RDF + "rest", node, False, None, None))
                self.found.append((node, RDF + "first", *item))
                last = node
            self.take()
            if last is None:
                return RDF + "nil", False, None, None
            self.found.append((last, RDF + "rest", RDF + "nil", False, None, None))
            return head, False, None, None
        raise TurtleError(f"not a term: {value!r}")


def parse_turtle(text: str, origin: str = "") -> list[tuple]:
    return list(Reader(text, origin).statements())


#: What a line can go on with: nothing, a long string in double quotes, one in single quotes; and how these end.
PLAIN, DOUBLE, SINGLE = 0, 1, 2
_CLOSE = {DOUBLE: re.compile(r'(?:"{0,2}(?:[^"\\]|\\.))*?"{3}', re.S), SINGLE: re.compile(r"(?:'{0,2}(?:[^'\\]|\\.))*?'{3}", re.S)}


class Cutter:
    """Cuts lines at the ends of statements: the full stops that are marks of their own, and the IRI of a directive without one.
    A full stop never stands within brackets, so only strings need to be known."""

    def __init__(self, state: int = PLAIN):
        self.state, self.piece = state, []
        #: Tokens of the piece so far, as far as they tell a directive; None where its beginning is not known.
        self.words: list[str] | None = None

    def line(self, text: str) -> Iterator[str]:
        """The pieces that end in the line."""
        at = begin = 0
        while at < len(text):
            if self.state:
                m = _CLOSE[self.state].match(text, at)
                if not m:
                    break
                at, self.state = m.end(), PLAIN
                continue
            if text.startswith(('"""', "'''"), at):
                self.state, at = DOUBLE if text[at] == '"' else SINGLE, at + 3
                continue
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"cannot read {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup == "skip":
                continue
            if self.words is not None:
                self.words = [*self.words[:2], m[0]]
            directive = self.words is not None and self.words[0].lower() in ("prefix", "base") and m.lastgroup == "iri"
            if (m.lastgroup, m[0]) == ("mark", ".") or directive:
                yield "\n".join([*self.piece, text[begin:at]])
                self.piece, self.words, begin = [], [], at
        self.piece.append(text[begin:])

    def rest(self) -> str:
        return "\n".join(self.piece)


def _end_state(state: int, lines: list[str]) -> int:
    """What the lines after these go on with. Lines without three quotes change nothing."""
    cutter = Cutter(state)
    for text in lines:
        if '"""' in text or "'''" in text:
            for _ in cutter.line(text):
                pass
            cutter.piece = []
    return cutter.state


def _by_split(pdf_frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list[str]]]:
    """(path, start of the split, its lines) of rows that stand split by split."""
    now, lines = None, []
    for pdf in pdf_frames:
        for path, start, value in zip(pdf["path"], pdf["start"], pdf["value"]):
            if (path, start) != now:
                if now is not None:
                    yield *now, lines
                now, lines = (path, start), []
            lines.append(value)
    if now is not None:
        yield *now, lines


def _pieces(states: dict[tuple[str, int], int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, start, lines in _by_split(frames):
            cutter, out = Cutter(states[path, start]), []
            for text in lines:
                for piece in cutter.line(text):
                    out.append((path, start, len(out), "whole" if out else "head", piece))
            out.append((path, start, len(out), "tail" if out else "through", cutter.rest()))
            yield pd.DataFrame(out, columns=["path", "start", "seq", "kind", "text"])

    return run


def _directives(rows: list) -> dict[str, tuple[list[tuple[int, int]], list[str]]]:
    """By file: the places of its directives, and their texts, in order."""
    out: dict[str, tuple[list, list]] = {}
    for r in sorted(rows, key=lambda r: (r.path, r.start, r.seq)):
        places, texts = out.setdefault(r.path, ([], []))
        places.append((r.start, r.seq))
        texts.append(r.text)
    return out


def _parsed(directives: dict):
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}  # prefixes and base after so many directives of a file
        for pdf in frames:
            rows: list[tuple] = []
            for path, start, seq, text in zip(pdf["path"], pdf["start"], pdf["seq"], pdf["text"]):
                places, texts = directives.get(path, ([], []))
                n = bisect_left(places, (start, seq))
                if (path, n) not in known:
                    before = Reader("\n".join(texts[:n]))
                    list(before.statements())
                    known[path, n] = (before.prefixes, before.base)
                reader = Reader(text, f"{path}#{start}.{seq}", known[path, n][1])
                reader.prefixes = dict(known[path, n][0])
                rows.extend(reader.statements())
            yield pd.DataFrame(rows, columns=names)

    return run


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The statements of the Turtle files at a path, which may be a folder; names of blank nodes hold for all files of the path. Broken
    files raise.

    Files are read by splits of lines. A first pass finds in which long string, if any, each split begins (one small row a split is
    brought together); a second cuts splits into statements, where what a split begins and ends with is joined to its
    neighbours; directives, which are few, hold for what stands after them in their file. A statement is one row, and none is larger than
    its text."""
    source = spark.read.option("lineSep", "\n").text(path).selectExpr("value", "_metadata.file_path as path", "_metadata.file_block_start as start")

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for where, start, lines in _by_split(frames):
            yield pd.DataFrame([(where, start, *[_end_state(k, lines) for k in (PLAIN, DOUBLE, SINGLE)])], columns=["path", "start", "a", "b", "c"])

    states, now = {}, (None, PLAIN)
    for r in sorted(source.mapInPandas(ends, "path string, start long, a int, b int, c int").collect(), key=lambda r: (r.path, r.start)):
        state = now[1] if now[0] == r.path else PLAIN
        states[r.path, r.start] = state
        now = (r.path, (r.a, r.b, r.c)[state])
    cut = written(source.mapInPandas(_pieces(states), "path string, start long, seq long, kind string, text string"), "pieces")
    parts = cut.filter("kind <> 'whole'")
    # A split that holds an end closes what the splits before it left open; what it leaves open belongs to the next group.
    order = Window.partitionBy("path").orderBy("start")  # two rows a split
    closed = F.coalesce(F.sum((F.col("kind") == "tail").cast("long")).over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("part", closed + (F.col("kind") == "tail").cast("long"))
    joined = parts.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))).alias("x"), F.min(F.struct("start", "seq")).alias("at"))
    joined = joined.select("path", "at.start", "at.seq", F.array_join(F.transform("x", lambda t: t["text"]), "\n").alias("text"))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A directive without a full stop may have been joined to what follows it: the places after it are in between."""
        for pdf in frames:
            out = []
            for where, start, seq, text in zip(pdf["path"], pdf["start"], pdf["seq"], pdf["text"]):
                cutter = Cutter()
                cutter.words = []
                found = [p for line in text.split("\n") for p in cutter.line(line)] + [cutter.rest()]
                if cutter.state:
                    raise TurtleError(f"a string is not closed in {where}")
                out += [(where, start, seq, k, p) for k, p in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "start", "seq", "sub", "text"])

    own = "path string, start long, seq long, sub long, text string"
    every = cut.filter("kind = 'whole'").select("path", "start", "seq", F.lit(0).cast("long").alias("sub"), "text").unionByName(joined.mapInPandas(again, own))
    every = written(every.select("path", "start", (F.col("seq") * 1_000_000 + F.col("sub")).alias("seq"), "text"), "statements")
    directive = F.col("text").rlike(r"(?is)^(?:\s+|#[^\n]*\n)*@?(?:prefix|base)(?![\w:])")
    return every.filter(~directive).mapInPandas(_parsed(_directives(every.filter(directive).collect())), COLUMNS)


def read_whole_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The statements of the Turtle files at a path, which may be a folder. A file is read whole, in one task; names of blank
    nodes hold for all files of the path. Broken files raise. What `read_turtle` is held against."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
        for pdf in frames:
            for where, text in zip(pdf["path"], pdf["value"]):
                rows = []
                for row in Reader(text, where).statements():
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_path as path")
    return files.mapInPandas(run, COLUMNS)

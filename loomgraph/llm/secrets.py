"""Secret scans with a recursive decoding worklist.

Each text is the first layer. A layer is scanned for secrets, then unwrapped: all of its escapes (percent, Unicode, character
references) are undone once, which gives one further layer, and runs of base64, whole, wrapped over lines or with something in
front, give a layer for each readable part of their bytes and of what these bytes hold compressed, in any number of
wrappings. New layers go on the worklist until none is left; a layer whose digest was seen at the same place of the text is
not taken again, so cycles end, while copies of a layer are scanned at each of their places.

No escape begins within another, so they can be undone in any order and the fixpoint is one: a stack of characters takes
the text from left to right, and whenever its end is an escape, the character meant takes its place. Escapes of escapes are
undone layer by layer for ESCAPE_LAYERS layers, and what is left of deeper ones at once to the fixpoint, as a text of n
characters can hold n / 2 layers. Each base64 layer is shorter than its run, so these nest logarithmically deep. Compressed
data is taken whole (from 2 MB on in a mapped file), and a stream that is sound to its end is passed over as a whole, so that what it holds is
looked at once and not again at every magic number in it. Layers map spans to their parent's, so every span is in code points
of the original text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from array import array
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_rows
from .kernels import Texts, column, pieces

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

STARTER = re.compile(r"[%\\&]")
ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: What more characters may make an escape, and how long that is at most.
OPEN = re.compile(r"%[0-9A-Fa-f]?|\\(?:u(?:[0-9A-Fa-f]{0,3}|\{[0-9A-Fa-f]{0,6})|x[0-9A-Fa-f]?)?|&(?:#(?:[0-9]{0,7}|[xX][0-9A-Fa-f]{0,6}))?")
LONGEST = 11
#: Base64 of the first bytes of zlib and zstandard data, which can hold a secret in fewer than 22 characters.
PACKED = ("eAE", "eF4", "eJw", "eJx", "eJy", "eJz", "eNo", "eNp", "eNq", "eNr", "KLUv")
_B = "[A-Za-z0-9+/_-]"
BLOCK = re.compile(rf"(?<!{_B})(?:(?:{_B}{{40,}}[ \t]*\r?\n[ \t]*)+{_B}*={{0,2}}|{_B}{{22,}}={{0,2}}|{_B}*?(?:{'|'.join(PACKED)}){_B}{{9,}}={{0,2}})")
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: UTF-8 without control characters, long enough to hold a secret or an encoded one.
READABLE = re.compile(
    rb"(?:[\t-\r\x20-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){13,}+"
)
#: Decompressed bytes that are held in memory; longer data lies in a mapped file, and its readable parts are given out in pieces of
#: that size, which end at a byte that no secret or encoding holds. The other sizes are those of windows.
WINDOW, PART, SEPARATORS, HARD, OVERLAP = 2 << 20, 1 << 18, b",()<>|", 4 << 20, 64 << 10
SEPARATOR = re.compile(rb"[,()<>|]")
#: Layers of escapes within escapes that are scanned one by one.
ESCAPE_LAYERS = 64
#: Bytes by which a stream is known again that another one holds as it stands.
KNOWN = 64


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the secrets of one layer: leftmost, not overlapping within a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


class Layer:
    """A text and how its spans map to its parent's."""

    __slots__ = ("text", "parent", "spans", "made_by", "depth")

    def __init__(self, text: str, parent: Layer | None, spans, made_by: str):
        self.text, self.parent, self.spans, self.made_by = text, parent, spans, made_by
        #: How many layers of escapes were undone one after another to make it.
        self.depth = parent.depth + 1 if parent is not None and made_by == "unescaped" else 0

    def to_source(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.spans(start, end)
            layer = layer.parent
        return start, end

    def path(self) -> str:
        """How the layer was made, outermost first; escapes undone in turn are one step."""
        steps, layer = [], self
        while layer is not None:
            if layer.depth < 2:
                steps.append(layer.made_by)
            layer = layer.parent
        return ">".join(reversed(steps))


class Unescaper:
    """A text with its escapes undone, once or to their fixpoint: characters are taken from left to right on a stack, with the
    source span of each. Bytes from 128 on are kept as negative numbers until their neighbours are known."""

    def __init__(self, text: str, once: bool = False):
        self.source, self.changed, self.once = text, False, once
        self.parts: list[str] = []
        # Stretches of the result: where each begins, its source span, and whether it is the source as it stands.
        self.begin, self.src, self.end, self.same = array("q"), array("q"), array("q"), bytearray()
        self.size = 0
        self.codes, self.at, self.to = array("i"), array("q"), array("q")
        self.open: list[int] = []  # places of the starters on the stack that may still become an escape
        i, n = 0, len(text)
        while i < n:
            if not self.open and text[i] not in "%&\\":
                self.flush()
                m = STARTER.search(text, i)
                j = m.start() if m else n
                self.add(text[i:j], i, j, True)
                i = j
                if i == n:
                    break
            self.push(ord(text[i]), i, i + 1)
            i += 1
        self.flush()

    def push(self, code: int, at: int, to: int) -> None:
        codes, undone = self.codes, False
        while True:
            codes.append(code)
            self.at.append(at)
            self.to.append(to)
            if undone and self.once:  # what an escape gives is no part of another one in the same layer
                self.open.clear()
                return
            if code in (37, 38, 92):
                self.open.append(len(codes) - 1)
                return
            while self.open:
                p = self.open[-1]
                if len(codes) - p <= LONGEST:
                    tail = "".join(chr(c) if c >= 0 else "\ufffd" for c in codes[p:])
                    m = ESCAPE.fullmatch(tail)
                    if m:
                        code = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
                        if code < 0x110000 and (m.lastindex in (1, 2) or not 0xD800 <= code < 0xE000):
                            break
                    elif OPEN.fullmatch(tail):
                        return
                self.open.pop()
            else:
                return
            if m.lastindex == 1 and code >= 128:
                code = -code
            at, to, self.changed, undone = self.at[p], self.to[-1], True, True
            self.open.pop()
            del codes[p:], self.at[p:], self.to[p:]

    def add(self, text: str, at: int, to: int, same: bool) -> None:
        if not (same and self.same and self.same[-1] and self.end[-1] == at):
            self.begin.append(self.size)
            self.src.append(at)
            self.end.append(to)
            self.same.append(same)
        else:
            self.end[-1] = to
        self.parts.append(text)
        self.size += len(text)

    def flush(self) -> None:
        """Move the stack to the result: bytes to the characters that they spell, halves of a pair together."""
        codes, at, to = self.codes, self.at, self.to
        i, n = 0, len(codes)
        while i < n:
            c = codes[i]
            j = i + 1
            if c < 0:
                while j < n and codes[j] < 0:
                    j += 1
                raw = bytes(-x for x in codes[i:j])
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = raw.decode("latin-1")
                k = i
                for char in text:
                    wide = len(char.encode()) if len(text) < len(raw) else 1
                    self.add(char, at[k], to[k + wide - 1], False)
                    k += wide
            elif 0xD800 <= c < 0xDC00 and j < n and 0xDC00 <= codes[j] < 0xE000:
                self.add(chr(0x10000 + (c - 0xD800 << 10) + codes[j] - 0xDC00), at[i], to[j], False)
                j += 1
            elif 0xD800 <= c < 0xE000:
                self.add("\ufffd", at[i], to[i], False)
            else:
                self.add(chr(c), at[i], to[i], to[i] == at[i] + 1)
            i = j
        del codes[:], at[:], to[:]

    def spans(self, start: int, end: int) -> tuple[int, int]:
        a, b = bisect_right(self.begin, start) - 1, bisect_right(self.begin, end - 1) - 1
        first = self.src[a] + (start - self.begin[a]) if self.same[a] else self.src[a]
        return first, self.src[b] + (end - self.begin[b]) if self.same[b] else self.end[b]


class Inflated:
    """Decompressed parts of the gzip, zlib, bzip2, xz or zstandard data from begin on, as far as it is sound. Once they are
    taken, end is where the data ends, if it is sound to its end and tells so."""

    def __init__(self, raw, begin: int):
        self.raw, self.begin, self.end = raw, begin, None

    def __iter__(self):
        first, left = self.raw[self.begin], memoryview(self.raw)[self.begin :]
        try:
            if first == 0x28:
                yield from iter(lambda r=zstandard.ZstdDecompressor().stream_reader(left): r.read(PART), b"")
                return
            plain = first in (0x1F, 0x78)
            d = zlib.decompressobj(47) if plain else bz2.BZ2Decompressor() if first == 0x42 else lzma.LZMADecompressor()
            some, at = b"", 0
            while not d.eof:
                if not some and (plain or d.needs_input):
                    some = left[at : at + PART]
                    at += len(some)
                    if not len(some) and not plain:
                        break
                part = d.decompress(some, PART)
                if not len(some) and not part and not d.eof and plain:
                    break
                some = d.unconsumed_tail if plain else b""
                if part:
                    yield part
            if d.eof:
                self.end = self.begin + at - len(d.unused_data)
        except (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError, ValueError):
            return


def inflate(raw, begin: int):
    """The parts of Inflated."""
    return iter(Inflated(raw, begin))


def whole(parts):
    """All parts together: bytes, or from WINDOW bytes on a file of the task's own that is mapped and gone with its last user. No part of
    a scan sees data cut, so that what lies in it, streams in streams among it, is found at any length."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > WINDOW:
            break
    if size <= WINDOW:
        return b"".join(held) if size else None
    with tempfile.TemporaryFile() as spool:
        for part in chain(held, parts):
            spool.write(part)
        spool.flush()
        return mmap.mmap(spool.fileno(), 0, access=mmap.ACCESS_READ)


def separated(data, start: int, end: int):
    """The bytes from start to end in parts that end at a byte that no secret or encoding holds: of WINDOW bytes or little more, longer
    only where no such byte comes."""
    while end - start > WINDOW and (m := SEPARATOR.search(data, start + WINDOW - 1, end)):
        yield data[start : m.end()]
        start = m.end()
    if start < end:
        yield data[start:end]


def windows(parts):
    """A bounded view of the parts, for looking at data in passing (scans take it whole): windows that end at separators but for the
    last. Where there is none for long, a window is cut anywhere, and the next begins with its last bytes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= WINDOW and (last := max(part.rfind(c) for c in SEPARATORS)) >= 0:
            held[-1] = part[: last + 1]
            yield b"".join(held)
            held, size = [part[last + 1 :]], len(part) - last - 1
        elif size >= HARD:
            whole = b"".join(held)
            yield whole
            held, size = [whole[-OVERLAP:]], OVERLAP
    if size:
        yield b"".join(held)


def _gzip_head(raw, begin: int) -> int:
    """Where the names and remarks of a gzip header end, which are no part of what it holds."""
    at, flags = begin + 10, raw[begin + 3] if len(raw) > begin + 3 else 0
    if flags & 4:
        at += 2 + int.from_bytes(raw[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            at = raw.find(0, at) + 1 or len(raw)
    return min(at, len(raw))


class _Window:
    """Bytes whose streams are looked for from `at` on, and whose readable parts have been given up to `gap`. given holds the first
    bytes of streams that stand as they are in what a broken stream of it holds: they are looked at there."""

    __slots__ = ("data", "at", "gap", "given")

    def __init__(self, data: bytes):
        self.data, self.at, self.gap, self.given = data, 0, 0, set()

    def next_stream(self) -> int | None:
        while hit := MAGIC.search(self.data, self.at):
            self.at = hit.start() + 1
            if self.data[hit.start() : hit.start() + KNOWN] not in self.given:
                return hit.start()
        return None

    def readable(self, end: int, after: int):
        """The readable parts before end; the next ones are those from after on."""
        for m in READABLE.finditer(self.data, self.gap, end):
            yield from separated(self.data, *m.span())
        self.gap = self.at = after


class _Stream:
    """A stream of a window (of the first bytes, if that is None) and all that it holds."""

    __slots__ = ("source", "begin", "inflated", "window")

    def __init__(self, source: _Window | None, data: bytes, begin: int):
        self.source, self.begin, self.inflated = source, begin, Inflated(data, begin)
        self.window = whole(iter(self.inflated))


def unpacked(raw: bytes, begin: int, tell: list[int]):
    """The readable parts of what the compressed data from begin on holds, and of what is compressed in that, at any depth. tell takes
    where the data ends, if it is known.

    A stack holds windows that may have more streams, and the stream to be looked at next. With the last stream of a window, that
    window goes, so that streams in streams do not pile up."""
    stack: list[_Window | _Stream] = [_Stream(None, raw, begin)]
    while stack:
        top = stack[-1]
        if isinstance(top, _Window):
            start = top.next_stream()
            if start is None:
                stack.pop()
                yield from top.readable(len(top.data), len(top.data))
            else:
                stack.append(_Stream(top, top.data, start))
            continue
        window, source, end = top.window, top.source, top.inflated.end
        stack.pop()
        if window is not None and source is not None and not end:
            source.given.update(window[m.start() : m.start() + KNOWN] for m in MAGIC.finditer(window) if len(window) - m.start() >= KNOWN)
        if source is None:
            tell += [end] if end else []
        else:
            if end:
                head = _gzip_head(source.data, top.begin) if source.data[top.begin] == 0x1F else top.begin
                yield from source.readable(head, end)
            if not MAGIC.search(source.data, source.at):
                stack.pop()
                yield from source.readable(len(source.data), len(source.data))
        if window is not None:
            stack.append(_Window(window))
        del top, source, window


def _whole(start: int, end: int):
    return lambda a, b: (start, end)


def _block(layer: Layer, m: re.Match):
    """Layers of one run of base64: of each of its four alignments, as nothing tells where the data in it begins; of the
    first alone if that is readable from end to end."""
    run = m[0].rstrip("=")
    wrapped = "\n" in run
    where = np.flatnonzero(~np.isin(np.frombuffer(run.encode(), dtype=np.uint8), (9, 10, 13, 32))) + m.start() if wrapped else None
    body = "".join(run.split()) if wrapped else run
    body = body.replace("-", "+").replace("_", "/")
    place = (lambda i: int(where[i])) if wrapped else (lambda i: m.start() + i)
    for phase in range(4):
        some = body[phase:]
        some = some[: len(some) - (len(some) % 4 == 1)]
        if not some:
            return
        raw = binascii.a2b_base64(some + "=" * (-len(some) % 4))

        def span(a: int, b: int, phase=phase, size=len(raw)) -> tuple[int, int]:
            """The source of the bytes a to b."""
            return place(phase + a * 4 // 3), m.end() if b == size else place(phase + -(-b * 4 // 3) - 1) + 1

        for found in READABLE.finditer(raw):
            text = found[0].decode()
            if len(text) == len(found[0]):
                byte = range(found.start(), found.end() + 1)
            else:
                data = np.frombuffer(found[0], dtype=np.uint8)
                byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)) + found.start()
            yield Layer(text, layer, lambda a, b, byte=byte, span=span: span(int(byte[a]), int(byte[b])), "base64")
            if phase == 0 and len(found[0]) == len(raw):
                return
        at = 0
        while hit := MAGIC.search(raw, at):
            ends: list[int] = []
            spans = _whole(*span(hit.start(), len(raw)))
            for found in unpacked(raw, hit.start(), ends):
                yield Layer(found.decode(), layer, spans, "base64>compressed")
            at = ends[0] if ends else hit.start() + 1


def unwrap(layer: Layer):
    if STARTER.search(layer.text):
        plain = Unescaper(layer.text, once=layer.depth < ESCAPE_LAYERS)
        if plain.changed:
            yield Layer("".join(plain.parts), layer, plain.spans, "unescaped")
            del plain
    for m in BLOCK.finditer(layer.text):
        yield from _block(layer, m)


def find_secrets(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, layers) of all secrets, the text's own first; spans are of the text."""
    root = Layer(text, None, None, "text")
    found = {s: "text" for s in (scan(text) if base is None else base)}
    digest = lambda x: hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    seen = {(digest(root), 0, len(text))}
    work = [unwrap(root)]  # layers are made one at a time, when their turn comes
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = (digest(layer), *layer.to_source(0, len(layer.text))) if layer.text else None
        if key is None or key in seen:
            continue
        seen.add(key)
        for start, end, kind in scan(layer.text):
            found.setdefault((*layer.to_source(start, end), kind), layer.path())
        work.append(unwrap(layer))
    return [(*k, v) for k, v in sorted(found.items(), key=lambda x: (x[0][0], x[0][2], x[0][1]))]


_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_HEXRUN = np.zeros(256, dtype=bool)
_HEXRUN[[ord(c) for c in "0123456789abcdef"]] = True
#: Lower-case bytes without which a text has no assignment, key or escape.
_PACKED = re.compile("|".join(PACKED).encode())
HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey", b"akia", b"%", b"\\u", b"\\x", b"&#")


def long_runs(texts: Texts, member: np.ndarray, least: int) -> np.ndarray:
    """Rows with a run of `least` or more bytes of the set."""
    inside = np.zeros(len(texts.data) + 2, dtype=np.int8)
    inside[1:-1] = member[texts.data]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    ok = end - begin >= least
    # A run over the border of two rows may be short in each; both are looked at then.
    return np.unique(np.concatenate([np.searchsorted(texts.offs, begin[ok], side="right") - 1, np.searchsorted(texts.offs, end[ok] - 1, side="right") - 1, _between(texts, begin[ok], end[ok])]))


def _between(texts: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    a, b = np.searchsorted(texts.offs, begin, side="right"), np.searchsorted(texts.offs, end - 1, side="right") - 1
    wide = np.flatnonzero(b > a)
    return np.concatenate([np.arange(a[i], b[i]) for i in wide]) if len(wide) else np.zeros(0, np.int64)


def suspects(texts: Texts) -> np.ndarray:
    """Rows that can hold a secret or an encoded layer; all others have none, whatever is decoded."""
    rows = [long_runs(texts, _RUN, 22), long_runs(texts, _HEXRUN, 16)]
    low = texts.data.tobytes().lower()
    for hint in HINTS:
        at, hits = low.find(hint), []
        while at >= 0:
            row = int(np.searchsorted(texts.offs, at, side="right")) - 1
            hits.append(row)
            at = low.find(hint, int(texts.offs[row + 1]))
        rows.append(np.array(hits, dtype=np.int64))
    raw = texts.data.tobytes()
    for m in _PACKED.finditer(raw):
        rows.append(np.array([np.searchsorted(texts.offs, m.start(), side="right") - 1], dtype=np.int64))
    return np.unique(np.concatenate(rows))


SPAN = "struct<start:int,end:int,kind:string,layers:string>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, base and spans, arrays of (start, end, kind, layers) in code points.

    base holds the spans of the text itself, spans these and what decoded layers add; both by
    start, then kind (assign, access, hex), then end. With `redact`, the further column redacted
    is the text with every span (overlapping ones as one) replaced by it; null stays null there.
    Null texts count as empty and have no spans. Null ids and repeated rows are kept as they are;
    empty tables give an empty result, other columns are ignored but for those named in carry. Texts of any length are scanned
    whole, and so is what is decompressed: beyond 2 MB it takes room on the worker's disk, and memory for stretches without separators.
    """
    arrow_rows(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("layers", pa.string())]))

    def run(batches):
        for b in pieces(batches, "text"):
            texts = Texts(column(b, "text"))
            base: list[list] = [[] for _ in range(len(b))]
            spans: list[list] = [[] for _ in range(len(b))]
            cleaned = column(b, "text").to_pylist() if redact is not None else None
            for i in suspects(texts).tolist():
                text = texts.row(i).decode("utf-8", "replace")
                own = scan(text)
                every = find_secrets(text, own)
                base[i] = [{"start": s, "end": e, "kind": KINDS[k], "layers": "text"} for s, e, k in own]
                spans[i] = [{"start": s, "end": e, "kind": KINDS[k], "layers": how} for s, e, k, how in every]
                if cleaned is not None and every:
                    parts, at, stop = [], 0, -1
                    for s, e, *_ in every:
                        if s >= stop:
                            parts += [text[max(at, 0) : s], redact]
                        stop = at = max(stop, e)
                    cleaned[i] = "".join([*parts, text[at:]])
            out = [column(b, "doc_id"), pa.array(base, kind), pa.array(spans, kind)]
            names = ["doc_id", "base", "spans"]
            if cleaned is not None:
                out, names = [*out, pa.array(cleaned, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(out + [column(b, f"carry_{c}") for c in carry], names=names + list(carry))

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"carry_{c}") for c in carry])
    more = (", redacted string" if redact is not None else "") + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return src.mapInArrow(run, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>{more}")


def as_text(spans: str):
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

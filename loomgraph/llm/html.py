"""HTML extraction by union-free regular-expression inference.

A page becomes a tree of elements and text slots. Its children are folded: equal neighbours, and
groups of up to four elements that follow each other again, become one repeated child. Pages of a
host are then aligned one after the other: children with one key are aligned and merged, a child
that one side lacks becomes optional, a child or group repeated on one side repeated. No
alternatives are ever formed, so the wrapper of a host is a union-free regular expression.

Every page of a host is then matched with the final wrapper, which names the slot of every text, and
the slots are judged over all pages: how many different texts they hold on different pages, and how
much of them is linked. A wrapper's slots are kept or left out by that; what its elements are called
is a prior, which counts where too few pages speak against it. The main text of a page is what it has
in the kept slots of its host's wrapper, and nothing else.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_rows, cut
from .kernels import column, pieces

#: Signatures merged in one task at a time, and the size up to which wrappers are sent to all executors.
MERGE_FAN, BROADCAST_BYTES = 64, 16 << 20
#: Pages with different contents from which on a slot can be template text, and the share of them with one text that makes
#: it so: outside of articles and within, where what stays the same may also be said again.
TEMPLATE, TEMPLATE_IN_ARTICLE = (3, 0.6), (5, 0.9)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*\Z", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
WORD = re.compile(r"[a-z0-9]+")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form menu dialog button select option svg canvas audio video object map script style textarea title noscript template iframe".split())
ROLES_LEFT_OUT = frozenset("@navigation @banner @contentinfo @complementary @search @form @dialog @alert @menu @menubar @toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of parts that are no article, and words beside them that make the name no other: `share-buttons`, but not `share-price`.
SUSPECT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal overlay newsletter"
    " subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus reply replies share sharing social related"
    " recommended recommendations widget toolbar pagination pager login search skip masthead".split()
)
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons center col column container depth even first fixed form group head header heading icon icons inner item"
    " items last layout left link links list main meta module odd outer page panel post posts primary right row section secondary site slot text thread title top unit wrap wrapper".split()
)


class Node:
    __slots__ = ("key", "many", "kids", "texts")

    def __init__(self, key: str, many: str = "", kids: list[Node] | None = None):
        self.key, self.many, self.kids, self.texts = key, many, kids if kids is not None else [], []


def inorder(root: Node) -> list[Node]:
    """All nodes, each before its kids and these in order; no recursion, as pages nest as deep as they like."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.kids))
    return out


def as_text(root: Node) -> str:
    return json.dumps([[n.key, n.many, len(n.kids)] for n in inorder(root)], separators=(",", ":"))


def from_text(text: str) -> Node:
    root = Node("")
    open_: list[list] = [[root, 1]]
    for key, many, kids in json.loads(text):
        while not open_[-1][1]:
            open_.pop()
        open_[-1][1] -= 1
        node = Node(key, many)
        open_[-1][0].kids.append(node)
        open_.append([node, kids])
    return root.kids[0]


def element_key(tag: str, attrs: str) -> str:
    """tag, with its class and id words and its role (marked by @): what makes elements the same in a template."""
    if not attrs or attrs.isspace():
        return tag
    words: set[str] = set()
    for name, value in ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop"):
            mark = "@" if name.lower() == "role" else ""
            words |= {mark + w for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if not w.isdigit()}
    return f"{tag}.{'.'.join(sorted(words))}" if words else tag


def parse(html: str) -> Node:
    """The tree of a page: block elements and text runs (`#`, with the pieces (text, linked) in texts).

    End tags that are left out are implied as in HTML; raw elements keep no text; inline elements
    only mark links."""
    root = Node("")
    stack, link, at, low = [root], 0, 0, None
    opened: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw:
            kids = stack[-1].kids
            if not kids or kids[-1].key != "#":
                kids.append(Node("#"))
            kids[-1].texts.append((raw, link > 0))

    def close(tag: str) -> None:
        while opened[tag]:
            top = stack.pop().key.split(".", 1)[0]
            opened[top] -= 1
            if top == tag:
                return

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[6] or m[9]  # a whole tag, one with an open quote, one that the page ends in
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[5] or m[8]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag not in INLINE:
                close(tag)
            continue
        if m[9]:
            continue  # cut off within the tag
        if tag in RAW:
            if low is None:
                low = html.lower()
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
            continue
        if tag in INLINE:
            if tag == "a":
                link += 1
            elif tag == "br":
                text(" ")
            continue
        top = stack[-1].key.split(".", 1)[0]
        if tag in CLOSED_BY_BLOCK and top == "p":
            close(top)
        elif tag in ("li", "option", "tr", "td", "th", "dt", "dd") and top in ({"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else {tag, "td", "th"} if tag == "tr" else {tag, "p"}):
            close(top)
            if stack[-1].key.split(".", 1)[0] == tag:
                close(tag)
        node = Node(element_key(tag, m[3] or m[7] or ""))
        stack[-1].kids.append(node)
        link = 0 if tag in CLOSED_BY_BLOCK else link
        if tag not in VOID and not m[4]:
            stack.append(node)
            opened[tag] += 1
    text(html[at:])
    return root


def blank(node: Node) -> bool:
    return node.key == "#" and not any(t.strip() for t, _ in node.texts)


def join_many(a: str, b: str) -> str:
    """Multiplicity that holds both: '' once, ? at most once, + once or more, * any."""
    none, more = a in "?*" and a != "" or b in "?*" and b != "", a in "+*" and a != "" or b in "+*" and b != ""
    return {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[none, more]


def fold(root: Node) -> Node:
    """The tree with repeats folded, the deepest first."""
    done: dict[int, Node] = {}
    for node in reversed(inorder(root)):
        done[id(node)] = Node(node.key, node.many, fold_kids([done.pop(id(k)) for k in node.kids if not blank(k)]))
        for k in node.kids:
            done.pop(id(k), None)
    return done[id(root)]


def fold_kids(kids: list[Node]) -> list[Node]:
    """Kids with repeats folded: neighbours with one key become one `+`, and so do groups of two to four."""
    out: list[Node] = []
    for mine in kids:
        if out and out[-1].key == mine.key:
            out[-1] = merge(out[-1], mine)
            out[-1].many = join_many(out[-1].many, "+")
        else:
            out.append(mine)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            keys = [k.key for k in out[i : i + period]]
            times = 1
            while [k.key for k in out[i + times * period : i + (times + 1) * period]] == keys:
                times += 1
            if times > 1:
                group = Node("()" + " ".join(keys), "", out[i : i + period])
                for t in range(1, times):
                    group = merge(group, Node(group.key, "", out[i + t * period : i + (t + 1) * period]))
                group.many = "+"
                out[i : i + times * period] = [group]
            i += 1
    return out


def gather(kids: list[Node], groups: list[Node]) -> list[Node]:
    """kids with single occurrences of the other side's groups put together, so that they align."""
    for g in groups:
        keys = [k.key for k in g.kids]
        for i in range(len(kids) - len(keys) + 1):
            if [k.key for k in kids[i : i + len(keys)]] == keys:
                kids = [*kids[:i], Node(g.key, "", kids[i : i + len(keys)]), *kids[i + len(keys) :]]
                break
    return kids


def aligned(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """The children of two sides in one order: a longest common sequence of keys, and between its members what one side has alone."""
    head = 0
    while head < min(len(a), len(b)) and a[head].key == b[head].key:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].key == b[-1 - tail].key:
        tail += 1
    middle = common(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*zip(a[:head], b[:head]), *middle, *zip(a[len(a) - tail :], b[len(b) - tail :])]


def common(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """x and y along a longest common sequence of their keys. A row of the table is a number whose bits tell where the
    length of that sequence does not grow, so a row takes one addition however wide it is."""
    where: dict[str, int] = {}
    for i, n in enumerate(x):
        where[n.key] = where.get(n.key, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]
    for n in y:
        v = rows[-1]
        u = v & where.get(n.key, 0)
        rows.append((v + u | v - u) & full)
    out: list[tuple[Node | None, Node | None]] = []
    i, j = len(x), len(y)
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
            out.append((x[i], None))
        elif not rows[j - 1] >> i - 1 & 1:
            j -= 1
            out.append((None, y[j]))
        else:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
    return [*((n, None) for n in x[:i]), *((None, n) for n in y[:j]), *reversed(out)]


def merge(a: Node, b: Node) -> Node:
    """The least union-free expression found for two of one key."""
    out = Node(a.key, join_many(a.many, b.many))
    stack = [(a, b, out)]
    while stack:
        a, b, into = stack.pop()
        ka = gather(a.kids, [k for k in b.kids if k.key.startswith("()")])
        kb = gather(b.kids, [k for k in ka if k.key.startswith("()")])
        for x, y in aligned(ka, kb):
            if x is not None and y is not None:
                into.kids.append(Node(x.key, join_many(x.many, y.many)))
                stack.append((x, y, into.kids[-1]))
            else:
                one = x if x is not None else y
                into.kids.append(Node(one.key, join_many(one.many, "?"), one.kids))
    return out


def signature(root: Node) -> str:
    """The page's own wrapper as text."""
    return as_text(fold(root))


def merge_all(signatures: list[str]) -> str:
    """The wrapper of several, merged in a fixed order."""
    wrapper = from_text(signatures[0])
    for s in signatures[1:]:
        wrapper = merge(wrapper, from_text(s))
    return as_text(wrapper)


class Wrapper:
    """A wrapper whose nodes are numbered in order; the numbers of its text nodes are the slots."""

    def __init__(self, text: str):
        self.nodes = inorder(from_text(text))
        number = {id(n): i for i, n in enumerate(self.nodes)}
        self.parent = [-1] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            for k in n.kids:
                self.parent[number[id(k)]] = i
        # The elements within each, groups opened, by their keys: places among them, and numbers.
        self.within: list[dict[str, list[tuple[int, int]]]] = []
        for n in self.nodes:
            keys: dict[str, list[tuple[int, int]]] = {}
            flat, stack = 0, list(reversed(n.kids))
            while stack:
                k = stack.pop()
                if k.key.startswith("()"):
                    stack.extend(reversed(k.kids))
                else:
                    keys.setdefault(k.key, []).append((flat, number[id(k)]))
                    flat += 1
            self.within.append(keys)

    def match(self, page: Node) -> list[tuple[int, Node]]:
        """(slot, text) of a page in order; -1 for texts that the wrapper has no place for.

        Children follow the wrapper's; runs that repeat a group go round them again. Where several children of the wrapper
        have a kid's key, all are followed, those from the current place on first, and a text takes the first that has it."""
        out: list[tuple[int, Node]] = []
        stack: list[tuple[Node, list[int]]] = [(page, [0])]
        while stack:
            node, spots = stack.pop()
            if node.key == "#":
                out.append((spots[0] if spots else -1, node))
                continue
            found: list[tuple[Node, list[int]]] = []
            place, last = 0, ""
            for kid in node.kids:
                if blank(kid):
                    continue
                if kid.key == last:
                    found.append((kid, found[-1][1]))
                    continue
                last = kid.key
                mine: list[int] = []
                for at in spots:
                    there = self.within[at].get(last, ())
                    k = bisect_left(there, (place, -1)) if at == spots[0] else 0
                    mine += [number for _, number in (*there[k:], *there[:k])]
                    if at == spots[0] and there:
                        place = there[k % len(there)][0] + 1
                found.append((kid, mine))
            stack.extend(reversed(found))
        return out

    def roles(self) -> list[tuple[str, int, bool]]:
        """For each node: its level by what holds it (out; article, main, or open), the outermost element around it with a
        suspect name (-1: none), and whether it is in a heading."""
        out: list[tuple[str, int, bool]] = []
        for i, n in enumerate(self.nodes):
            level, suspect, heading = out[self.parent[i]] if i else ("open", -1, False)
            tag, _, more = n.key.partition(".")
            words = set(more.split(".")) if more else set()
            names = {w for w in words if not w.startswith("@")}
            if tag in LEFT_OUT or words & ROLES_LEFT_OUT or tag == "header" and level == "open":
                level = "out"
            elif suspect < 0 and tag not in HEADINGS and names <= SUSPECT | NEUTRAL and (names & SUSPECT or "header" in names and level == "open"):
                suspect = i
            if level != "out" and (tag == "article" or "@article" in words):
                level = "article"
            elif level == "open" and (tag == "main" or "@main" in words):
                level = "main"
            out.append((level, suspect, heading or tag in HEADINGS))
        return out

    def kept(self, facts: dict[int, tuple[int, int, int, int]]) -> dict[str, list[int]]:
        """The slots kept of each level (article, main, open), given (texts on pages, pages of the commonest text, characters,
        linked characters) of each slot over the host's pages."""
        roles = self.roles()
        open_: dict[int, tuple[str, int, int]] = {}
        for slot, (pages, top, chars, linked) in facts.items():
            level, suspect, heading = roles[slot]
            least, share = TEMPLATE_IN_ARTICLE if level == "article" else TEMPLATE
            template = pages >= least and top >= share * pages and not (heading and level == "article")
            links = level != "article" and 2 * linked > chars
            if level != "out" and not template and not links:
                open_[slot] = (level, suspect, chars - linked)
        total = sum(size for *_, size in open_.values())
        several = max((pages for pages, *_ in facts.values()), default=0) >= TEMPLATE[0]
        named: Counter[int] = Counter()
        for _, suspect, size in open_.values():
            named[suspect] += size
        # What holds most of the text that differs from page to page is no boilerplate, whatever its name.
        good = lambda suspect: suspect < 0 or several and 2 * named[suspect] > total
        return {x: sorted(s for s, (level, suspect, _) in open_.items() if level == x and good(suspect)) for x in ("article", "main", "open")}


def clean(node: Node) -> str:
    return " ".join(unescape("".join(t for t, _ in node.texts)).split())


def main_blocks(found: list[tuple[int, Node]], kept: dict[str, list[int]]) -> list[str]:
    """Texts in the kept slots in articles; of a page without any, those in main elements; else all kept ones."""
    texts = [(s, clean(n)) for s, n in found]
    for level in ("article", "main", "open"):
        mine = set(kept[level])
        blocks = [t for s, t in texts if s in mine and t]
        if blocks:
            return blocks
    return []


def _describe(batches):
    """host and signature of each page."""
    for b in pieces(batches, "html"):
        sig = [signature(parse(html or "")) for html in column(b, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(b, "host"), pa.array(sig, pa.string())], names=["host", "sig"])


class _Wrappers:
    """The wrappers that a task has met last."""

    def __init__(self):
        self.known: dict[str, Wrapper] = {}

    def get(self, text: str) -> Wrapper:
        if text not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            self.known[text] = Wrapper(text)
        return self.known[text]


def _sketch(texts: list[str]) -> int:
    """A min-hash of the runs of three words, which pages with the same or nearly the same content share."""
    words = " ".join(texts).split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh64_intdigest(r) for r in runs) >> 1


def _facts(batches):
    """For each slot of a page that no element rules out: host, slot, hash of its text, sketch of the page, characters, linked ones."""
    wrappers = _Wrappers()
    roles: dict[int, list] = {}
    for b in pieces(batches, "html"):
        out: list[tuple] = []
        for host, html, text in zip(*(column(b, c).to_pylist() for c in ("host", "html", "wrapper"))):
            wrapper = wrappers.get(text)
            if id(wrapper) not in roles:
                roles.clear()
                roles[id(wrapper)] = wrapper.roles()
            mine: dict[int, list[Node]] = {}
            for slot, node in wrapper.match(parse(html or "")):
                if slot >= 0 and roles[id(wrapper)][slot][0] != "out":
                    mine.setdefault(slot, []).append(node)
            texts = {s: "\n".join(map(clean, nodes)) for s, nodes in mine.items()}
            # By what articles hold where there are some, as copies of one may stand beside different adverts.
            levels = {s: roles[id(wrapper)][s][0] for s in texts if texts[s]}
            top = next((x for x in ("article", "main") if x in levels.values()), None)
            page = _sketch([texts[s] for s in levels if top in (None, levels[s])])
            for s, nodes in mine.items():
                linked = sum(len(t) for n in nodes for t, is_link in n.texts if is_link)
                out.append((host, s, xxhash.xxh64_intdigest(texts[s]) >> 1, page, sum(len(t) for n in nodes for t, _ in n.texts), linked))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "slot", "h", "page", "chars", "linked"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: signatures of a host are merged in groups of MERGE_FAN until one is left."""
    left = cut(pages.groupBy("host", "sig").agg(F.count("*").alias("n")).select("host", "sig"), "signatures")

    def merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "sig": [merge_all(sorted(pdf["sig"]))]})

    while True:
        counts = left.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return left.withColumnRenamed("sig", "wrapper")
        bucket = F.pmod(F.xxhash64("sig"), F.ceil(F.col("n") / MERGE_FAN))
        grouped = left.join(counts, "host").select("host", "sig", bucket.alias("bucket"))
        left = cut(grouped.groupBy("host", "bucket").applyInPandas(merge_group, "host string, sig string"), "merged")


def judged(wrappers: DataFrame, facts: DataFrame) -> DataFrame:
    """host, wrapper, and the kept slots of each level: article, main, open. Pages with the same content count once."""
    texts = facts.groupBy("host", "slot", "h", "page").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    texts = texts.groupBy("host", "slot", "h").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    slots = texts.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("top"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    facts = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "top", "chars", "linked")).alias("facts"))
    both = wrappers.join(facts, "host", "left").select("host", "wrapper", "facts")

    def decide(pdfs):
        for pdf in pdfs:
            kept = [Wrapper(w).kept({f["slot"]: (f["pages"], f["top"], f["chars"], f["linked"]) for f in (fs if fs is not None else ())}) for w, fs in zip(pdf["wrapper"], pdf["facts"])]
            yield pd.DataFrame({"host": pdf["host"], "wrapper": pdf["wrapper"], **{x: [k[x] for k in kept] for x in ("article", "main", "open")}})

    return both.mapInPandas(decide, "host string, wrapper string, article array<int>, main array<int>, open array<int>")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, blocks joined by line breaks.

    Elements that hold no article by what they are (nav, footer, aside, form, script, a page's header, ..) are left out.
    Of what is left, a page's text is what lies in articles; without any, in main elements; without these, all of it: less
    the slots of the host's wrapper that hold one text on most pages (TEMPLATE), that are mostly links (outside articles),
    or that are named like a notice, an advert, a menu or comments and do not hold most of the text of three pages or more.
    In articles, headings always stay, and other slots unless one text is on nine in ten of five pages or more.

    Null or empty html gives an empty text. Pages without a host in their url share one wrapper. Pages with the same or
    nearly the same content count as one page when slots are judged, so copies are never taken for template text.
    Null ids and urls and repeated rows are kept; an empty table gives an empty result; other columns are ignored. Pages of
    any length and depth are read whole.
    """
    spark = pages.sparkSession
    arrow_rows(spark)
    url = pages[url_col].cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    src = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), pages[html_col].cast("string").alias("html"), host.alias("host"))
    described = src.select("host", "html").mapInArrow(_describe, "host string, sig string")
    wrappers = cut(infer_wrappers(described), "wrappers")

    def with_host(rows: DataFrame, known: DataFrame) -> DataFrame:
        known = known.withColumnRenamed("host", "whost")
        small = (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES
        return rows.join(F.broadcast(known) if small else known, F.col("host") == F.col("whost")).drop("whost")

    facts = with_host(src.select("host", "html"), wrappers).mapInArrow(_facts, "host string, slot int, h long, page long, chars long, linked long")
    known = cut(judged(wrappers, facts), "judged")

    def run(batches):
        wrappers = _Wrappers()
        for b in pieces(batches, "html"):
            texts = []
            for html, wrapper, *kept in zip(*(column(b, c).to_pylist() for c in ("html", "wrapper", "article", "main", "open"))):
                found = wrappers.get(wrapper).match(parse(html or ""))
                texts.append("\n".join(main_blocks(found, dict(zip(("article", "main", "open"), kept)))))
            yield pa.RecordBatch.from_arrays([column(b, "page_id"), column(b, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return with_host(src, known).drop("host").mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""HTML extraction by wrapper induction.

Pages of one host are aligned with a reference page of that host: their block trees, in which runs of like
siblings (and of like pairs or triples of siblings) are one repeated node, are compared by simple tree matching,
and each node takes the slot of the reference node it is matched with. A node without a counterpart takes a slot
of its own, named by its path of labels, so that what the reference page lacks is counted as well. Over all
different pages of a host, text that stands in one slot on nearly all pages with that slot is template, and slots
that are mostly link text are menus; the other slots vary. The content region is the part of the reference tree
that holds most of the varying text: from the root, the wrapper goes down while one container holds CORE of it.

A page's main text is its varying blocks in the region (narrowed to its article, if it marks one there), without
the parts whose markup says that they vary but are no content (adverts, forms, reader comments, ...). A name that only
is part of a longer one ("reply-paid") is a hint: it never holds for an element that marks the main text, and if
nothing but headings were left of a page, the blocks dropped by hints alone are kept.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, join_small, stored, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"(?P<k>[\w:-]++)(?:\s*+=\s*+(?:\"(?P<a>[^\"]*+)\"|'(?P<b>[^']*+)'|(?P<c>[^\s>]++)))?")

BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "object", "ol", "optgroup", "option",
    "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "video", "audio",
}
#: An opening tag ends an open element of these kinds (until a boundary): what writers leave unclosed.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "select", "article", "body", "html"}
BAD_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "dialog", "menu", "object", "video", "audio"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
BAD_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie",
    "cookies", "copyright", "disclaimer", "disqus", "foot", "footer", "gdpr", "legal", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
#: These say so as part of a longer name, too; names of the main text's own element; tags of headings.
SURE_NAMES, MAIN_NAMES, HEADINGS = {"comment", "comments", "commentlist", "disqus"}, {"main", "content", "article"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Boilerplate only outside an article, where they hold its title.
HEADS = {"header"}

#: Text on this share of the pages with its slot is template, and a slot with this share of link text is a menu.
TEMPLATE_SHARE, LINK_SHARE = 0.8, 0.6
#: Different pages that must have a slot before its text can be called constant: on one or two, all text is.
EVIDENCE = 3
#: Share of the varying text that a container must hold to be gone into, and the elements that are containers.
CORE, CONTAINERS = 0.7, {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
#: Tables of more cells than this are filled by rows of arrays, with the same result; longest repeated sibling pattern.
CELLS, PERIOD = 4096, 3
#: Pairs of shapes that such a table keeps at once.
SHAPES = 1 << 18
#: Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 32 << 20

LAYOUT, CAMEL = re.compile(r"\b(?:has|with|no|without|is)[-_][\w-]*", re.I), re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("label", "tag", "kids", "bad", "main", "slot", "home", "up")

    def __init__(self, tag, label, bad, main, up=None):
        self.tag, self.label, self.kids, self.bad, self.main, self.up = tag, label, [], bad, main, up
        self.slot = self.home = None  # the slot, and that of the nearest node with a counterpart


class Text:
    """A block of text: what stands in one block element between its block children."""

    __slots__ = ("node", "raw", "link", "text")

    def __init__(self, node):
        self.node, self.raw, self.link = node, [], 0


@lru_cache(maxsize=1 << 14)
def traits(tag: str, attrs: str) -> tuple[str, int, bool, bool]:
    """(label, boilerplate, boilerplate outside articles, marks the main text) of an opening tag.

    Boilerplate is 2 by the element, its role, a whole name or one of SURE_NAMES, 1 by another part of a name, 0 if it is none.
    """
    found = {m["k"].lower(): m["a"] or m["b"] or m["c"] or "" for m in ATTR.finditer(attrs)} if attrs.strip(" /") else {}
    # "has-sidebar" and the like say what a layout holds, not what the element is; camel case counts whole and in parts
    given = LAYOUT.sub(" ", f"{found.get('class', '')} {found.get('id', '')}")
    names = set(re.split(r"[^a-z]+", f"{given} {CAMEL.sub(' ', given)}".lower())) - {""}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    whole = set(given.lower().split())
    marked = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
    if tag in BAD_TAGS or role in BAD_ROLES or whole & BAD_NAMES or names & SURE_NAMES or hidden:
        bad = 2
    else:
        bad = int(bool(names & BAD_NAMES) and not marked and not whole & MAIN_NAMES)
    first = (found.get("class") or "").split()
    return f"{tag}.{first[0]}" if first else tag, 0 if tag in ("html", "body") else bad, tag == "header" or bool(names & HEADS), marked and not bad


def parse(html: str) -> tuple[Node, list[Text]]:
    """The tree of block elements and the text blocks in page order. Inline markup is dropped, its text stays."""
    root = Node("", "", 0, False)
    stack, blocks = [root], []
    now, link, at = None, 0, 0

    def add(chunk):
        nonlocal now
        if now is None:
            if chunk.isspace():
                return
            now = Text(stack[-1])
            blocks.append(now)
        now.raw.append(chunk)
        if link:
            now.link += len(chunk)

    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue  # comments, declarations, and elements whose content is no text
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            if tag == "hr":
                now = None
            elif now is not None:
                now.raw.append(" ")
            continue
        if tag not in BLOCK:
            if tag == "a":
                link = 0 if m["close"] else 1
            continue
        now, link = None, 0
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "p":  # a block ends an open paragraph
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag in BOUNDS:
                break
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        up = stack[-1]
        label, bad, head, main = traits(tag, m["attrs"])
        node = Node(tag, label, max(up.bad, bad, 2 * (head and not up.main)), up.main or main, up)
        up.kids.append(node)
        stack.append(node)
    if at < len(html):
        add(html[at:])
    out = []
    for b in blocks:
        raw = "".join(b.raw)
        b.text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if b.text:
            out.append(b)
    return root, out


class Group:
    """A run of like siblings, or of like tuples of siblings, as one node: the iterator of the wrapper."""

    __slots__ = ("label", "tag", "members", "kids", "number", "sign", "size")

    def __init__(self, label, tag, members):
        self.label, self.tag, self.members, self.kids, self.number = label, tag, members, [], -1


def runs(nodes: list[Node]) -> list[Group]:
    """`nodes` in groups: runs of one label first, then runs of a repeated tuple of up to PERIOD of these."""
    single: list[Group] = []
    for n in nodes:
        if single and single[-1].label == n.label:
            single[-1].members.append(n)
        else:
            single.append(Group(n.label, n.tag, [n]))
    for period in range(2, PERIOD + 1):
        out, i = [], 0
        while i < len(single):
            labels, times = [g.label for g in single[i : i + period]], 1
            while [g.label for g in single[i + times * period : i + (times + 1) * period]] == labels and len(labels) == period:
                times += 1
            if times == 1:
                out.append(single[i])
                i += 1
                continue
            for k in range(period):
                part = single[i + k : i + times * period : period]
                out.append(Group(part[0].label, part[0].tag, [n for g in part for n in g.members]))
            i += times * period
        single = out
    return single


def grouped(root: Node) -> tuple[Group, list[Group]]:
    """The tree of groups and its nodes in page order of levels; numbers are places in that list."""
    tree = Group("", "", [root])
    order = [tree]
    for g in order:
        g.kids = runs([k for n in g.members for k in n.kids])
        order.extend(g.kids)
    for number, g in enumerate(order):
        g.number = number
    for g in reversed(order):
        g.size = 1 + sum(k.size for k in g.kids)
        g.sign = blake2b(b"".join([g.label.encode(), b"\0", *[k.sign for k in g.kids]]), digest_size=8).digest()
    return tree, order


def weight(a: Group, b: Group, known: dict) -> int:
    """Simple tree matching: size of the largest order-keeping match of two trees of one label; no recursion, each pair of shapes once."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = x.sign, y.sign
        if key in known or x.sign == y.sign:
            known.setdefault(key, x.size)
            todo.pop()
        elif len(x.kids) * len(y.kids) > CELLS:
            known[key] = 1 + LongTable(x, y).total
            todo.pop()
        else:
            need = {(p.sign, q.sign): (p, q) for p in x.kids for q in y.kids if p.label == q.label and (p.sign, q.sign) not in known}
            if need:
                todo.extend(need.values())
                continue
            known[key] = 1 + table_of(x, y, known)[-1][-1]
            todo.pop()
    return known[a.sign, b.sign]


def table_of(x: Group, y: Group, known: dict) -> list[list[int]]:
    best = [[0] * (len(y.kids) + 1)]
    for p in x.kids:
        last, row = best[-1], [0]
        for j, q in enumerate(y.kids):
            both = last[j] + known[p.sign, q.sign] if p.label == q.label else 0
            row.append(max(last[j + 1], row[j], both))
        best.append(row)
    return best


class LongTable:
    """`table_of` for long lists: a row is one step over arrays, and some 2 sqrt(rows) rows are held at a time.

    Exact like `table_of`, so its time grows with the product of both lengths, and with the pairs of different shapes.
    """

    def __init__(self, x: Group, y: Group):
        self.x, self.y, self.known = x.kids, y.kids, {}
        self.step = max(1, isqrt(len(x.kids)))
        self.where: dict[str, tuple[np.ndarray, np.ndarray, list[Group]]] = {}
        places: dict[str, list[int]] = {}
        for j, q in enumerate(y.kids):
            places.setdefault(q.label, []).append(j)
        for label, at in places.items():
            kinds = {y.kids[j].sign: y.kids[j] for j in at}
            number = {sign: k for k, sign in enumerate(kinds)}
            self.where[label] = np.array(at), np.array([number[y.kids[j].sign] for j in at]), list(kinds.values())
        row, self.held = np.zeros(len(y.kids) + 1, np.int64), []
        for i in range(len(x.kids)):
            if i % self.step == 0:
                self.held.append(row)
            row = self.next(row, i)
        self.total = int(row[-1])

    def next(self, last: np.ndarray, i: int) -> np.ndarray:
        p = self.x[i]
        if p.label not in self.where:
            return last
        at, kind, kinds = self.where[p.label]
        if len(self.known) > SHAPES:
            self.known.clear()
        gains = np.array([weight(p, q, self.known) for q in kinds])[kind]
        row = last.copy()
        row[at + 1] = np.maximum(row[at + 1], last[at] + gains)
        return np.maximum.accumulate(row)

    def pairs(self):
        """The matched pairs, last first, by the same rule as in `match`."""
        i, j = len(self.x), len(self.y)
        while i and j:
            low = (i - 1) // self.step * self.step
            rows = [self.held[low // self.step]]
            for k in range(low, i):
                rows.append(self.next(rows[-1], k))
            while i > low and j:
                row, last = rows[i - low], rows[i - low - 1]
                if row[j] == last[j]:
                    i -= 1
                elif row[j] == row[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield self.x[i], self.y[j]


def match(a: Group, b: Group) -> list[tuple[Group, Group]]:
    """The pairs of nodes of a largest match of two trees of one label."""
    known: dict = {}
    weight(a, b, known)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.sign == y.sign:
            todo.extend(zip(x.kids, y.kids))
        elif len(x.kids) * len(y.kids) > CELLS:
            for p, q in LongTable(x, y).pairs():
                weight(p, q, known)
                todo.append((p, q))
        else:
            best, i, j = table_of(x, y, known), len(x.kids), len(y.kids)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x.kids[i], y.kids[j]))
    return out


@lru_cache(maxsize=256)
def reference(html: str) -> tuple[Group, list[Group]]:
    return grouped(parse(html)[0])


def aligned(html: str, reference_html: str) -> list[Text]:
    """The text blocks of a page; their nodes know their slot (a number, or a negative one named by the path) and home slot."""
    root, blocks = parse(html)
    tree, order = grouped(root)
    for x, y in match(tree, reference(reference_html)[0]):
        for node in x.members:
            node.slot = node.home = y.number
    path = {id(root): b""}
    for g in order[1:]:
        for node in g.members:
            here = path[id(node)] = blake2b(path[id(node.up)] + g.label.encode(), digest_size=8).digest()
            if node.slot is None:
                node.slot, node.home = -1 - (int.from_bytes(here[:4], "big") >> 1), node.up.home
    return blocks


def region(reference_html: str, varying: dict[int, int]) -> set[int]:
    """The slots of the content region, and of the headings right before it; empty if no text varies."""
    tree, order = reference(reference_html)
    held = [varying.get(g.number, 0) for g in order]
    for g in reversed(order):
        held[g.number] += sum(held[k.number] for k in g.kids)
    if not held[0]:
        return set()
    here, found = tree, set()
    while True:
        best = max(here.kids, key=lambda k: held[k.number], default=None)
        if best is None or best.tag not in CONTAINERS or held[best.number] < CORE * held[here.number]:
            break
        heads = []
        for k in here.kids[: here.kids.index(best)]:
            heads = [*heads, k.number] if re.fullmatch("h[1-6]", k.tag) else []
        found.update(heads)
        here = best
    todo = [here]
    for g in todo:
        found.add(g.number)
        todo.extend(g.kids)
    return found


def main_text(blocks: list[Text], template: set[tuple[int, int]], menus: set[int], core: set[int] = frozenset()) -> str:
    """What of `blocks` is neither template, nor menu, nor marked as boilerplate, nor outside the region `core`, if the page has it."""
    own = [b for b in blocks if b.node.bad < 2 and b.node.slot not in menus and (b.node.slot, crc32(b.text.encode())) not in template]
    good = [b for b in own if not b.node.bad]
    if all(b.node.tag in HEADINGS for b in good):  # hints don't empty a page
        good = own
    good = [b for b in good if b.node.home in core] or good
    inside = [b for b in good if b.node.main]
    return "\n\n".join(b.text for b in inside or good)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1))


def with_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Join on host: hosts' rows of BROADCAST_BYTES in all are broadcast, beyond that `join_small` merges them."""
    listed = [F.size(c) * 24 for c in hosts.columns if c in ("template", "menus", "varying")]
    size = hosts.agg(F.sum(sum((F.coalesce(F.greatest(x, F.lit(0)), F.lit(0)) for x in listed), F.octet_length("reference") + 64))).first()[0] or 0
    return join_small(pages, hosts, "host", "inner", rows=0 if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1)


def blocks_of(batches):
    """(host, by, first, second) of (host, html, by): 128 bits of the texts of the page's blocks."""
    for batch in batches:
        digests = []
        for html in batch.column("html"):
            d = blake2b(digest_size=16)
            for b in parse(html.as_py())[1]:
                text = b.text.encode()
                d.update(b"%d:" % len(text) + text)
            digests.append(d.digest())
        halves = [pa.array([int.from_bytes(d[k : k + 8], "big", signed=True) for d in digests], pa.int64()) for k in (0, 8)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("by"), *halves], names=["host", "by", "first", "second"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, template, menus, varying) of pages (host, html): stored, one row a host.

    Slots and texts are counted once for each different page (sequence of blocks) of a host, over all pages; the counts
    combine before the shuffle, so a host with a third of all pages is a few rows a task. The reference is any page, by hash.
    """
    marked = pages.withColumn("by", F.xxhash64("host", "html"))
    # pages of the same blocks weigh one page together; digests alone move to tell them
    same = stored(marked.mapInArrow(blocks_of, "host string, by long, first long, second long"))
    keyed = same.select("by", F.struct("host", "first", "second").alias("blocks"))
    times = stored(keyed.groupBy("blocks").agg(F.count("*").alias("copies")).filter("copies > 1"))
    copies = stored(join_small(keyed, times, "blocks", "inner").select("by", "copies").distinct())
    hosts = stored(marked.groupBy("host").agg(F.min(F.struct("by", "html"))["html"].alias("reference")))
    made = pa.schema([("host", pa.string()), ("slot", pa.int32()), ("hash", pa.int64()), *[(c, pa.float64()) for c in ("on", "chars", "links", "good")]])

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part, out = batch.slice(at, 512), []
                for host, html, ref, n in zip(*(part.column(c).to_pylist() for c in ("host", "html", "reference", "copies"))):
                    seen, weight = {}, 1 / (n or 1)
                    for b in aligned(html, ref):
                        for text in (crc32(b.text.encode()), -1):  # -1: the slot as a whole
                            row = seen.setdefault((b.node.slot, text), [weight, 0, 0, 0])
                            row[1] += weight * len(b.text)
                            row[2] += weight * min(b.link, len(b.text))
                            row[3] += 0 if b.node.bad else weight * len(b.text)
                    out.extend((host, s, h, *n) for (s, h), n in seen.items())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 7, made)], schema=made)

    weighed = with_hosts(join_small(marked, copies, "by"), hosts).select("host", "html", "reference", "copies")
    seen = weighed.mapInArrow(run, "host string, slot int, hash long, on double, chars double, links double, good double")
    texts = stored(seen.groupBy("host", "slot", "hash").agg(*[F.sum(c).alias(c) for c in ("on", "chars", "links", "good")]))
    slots = texts.filter("hash = -1").select("host", "slot", F.col("on").alias("pages"), "chars", "links", "good")
    constant = (F.col("pages") >= EVIDENCE - 1e-6) & (F.col("on") >= TEMPLATE_SHARE * F.col("pages") - 1e-6)
    # a text on too few pages to be constant need not be held against its slot
    texts_of = texts.filter((F.col("hash") >= 0) & (F.col("on") >= TEMPLATE_SHARE * EVIDENCE - 1e-6)).join(slots.select("host", "slot", "pages"), ["host", "slot"]).withColumn("constant", constant)
    fixed = texts_of.filter("constant").groupBy("host", "slot").agg(F.sum("good").alias("stands"))
    template = texts_of.filter("constant").groupBy("host").agg(F.collect_set(F.struct("slot", "hash")).alias("template"))
    moving = slots.join(fixed, ["host", "slot"], "left").withColumn("moves", F.col("good") - F.coalesce("stands", F.lit(0)))
    menu = F.col("links") >= LINK_SHARE * F.col("chars")
    parts = moving.groupBy("host").agg(
        F.collect_set(F.when(menu, F.col("slot"))).alias("menus"),
        F.collect_list(F.when(~menu & (F.col("slot") >= 0) & (F.col("moves") >= 1), F.struct("slot", F.col("moves").cast("long").alias("moves")))).alias("varying"),
    )
    out = stored(hosts.join(template, "host", "left").join(parts, "host", "left"))
    discard(same, times, copies, hosts, texts)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (url, html, and whatever else) with `text`, the main text.

    A null or empty html gives an empty text; a null url is the host "". Pages of any length, depth and number of
    siblings are read whole, without recursion. Repeated rows get the same text and count as one page; of hosts with
    few pages nothing is template. An empty table stays empty. Caller columns named text, host, reference, template,
    menus or varying are replaced.
    """
    pages = pages.drop("text", "host", "reference", "template", "menus", "varying")
    named = pages.withColumn("host", host_of(F.col("url"))).withColumn("html", F.coalesce("html", F.lit("")))
    joined = with_hosts(named, wrappers(named.select("host", "html")))
    keep = [c for c in pages.columns if c != "html"]
    fields = [f for f in pages.schema.fields if f.name != "html"]

    def run(batches):
        last, core = None, set()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                out = []
                for host, html, ref, template, menus, varying in zip(*(part.column(c).to_pylist() for c in ("host", "html", "reference", "template", "menus", "varying"))):
                    if host != last:
                        last, core = host, region(ref, {v["slot"]: v["moves"] for v in varying or ()})
                    out.append(main_text(aligned(html, ref), {(t["slot"], t["hash"]) for t in template or ()}, set(menus or ()), core))
                yield part.select(keep).append_column("text", pa.array(out, pa.string()))

    return joined.select(*keep, "host", "html", "reference", "template", "menus", "varying").mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op5_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of `pages`: see `extract` for the awkward rows."""
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

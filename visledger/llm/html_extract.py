"""Main text of web pages through union-free wrappers of each host.

A page is read as a stream of tags and text slots. Within a page, what follows
an equal element is a repetition of it, ``(p)+`` or ``(h2 p)+``. Streams of one
host are then aligned: where they agree, a token stays; where they do not, what
only one of them has becomes optional, ``(aside)?``, and texts that differ are a
slot. The result has no alternatives: it is a union-free regular expression, the
host's wrapper. It also adds up what its slots held, so that it knows which
region holds most of the text and which texts never change.

Wrappers merge like the pages do, so tasks infer them of what they read and the
wrappers of a host meet in rounds; none grows beyond a bound. A wrapper is then
cut down to the way to its regions and to the slots of the template, and each
page is aligned with that of its host to find its own text.
"""

from __future__ import annotations

import html as html_lib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_keys, materialize, skewed_join, small_batches
from .url_filters import host_and_path

#: Items of a sequence, levels of elements and nodes of a wrapper; beyond them it gets coarser.
MOST_ITEMS, MOST_DEPTH, MOST_NODES = 48, 40, 2000
#: Elements of the longest group that repeats.
LONGEST_PERIOD = 4
#: Nodes of the wrappers that a task holds before it hands them on.
HELD_NODES = 100_000
#: Wrappers of a host that one task merges in a round.
FAN_IN = 64
#: Total size up to which the cut-down wrappers are broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20
#: Least share of the text outside of furniture that the main region holds.
REGION_SHARE = 0.5
#: A text is part of the template if it is the same so many times, on pages that differ.
TEMPLATE_PAGES = 5
#: Share of link text from which an element outside of any region is a menu.
LINK_SHARE = 0.6

#: Elements (of HTML) whose content is no text of an article.
FURNITURE_TAGS = frozenset(
    "head title style script link meta base noscript template nav footer aside button select option optgroup datalist textarea input "
    "iframe object embed applet svg canvas audio video map dialog menu noembed noframes xmp".split()
)
#: Names (parts of a class or id) of what stands around an article.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion sidebar menu menus nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner banners popup modal overlay newsletter subscribe "
    "subscription signup login signin share sharing social related recommended recommendations comment comments commentlist disqus respond "
    "reply replies footer masthead toolbar pager pagination widget widgets skip alert alerts paywall teaser".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT_NAMES = frozenset("article content main post entry story body maincontent articlebody".split())
NOT_ITSELF = frozenset("has with no without is".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("title style script link meta base noscript template".split())
#: What ends an open element of these kinds: elements that can't stand in it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
ENDS_P = BLOCKS - {"br", "option", "select", "html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option"} | {"li"}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>|<[!?/][^>]*+>|<[!?/a-zA-Z][^>]*+\Z", re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[\s]+")
_PART = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


class Element:
    """An element of a page: children are elements and texts (str)."""

    __slots__ = ("tag", "label", "off", "kids")

    def __init__(self, tag: str, label: str, off: bool):
        self.tag, self.label, self.off, self.kids = tag, label, off, []


def _named(tag: str, rest: str, inside: bool) -> tuple[str, bool]:
    """An element's label (tag and names without digits), and whether it is furniture. ``inside``: of an article."""
    off = tag in FURNITURE_TAGS or (tag == "header" and not inside)
    names: list[str] = []
    if "=" in rest or "hidden" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            key = m[1].lower()
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            if key in ("class", "id"):
                names += _NAME.split(value.strip())
            elif key == "role":
                off = off or value.strip().lower() in ROLES
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
                off = True
    if names and tag not in ("html", "body", "main"):
        for name in names:
            parts = [x.lower() for x in _PART.split(name) if x]
            if not parts or parts[0] in NOT_ITSELF:
                continue
            if tag == "article":
                off = off or name.lower() in FURNITURE_NAMES
            elif not FURNITURE_NAMES.isdisjoint(parts) or "header" in parts and not inside and len(parts) < 3:
                off = True
    plain = sorted({n.lower() for n in names if n and not any(c.isdigit() for c in n)})[:3]
    return ("!" if off else "") + ".".join([tag, *plain]), off


def parse(page: str) -> Element:
    """A page as a tree; ends that are missing are supplied, ends of nothing ignored, deep nesting is cut flat."""
    root = Element("", "", False)
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text.isspace():
            stack[-1].kids.append(" ")
        elif text:
            if stack[-1].tag == "head":
                stack.pop()
            stack[-1].kids.append(text)
        if not m:
            break
        at = m.end()
        tag, end, rest = (m["tag"], m["end"], m["rest"]) if m["tag"] else (m["tag2"], m["end2"], m["rest2"])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if any(e.tag == tag for e in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("button", "td", "th", "table", "object"):
                    break
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            lowest = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in same:
                    lowest = i
            if lowest:
                del stack[lowest:]
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        inside = any(e.tag in ("article", "main") for e in stack)
        label, off = _named(tag, rest, inside)
        element = Element(tag, label, off)
        stack[-1].kids.append(element)
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = len(page) if close is None else close.start()
        if tag not in VOID and tag not in RAW and len(stack) < MOST_DEPTH:
            stack.append(element)
    _forms(root)
    return root


def _forms(root: Element) -> bool:
    """Takes forms for furniture unless they enclose the page; whether an article or heading is below."""
    found = root.tag in ("article", "main", "h1")
    for kid in root.kids:
        if not isinstance(kid, str) and _forms(kid):
            found = True
    if root.tag == "form" and not found and not root.off:
        root.off, root.label = True, "!" + root.label
    return found


class Slot:
    """An item of a wrapper: an element, a text slot (``#``), or a group of items (``(..)``, in any order ``(*)``)."""

    __slots__ = ("label", "many", "maybe", "n", "chars", "links", "low", "high", "kids")

    def __init__(self, label, many=False, maybe=False, n=1, chars=0, links=0, low=None, high=None, kids=None):
        self.label, self.many, self.maybe, self.n, self.chars, self.links, self.low, self.high = label, many, maybe, n, chars, links, low, high
        self.kids = kids if kids is not None else []

    def to_list(self) -> list:
        return [self.label, self.many, self.maybe, self.n, self.chars, self.links, self.low, self.high, [k.to_list() for k in self.kids]]

    @classmethod
    def of_list(cls, x: list) -> "Slot":
        return cls(*x[:8], [cls.of_list(k) for k in x[8]])

    def pattern(self) -> str:
        """The regular expression, for people."""
        inner = " ".join(k.pattern() for k in self.kids)
        name = self.label.split("(")[0]
        shown = f"({inner})" if self.label.startswith("(") else name if not inner else f"<{name}>{inner}</{name}>"
        return (shown if not (self.many or self.maybe) or shown.startswith("(") else f"({shown})") + ("+" if self.many else "") + ("?" if self.maybe else "")


def _joined(a: Slot, b: Slot) -> Slot:
    """Two items of one label as one."""
    low = a.low if b.low is None else b.low if a.low is None else min(a.low, b.low)
    high = a.high if b.high is None else b.high if a.high is None else max(a.high, b.high)
    kids = _of_any_order(a.kids, b.kids) if a.label == "(*)" else _aligned(a.kids, b.kids)
    return Slot(a.label, a.many or b.many, a.maybe or b.maybe, a.n + b.n, a.chars + b.chars, a.links + b.links, low, high, kids)


def _of_any_order(*sequences: list) -> list:
    """Different items of all sequences, each optional, in the order of their labels."""
    by: dict[str, Slot] = {}
    todo = [k for s in sequences for k in s]
    while todo:
        k = todo.pop()
        if k.label.startswith("("):
            todo += k.kids
            continue
        k = Slot(k.label, k.many, True, k.n, k.chars, k.links, k.low, k.high, k.kids)
        by[k.label] = _joined(by[k.label], k) if k.label in by else k
    if len(by) > MOST_ITEMS:  # names vary without end: tags alone
        plain: dict[str, Slot] = {}
        for label, k in sorted(by.items()):
            label = label.split(".")[0]
            k = Slot(label, k.many, True, k.n, k.chars, k.links, k.low, k.high, k.kids)
            plain[label] = _joined(plain[label], k) if label in plain else k
        by = plain
    if len(by) > MOST_ITEMS:  # so do tags
        every = sorted(by.values(), key=lambda k: k.label)
        kept, rest = every[: MOST_ITEMS - 1], every[MOST_ITEMS - 1 :]
        odd = Slot("?", True, True, sum(k.n for k in rest), sum(k.chars for k in rest), sum(k.links for k in rest))
        by = {k.label: k for k in kept}
        by["?"] = _joined(by["?"], odd) if "?" in by else odd
    return [by[label] for label in sorted(by)]


def _folded(items: list) -> list:
    """A sequence with what repeats side by side as one item or group."""
    out: list[Slot] = []
    for item in items:
        out.append(item)
        while True:
            if len(out) > 1 and out[-1].label == out[-2].label:
                last = out.pop()
                out[-1] = _joined(out[-1], last)
                out[-1].many = True
                continue
            for p in range(2, LONGEST_PERIOD + 1):
                if len(out) > p and out[-p - 1].label == _group_label(out[-p:]):  # one more of a group
                    more = out[-p:]
                    del out[-p:]
                    out[-1] = _joined(out[-1], Slot(out[-1].label, kids=more))
                    break
                if len(out) >= 2 * p and [k.label for k in out[-p:]] == [k.label for k in out[-2 * p : -p]]:
                    second, first = out[-p:], out[-2 * p : -p]
                    del out[-2 * p :]
                    group = Slot(_group_label(first), True, kids=[_joined(a, b) for a, b in zip(first, second)], n=2)
                    out.append(group)
                    break
            else:
                break
    if len(out) > MOST_ITEMS:
        return [Slot("(*)", True, kids=_of_any_order(out))]
    return out


def _group_label(items: list) -> str:
    return "(" + " ".join(k.label for k in items) + ")"


def _aligned(a: list, b: list) -> list:
    """Two sequences as one: what both have in a common order once, the rest optional."""
    if not a and not b:
        return []
    if [k.label for k in a] == [k.label for k in b]:
        return [_joined(x, y) for x, y in zip(a, b)]
    if len(a) == 1 and a[0].label == "(*)" or len(b) == 1 and b[0].label == "(*)":
        maybe = not a or not b or a[0].maybe or b[0].maybe
        return [Slot("(*)", True, maybe, kids=_of_any_order(a, b))]
    out = []
    for i, j in _matches([k.label for k in a], [k.label for k in b]):
        if i is not None and j is not None:
            out.append(_joined(a[i], b[j]))
        else:
            k = a[i] if j is None else b[j]
            out.append(Slot(k.label, k.many, True, k.n, k.chars, k.links, k.low, k.high, k.kids))
    return _folded(out)


def _matches(a: list, b: list) -> list[tuple]:
    """Places of two sequences side by side along a longest common subsequence; None where one has nothing."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else below[j] if below[j] >= row[j + 1] else row[j + 1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _slots(element: Element, linked: bool = False) -> Slot:
    """The wrapper of one element."""
    if element.off:
        return Slot(element.label)
    linked = linked or element.tag == "a"
    items = []
    for kid in element.kids:
        if isinstance(kid, str):
            said = " ".join(html_lib.unescape(kid).split())
            if said:
                h = _hash(said)
                items.append(Slot("#", chars=len(said), links=len(said) * linked, low=h, high=h))
        else:
            items.append(_slots(kid, linked))
    return Slot(element.label, kids=_folded(items))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text.encode("utf-8", "replace"))


def _size(slot: Slot) -> int:
    return 1 + sum(map(_size, slot.kids))


def _sums(slot: Slot) -> tuple[int, int]:
    """Characters of text below an item, and those in links."""
    chars, links = slot.chars, slot.links
    for k in slot.kids:
        c, n = _sums(k)
        chars, links = chars + c, links + n
    return chars, links


def _cut(slot: Slot, depth: int) -> None:
    """Forgets what is below a depth, but for its amount of text."""
    if depth == 0:
        slot.chars, slot.links = _sums(slot)
        slot.kids = []
    for k in slot.kids:
        _cut(k, depth - 1)


def _bounded(slot: Slot) -> Slot:
    depth = MOST_DEPTH
    while _size(slot) > MOST_NODES and depth > 1:
        depth -= 1
        _cut(slot, depth)
    return slot


def page_wrapper(page: str) -> Slot:
    """The wrapper of one page; its own text slot is the whole text, which tells copies from pages that differ."""
    root = parse(page)
    found, out = _bounded(_slots(root)), []
    _said(root, out, {})
    found.low = found.high = _hash("".join(out))
    return found


def merge(a: Slot, b: Slot) -> Slot:
    """The wrapper of what two wrappers are of."""
    return _bounded(_joined(a, b))


def rules(wrapper: Slot) -> list:
    """A host's wrapper cut down to ``[label, verdict, items]``: ``+`` on regions, ``-`` on the template and on menus, for pages without region.

    The region is the smallest element that holds at least ``REGION_SHARE`` of
    the text outside of furniture, among those that say by their tag, their role
    or their name that they are the content; of equal ones the inner one. A page
    without any such region is read whole, without furniture, menus and the
    texts of the template.
    """
    total = _sums(wrapper)[0]
    found: list[tuple] = []

    def search(slot: Slot, depth: int) -> None:
        tag, *names = slot.label.split(".")
        named = any(not CONTENT_NAMES.isdisjoint(_PART.split(n)) for n in names)
        if tag in ("article", "main") or named and tag in ("div", "section", "td"):
            mass = _sums(slot)[0]
            if mass >= REGION_SHARE * total and mass:
                found.append((mass, -depth, len(found), slot))
        for k in slot.kids:
            search(k, depth + 1)

    search(wrapper, 0)
    region = min(found, key=lambda x: x[:3])[3] if found else None
    varied = wrapper.low != wrapper.high

    def compiled(slot: Slot) -> list | None:
        if slot is region:
            return [slot.label, "+", []]
        if slot.label == "#":
            constant = varied and slot.n >= TEMPLATE_PAGES and slot.low is not None and slot.low == slot.high and not slot.many
            return ["#", "-", []] if constant else None
        chars, links = _sums(slot)
        if slot.label.split(".")[0] in ("ul", "ol", "div", "table", "section") and chars and links >= LINK_SHARE * chars and links == chars:
            return [slot.label, "-", []]
        kids = [c for c in map(compiled, slot.kids) if c]
        return [slot.label, "", kids] if kids else None

    return compiled(wrapper) or ["", "", []]


def _marks(element: Element, rule: list, regions: list, drops: dict) -> None:
    """Aligns an element's children with a rule's items; regions and the ids of what a rule drops are gathered in page order."""
    items: list = []
    for item in rule[2]:
        items += item[2] if item[0].startswith("(") else [item]
    kids = [k for k in element.kids if not (isinstance(k, str) and not k.strip())]
    runs: list[tuple[str, list]] = []
    for i, k in enumerate(kids):
        label = "#" if isinstance(k, str) else k.label
        if runs and runs[-1][0] == label:
            runs[-1][1].append(i)
        else:
            runs.append((label, [i]))
    by = {item[0]: item for item in items}
    if len(runs) <= 4 * MOST_ITEMS:
        pairs = _matches([r[0] for r in runs], [i[0] for i in items])
    else:
        pairs = [(i, None) for i in range(len(runs))]
    for i, j in pairs:
        if i is None:
            continue
        label, places = runs[i]
        item = items[j] if j is not None else by.get(label) if label != "#" else None
        if item is None:
            continue
        for place in places:
            k = kids[place]
            if item[1] == "+":
                regions.append(k)
            elif item[1] == "-":
                drops.setdefault(id(element), set()).add(id(k))
            elif not isinstance(k, str):
                _marks(k, item, regions, drops)


def _said(element: Element, out: list, drops: dict) -> None:
    gone = drops.get(id(element), ())
    for kid in element.kids:
        if id(kid) in gone:
            continue
        if isinstance(kid, str):
            out.append(html_lib.unescape(kid))
        elif not kid.off:
            block = kid.tag in BLOCKS
            if block:
                out.append(" ")
            _said(kid, out, drops)
            if block:
                out.append(" ")


def main_text(page: str, rule: list) -> str:
    """The text of a page by the rules of its host."""
    root = parse(page)
    regions: list = []
    drops: dict = {}
    _marks(root, rule, regions, drops)
    out: list[str] = []
    for r in regions:
        out.append(" ")
        _said(r, out, {})
    text = " ".join("".join(out).split())
    if not text:
        out = []
        _said(root, out, drops)
        text = " ".join("".join(out).split())
    return text


def _decoded(value) -> str:
    return value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else ""


def _merge_rows(batches):
    """Rows ``host, wrapper``: of what each task reads, one row for each host unless it holds very many."""
    held: dict[str, Slot] = {}
    nodes = 0

    def out():
        done = [json.dumps(w.to_list(), separators=(",", ":")) for w in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(done, pa.string())], ["host", "wrapper"])

    for host, wrapper in batches:
        before = held.get(host)
        held[host] = wrapper if before is None else merge(before, wrapper)
        nodes += _size(held[host]) - (_size(before) if before is not None else 0)
        if nodes > HELD_NODES:
            yield out()
            held.clear()
            nodes = 0
    if held:
        yield out()


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON) of all pages: one row a host; the empty host is that of pages whose url is null or has no ``://``."""
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(host.alias("host"), F.col(html_col).cast("binary").alias("t"))

    def first(batches):
        return _merge_rows((h, page_wrapper(_decoded(t))) for b in batches for h, t in zip(b.column(0).to_pylist(), b.column(1)))

    def again(batches):
        texts = ((h, t) for b in batches for h, t in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        return _merge_rows((h, Slot.of_list(json.loads(t))) for h, t in texts)

    schema = "host string, wrapper string"
    found = materialize(small_batches(rows).mapInArrow(first, schema), "wrappers")
    while True:
        most = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        parts = -(-most // FAN_IN)
        salted = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)))
        dealt = salted.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").select("host", "wrapper")
        merged = materialize(dealt.mapInArrow(again, schema), "wrappers")
        forget(found)
        found = merged


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Returns one row per input row: the id and url columns, ``text`` (the
    article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and reader comments; character references decoded,
    white space as single spaces, blocks joined by one space; empty if there is
    none) and ``n_chars`` (its code points). A null page is empty. Repeated rows
    stay repeated; nothing is cut. Markup that is not closed or nested beyond
    ``MOST_DEPTH`` levels is read as far as it goes. An empty table gives an
    empty one; further columns are not read.
    """
    wrappers = infer(pages, url_col, html_col)

    def compile_rules(batches):
        for b in batches:
            done = [json.dumps(rules(Slot.of_list(json.loads(w))), separators=(",", ":")) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["host", "rule"])

    compiled = materialize(wrappers.mapInArrow(compile_rules, "host string, rule string"), "wrapper-rules")
    forget(wrappers)
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("t"), host.alias("host"))
    size = compiled.agg(F.sum(F.length("host") + F.length("rule"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        ruled = rows.join(F.broadcast(compiled), "host", "left")
    else:
        hosts = rows.groupBy("host").agg(F.count("*").alias("n"))
        keyed = rows.withColumn("spread", F.monotonically_increasing_id())
        ruled = skewed_join(keyed, compiled, ["host"], hot_keys(hosts, ["host"]), "spread", "left")
    ruled = ruled.select("id", "url", F.col("t").cast("binary").alias("t"), "rule")
    kinds = [ruled.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches):
        known: dict[str, list] = {}
        for b in batches:
            texts = []
            for t, rule in zip(b.column(2), b.column(3).to_pylist()):
                if rule not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[rule] = json.loads(rule) if rule else ["", "", []]
                texts.append(main_text(_decoded(t), known[rule]))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"])

    found = small_batches(ruled).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

The pages of a host are aligned one after the other. A page is a nested stream
of tags and texts; where it and the wrapper so far disagree on a tag, the tag
becomes optional, or, if it comes back among its neighbours, part of a repeated
group; where they disagree on a text, the text becomes a slot. Every task folds
its pages into one partial wrapper for each host, and partial wrappers align in
the same way, so a host with a third of all pages is split like any other.

From the wrapper of its host a page learns where the article stands and which texts
around it are template. If no tag or class name tells the article, it is the part
that holds the slots: what varies from page to page and is no link. Template is what
is the same on half of the host's different pages, and on three at least, and stands
before the first or behind the last slot; headings and whatever stands between slots
are never template. Copies of a page count once. Tag and class names that stand for menus,
headers, footers, sidebars, notices, adverts, forms and comments are left out anywhere.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sized_broadcast, store
from .url_filter import host

#: Elements nested deeper than this are read as part of the one that holds them; those that are left out still are.
DEPTH = 200
#: A label that comes back more often among its siblings, apart from runs, makes a repeated group.
RETURNS = 3
#: Cells of the table that aligns two lists of siblings; longer lists are aligned label by label.
CELLS = 250_000
#: Parts that the partial wrappers of a host are joined in first.
SALTS = 64
#: Partial wrappers that a task holds before it passes them on.
HELD_HOSTS = 5_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|button|title|math|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Which open elements a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl article section div body main aside nav td th".split())
#: Tags and name words of page parts that are no article text.
_OUT_TAGS = frozenset("nav aside footer form head menu dialog fieldset input select option button audio video canvas".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription social share sharing comment comments commentlist disqus respond reply replies related recommended breadcrumb breadcrumbs pagination pager login signin signup search widget toolbar skip hidden copyright header topbar complementary contentinfo".split()
)
_MAIN_WORDS = frozenset("main articlebody article-body post-content entry-content article-content".split())


class Part:
    """An element of a page or wrapper: label, children, whether optional or repeated, and for texts (label #) their hash while it is constant."""

    __slots__ = ("label", "kids", "opt", "rep", "text", "pages", "chars", "links")

    def __init__(self, label, kids=None, opt=False, rep=False, text=None, pages=1, chars=0, links=0):
        self.label, self.kids, self.opt, self.rep, self.text, self.pages, self.chars, self.links = label, kids or [], opt, rep, text, pages, chars, links

    def dump(self):
        return [self.label, [k.dump() for k in self.kids], self.opt, self.rep, self.text, self.pages, self.chars, self.links]

    @staticmethod
    def load(x):
        return Part(x[0], [Part.load(k) for k in x[1]], *x[2:])


class Node:
    __slots__ = ("tag", "label", "kids")

    def __init__(self, tag, label):
        self.tag, self.label, self.kids = tag, label, []


@lru_cache(maxsize=4096)
def _label(tag: str, attr: str) -> str:
    words = []
    for m in _ATTR.finditer(attr):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("hidden", "aria-hidden"):
            if name == "hidden" or value == "true":
                words.append("hidden")
        else:
            words += re.sub(r"\d+", "0", value).split()
    names = {n for w in words for n in w.split(".")}
    # all words that decide what is left out or kept, then some of the others, uncut, for the alignment
    telling = (names & _MAIN_WORDS) | ({x for n in names for x in re.split(r"[-_]", n)} & (_OUT_WORDS | {"comment", "comments", "hidden"}))
    shown, room = [tag], 120 - len(tag)
    for w in sorted(set(words))[:6]:
        if len(w) < room:
            shown.append(w)
            room -= len(w) + 1
    seen = {x for w in shown[1:] for n in w.split(".") for x in (n, *re.split(r"[-_]", n))}
    return ".".join([*shown, *sorted(telling - seen)])


@lru_cache(maxsize=4096)
def _is_out(label: str) -> bool:
    tag, *names = label.split(".")
    if tag in _OUT_TAGS:
        return True
    if tag in ("body", "html", "article", "main"):
        return any(w in ("comment", "comments", "hidden") for n in names for w in re.split(r"[-_]", n))
    return any(w in _OUT_WORDS for n in names for w in re.split(r"[-_]", n))


@lru_cache(maxsize=4096)
def _is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return not _is_out(label) and (tag in ("article", "main") or any(n in _MAIN_WORDS for n in names))


def parse(page: str | None) -> Node:
    """A tree of the page's elements and texts; unclosed and stray tags are mended, scripts, styles and markup comments left out."""
    root = Node("html", "html")
    # (tag, the node that takes what the element holds); below DEPTH an element has no node of its own
    stack = [("html", root)]
    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            stack[-1][1].kids.append(text)
            continue
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS or tag not in _INLINE:
            ends = _ENDS.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in ends:
                    del stack[i:]
                    if stack[-1][0] not in ends:
                        break
                elif stack[i][0] in _SCOPE:
                    break
        node = Node(tag, _label(tag, m["attr"] or ""))
        leaf = tag in _VOID or (m["attr"] or "").endswith("/")
        if len(stack) < DEPTH or leaf:
            stack[-1][1].kids.append(node)
            if not leaf:
                stack.append((tag, node))
        elif _is_out(node.label):
            stack.append((tag, node))  # in no tree: what it holds is left out
        else:
            stack[-1][1].kids.append(" " if tag not in _INLINE else "")
            stack.append((tag, stack[-1][1]))
    return root


def _pieces(node: Node, linked: bool = False):
    """Children as parts for alignment: inline elements dissolve into the text around them."""
    out, chars, links, sign = [], 0, 0, 0

    def walk(n, linked):
        nonlocal chars, links, sign
        for k in n.kids:
            if isinstance(k, str):
                t = "".join(k.split())
                if t:
                    chars += len(t)
                    links += len(t) * linked
                    sign = zlib.crc32(t.encode("utf-8", "replace"), sign)
            elif k.tag in _INLINE and not _is_out(k.label):
                walk(k, linked or k.tag == "a")
            else:
                flush()
                out.append(as_part(k))

    def flush():
        nonlocal chars, links, sign
        if chars:
            out.append(Part("#", text=sign, chars=chars, links=links))
        chars = links = sign = 0

    walk(node, linked)
    flush()
    return out


def as_part(node: Node) -> Part:
    kids = fold(_pieces(node, node.tag == "a"))
    return Part(node.label, kids, chars=sum(k.chars for k in kids), links=sum(k.links for k in kids))


def fold(kids: list[Part]) -> list[Part]:
    """Resolve labels that come back: a run becomes one repeated part, and if a label has many runs, what stands from its first to its last a repeated group of optional parts.

    A sibling that comes back a few times stays a part of its own, so a text that is
    the same on all pages is seen.
    """
    runs: list[Part] = []
    for k in kids:
        if runs and runs[-1].label == k.label:
            runs[-1] = align(runs[-1], k, same_page=True)
            runs[-1].rep = True
        else:
            runs.append(k)
    at: dict[str, list[int]] = {}
    for i, k in enumerate(runs):
        at.setdefault(k.label, []).append(i)
    spans = sorted((v[0], v[-1]) for v in at.values() if len(v) > RETURNS)
    if not spans:
        return runs
    merged = [list(spans[0])]
    for a, b in spans[1:]:
        if a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, done = [], 0
    for a, b in merged:
        out += runs[done:a]
        group: dict[str, Part] = {}
        for k in runs[a : b + 1]:
            for x in k.kids if k.label == "()" else [k]:
                group[x.label] = align(group[x.label], x, same_page=True) if x.label in group else x
        for x in group.values():
            x.opt = True
        out.append(Part("()", list(group.values()), rep=True, pages=max(x.pages for x in group.values()), chars=sum(x.chars for x in group.values()), links=sum(x.links for x in group.values())))
        done = b + 1
    return out + runs[done:]


def _absorb(a: list[Part], b: list[Part]) -> list[Part]:
    """b with the stretches that belong into a's repeated groups put into a group of their own."""
    for g in a:
        if g.label == "()":
            names = {k.label for k in g.kids}
            hit = [i for i, k in enumerate(b) if k.label in names or k.label == "()" and names & {x.label for x in k.kids}]
            if hit and not (len(hit) == 1 and b[hit[0]].label == "()"):
                inside = [x for k in b[hit[0] : hit[-1] + 1] for x in (k.kids if k.label == "()" else [k])]
                group: dict[str, Part] = {}
                for x in inside:
                    group[x.label] = align(group[x.label], x, same_page=True) if x.label in group else x
                b = [*b[: hit[0]], Part("()", list(group.values()), rep=True, chars=sum(x.chars for x in group.values()), links=sum(x.links for x in group.values())), *b[hit[-1] + 1 :]]
    return b


def align(a: Part, b: Part, same_page: bool = False) -> Part:
    """The least wrapper of both parts, which have one label."""
    out = Part(a.label, [], a.opt or b.opt, a.rep or b.rep, a.text if a.text == b.text else None, max(a.pages, b.pages) if same_page else a.pages + b.pages, a.chars + b.chars, a.links + b.links)
    if a.label == "#":
        return out
    x, y = a.kids, b.kids
    if a.label == "()":
        kinds = {k.label: k for k in x}
        for k in y:
            kinds[k.label] = align(kinds[k.label], k, same_page) if k.label in kinds else k
        out.kids = list(kinds.values())
        for k in out.kids:
            k.opt = True
        return out
    if [k.label for k in x] == [k.label for k in y]:
        out.kids = [align(i, j, same_page) for i, j in zip(x, y, strict=True)]
        return out
    y = _absorb(x, y)
    x = _absorb(y, x)
    i = j = 0
    for p, q in _pairs([k.label for k in x], [k.label for k in y]):
        for k in (*x[i:p], *y[j:q]):
            k.opt = True
            out.kids.append(k)
        if p < len(x) and q < len(y):
            out.kids.append(align(x[p], y[q], same_page))
        i, j = p + 1, q + 1
    out.kids = fold(out.kids)
    return out


def _pairs(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal labels of both lists, rising in both, as many as can be; then the ends. Long lists pair equal ends and then each label with its next place."""
    n, m = len(x), len(y)
    out = []
    if n * m > CELLS:
        places: dict[str, list[int]] = {}
        for j in range(m - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        last = -1
        for i, label in enumerate(x):
            rest = places.get(label, [])
            while rest and rest[-1] <= last:
                rest.pop()
            # a far jump would leave the labels between without a partner
            if rest and rest[-1] - last <= 64:
                last = rest.pop()
                out.append((i, last))
        return [*out, (n, m)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return [*out, (n, m)]


def expression(part: Part) -> str:
    """The wrapper as a regular expression over tags: ? optional, + repeated, #PCDATA a slot, constant texts as #const."""
    if part.label == "#":
        body = "#PCDATA" if part.text is None else "#const"
    else:
        inner = " ".join(expression(k) for k in part.kids)
        body = f"({inner})" if part.label == "()" else f"<{part.label}>{inner}</{part.label.split('.')[0]}>"
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[(part.opt, part.rep)]
    return f"({body}){mark}" if mark and part.label != "()" else body + mark


def _children(p: Part) -> list[Part]:
    """The parts below p in order, those of repeated groups in their place."""
    return [k for g in p.kids for k in (g.kids if g.label == "()" else [g])]


def _slot_chars(p: Part) -> int:
    """Characters below p that vary from page to page and are not in links."""
    if p.label == "#":
        return max(0, p.chars - p.links) if p.text is None else 0
    return 0 if _is_out(p.label) else sum(_slot_chars(k) for k in p.kids)


def decide(wrapper: Part) -> dict:
    """What a page of the host needs: the path to the article, and the paths of template texts and of link lists around its slots."""
    best: tuple[int, list[str]] = (0, [])

    def search(p: Part, way: list[str]) -> None:
        nonlocal best
        if p.label == "#" or _is_out(p.label):
            return
        way = way if p.label == "()" else [*way, p.label]
        if _is_main(p.label) and p.chars > best[0]:
            best = (p.chars, way)
        for k in p.kids:
            search(k, way)

    search(wrapper, [])
    at, way = wrapper, [wrapper.label]
    if best[1]:
        way = best[1]
        for name in way[1:]:
            at = next(k for k in _children(at) if k.label == name)
    else:
        # no name tells the article: down to the part that holds the slots, or on a single page the plain text
        weigh = _slot_chars if _slot_chars(wrapper) else lambda k: 0 if _is_out(k.label) else k.chars - k.links
        while True:
            top = max((k for k in _children(at) if k.label != "#"), key=weigh, default=None)
            total = sum(weigh(k) for k in _children(at))
            if top is None or top.rep or weigh(top) < 0.75 * total or not total or not any(k.label != "#" for k in _children(top)):
                break
            at, way = top, [*way, top.label]

    # texts and link lists in the order of the article: (kind, path, text)
    found: list[tuple[str, str, int | None]] = []

    def inside(p: Part, path: str, fixed: bool) -> None:
        for g in p.kids:
            for k in _children(g) if g.label == "()" else [g]:
                on = fixed and not (k.rep or g.rep)
                if k.label == "#":
                    heading = re.search(r"/h[1-6]\b[^/]*$", path)
                    found.append(("slot" if k.text is None else "template" if on and k.pages >= max(3, wrapper.pages / 2) and not heading else "kept", path, k.text))
                elif not _is_out(k.label):
                    if not best[1] and k.chars and k.links > 0.8 * k.chars and k.label.split(".")[0] in ("ul", "ol", "div", "section", "table", "dl"):
                        found.append(("list", f"{path}/{k.label}", None))
                    else:
                        inside(k, f"{path}/{k.label}", on)

    inside(at, "", True)
    slots = [i for i, (kind, _, _) in enumerate(found) if kind == "slot"]
    around = [x for i, x in enumerate(found) if slots and not slots[0] < i < slots[-1]]
    # a path and text that also stands between slots stays
    within = {(path, text) for i, (_, path, text) in enumerate(found) if slots and slots[0] <= i <= slots[-1]}
    template = [[path, text] for kind, path, text in around if kind == "template" and (path, text) not in within]
    lists = [path for kind, path, _ in around if kind == "list" and (path, None) not in within]
    return {"way": way, "template": template, "lists": lists}


def extract(page: str | None, decision: dict) -> str:
    """The article's blocks joined by line feeds."""
    root = parse(page)
    way = decision.get("way") or ["html"]
    at = [root]
    for label in way[1:]:
        at = [k for n in at for k in n.kids if not isinstance(k, str) and k.label == label]
    if not at:
        at = _mains(root) or [root]
    template = {(p, t) for p, t in decision.get("template", ())}
    lists = set(decision.get("lists", ()))
    blocks: list[str] = []
    held: list[str] = []
    sign = 0

    def flush(path: str) -> None:
        nonlocal held, sign
        text = " ".join(html.unescape("".join(held)).split())
        if text and (path, sign) not in template:
            blocks.append(text)
        held, sign = [], 0

    def walk(n: Node, path: str, headings_only: bool = False) -> None:
        nonlocal sign
        for k in n.kids:
            if isinstance(k, str):
                if not headings_only:
                    held.append(k)
                    if t := "".join(k.split()):
                        sign = zlib.crc32(t.encode("utf-8", "replace"), sign)
            elif _is_out(k.label):
                held.append(" ")
                if k.tag not in _INLINE:
                    flush(path)
            elif k.tag in _INLINE:
                if k.tag in ("br", "wbr", "img"):
                    held.append("" if k.tag == "wbr" else " ")
                walk(k, path, headings_only)
            else:
                flush(path)
                below = f"{path}/{k.label}"
                if below not in lists:
                    only = (headings_only or k.tag == "header") and not re.fullmatch("h[1-6]|hgroup", k.tag)
                    walk(k, below, only)
                    flush(below)

    for n in at:
        walk(n, "")
        flush("")
    return "\n".join(blocks)


def _mains(root: Node) -> list[Node]:
    todo, found = [root], []
    while todo:
        n = todo.pop()
        if not isinstance(n, str) and not _is_out(n.label):
            if _is_main(n.label):
                found.append(n)
            else:
                todo += reversed(n.kids)
    return found


def _partial_wrappers(it):
    held: dict[str, Part] = {}

    def give():
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w.dump()) for w in held.values()], pa.string())], names=["host", "wrapper"])
        held.clear()
        return rows

    for batch in it:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = as_part(parse(page))
            held[name] = align(held[name], part) if name in held else part
        if len(held) > HELD_HOSTS:
            yield give()
    yield give()


def _merged_wrappers(pdf):
    """One partial wrapper for those of a host and salt."""
    import pandas as pd

    whole = reduce(align, [Part.load(json.loads(x)) for x in sorted(pdf.wrapper)])
    return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [json.dumps(whole.dump())]})


def _joined_wrappers(pdf):
    import pandas as pd

    whole = reduce(align, [Part.load(json.loads(x)) for x in sorted(pdf.wrapper)])
    return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [json.dumps(whole.dump())], "expression": [expression(whole)], "decision": [json.dumps(decide(whole))]})


def _different(pages: DataFrame) -> DataFrame:
    """(host, html): each page of a host once, however often it is repeated; only pages that are repeated are moved."""
    named = pages.select(host(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("digest"))
    twice = store(named.groupBy("host", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("host", "digest"), "copies")
    twice = sized_broadcast(twice, F.length("host") + 24)
    once = named.join(twice, ["host", "digest"], "left_anti").select("host", "html")
    return once.unionByName(named.join(twice, ["host", "digest"]).groupBy("host", "digest").agg(F.any_value("html").alias("html")).select("host", "html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, expression, decision) of each host of pages(url, html): its wrapper as JSON and as a regular expression."""
    partial = _different(pages).mapInArrow(_partial_wrappers, "host string, wrapper string")
    # the partial wrappers of a host with many pages are joined in two steps
    partial = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInPandas(_merged_wrappers, "host string, wrapper string")
    return partial.groupBy("host").applyInPandas(_joined_wrappers, "host string, wrapper string, expression string, decision string")


@lru_cache(maxsize=4096)
def _decision(text: str) -> dict:
    return json.loads(text)


def _text_rows():
    def run(it):
        for batch in it:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            texts = [extract(page, _decision(d or "{}")) for page, d in rows]
            n = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html, ...); other columns are not read.

    Null and empty html gives an empty text; pages of any length are read whole. A null url, or one without a host,
    shares the wrapper of the empty host. Repeated rows are extracted each, and change no
    other page's text, as wrappers are made from different pages; ties between parts that
    hold as much go to the first. White
    space inside a block becomes one space, blocks are joined by \\n, an inline
    element does not break a block and a line break (br) is white space.
    """
    ship(pages.sparkSession)
    found = store(wrappers(pages).select("host", "decision"), "wrappers")
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = named.join(sized_broadcast(found, F.length("decision") + F.length("host") + 40), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "decision").mapInArrow(_text_rows(), f"page_id {kind}, url string, text string, n_chars long")

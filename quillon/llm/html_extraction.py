"""HTML extraction by wrapper induction.

Pages of a host share a template.  Every different page of a host is parsed, and its texts
are counted by place (the path of labels from the root) and wording: once over the
host, once over the host's section (first directory of the url) and once over its layout
(the pages with the same set of named blocks).  A text that stays the same in ``CONSTANT``
of the pages of one of these groups is the template's; the other texts fill slots, and the
deepest element that holds most slot text is the host's main place.
Every page is then cut into blocks.  Blocks of template texts only go, as do elements that are
menus, headers, footers, sidebars, notices, adverts, forms or comments by their
element, role or class.  Of the rest the host's main place is taken: the article or main
element (or one named so) in it or around it, else the place itself.  Only pages without that place, and hosts
without a wrapper, go by such an element alone or by the deepest block that holds most of
the text.  Where no element bounds the article, blocks that are all links go.

Simple tree matching from the root pairs nodes of equal label paths only, so texts that it
pairs have the same place here; places are counted instead of pairs being matched since a count covers
all pages of a host in one pass, and matching costs the product of two pages' sizes for each pair.

Scale: pages aren't grouped by host.  Copies of a page are merged by hash, texts are counted
in the tasks that parse them and then by hash of group, place and wording, so a hot
host costs its pages only.  What is kept of a group is less than 1 / ``CONSTANT`` times the
texts of a mean page; wrappers are broadcast if they measure less than
``BROADCAST_BYTES``, else joined.

Edge cases: null counts as an empty page, whose text is empty; a url without host has
the host ""; fewer than ``LEAST`` different pages of a group make no template, nor do pages
that differ in nothing; a section or layout most of whose text stays the same holds copies of an
article, and makes none; repeated rows each get a row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.html_tree import BLOCKS, Node, parse
from quillon.llm.shared import cut

LEAST, CONSTANT, BROADCAST_BYTES, HELD = 4, 0.8, 32 << 20, 100_000

#: Elements, roles and class or id words of what is no main text.
APART = frozenset("head script style noscript template nav header footer aside form button select textarea iframe svg canvas object dialog menu audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert
    popup modal overlay newsletter subscribe subscription signup login sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar topbar
    share sharing social related recommended recommendations trending teaser teasers comment comments respond replies disqus pager pagination widget widgets search skip copyright disclaimer""".split()
)
MAIN_NAMES = frozenset("article articlebody post entry story content main maincontent".split())

_WORD = re.compile(r"[a-z0-9]+")


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def section_of(url: Column) -> Column:
    """The first directory of the url's path."""
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def layout_of(page: Column) -> Column:
    """The set of a page's named blocks, without the numbers that tell pages apart."""
    named = F.regexp_extract_all(F.lower(page), F.lit(r"<((?:article|aside|body|div|footer|form|header|main|nav|ol|section|table|ul)\s[^>]*?\b(?:class|id)\s*=\s*[\"']?[^\s\"'>]+)"), F.lit(1))
    return F.concat_ws(" ", F.array_sort(F.array_distinct(F.transform(named, lambda x: F.regexp_replace(x, r"\d+", "")))))


def _names(node: Node) -> set[str]:
    a = node.attributes
    return set(_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())) if a else set()


def _size(node: Node) -> int:
    """Characters of text below."""
    return sum(len(n.text) for n in node.nodes() if n.tag == "#")


def _apart(node: Node, in_main: bool, whole: int) -> bool:
    tag, a = node.tag, node.attributes
    if tag in APART:
        return not (tag == "header" and in_main)
    if not a or tag in ("html", "body", "main"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    found = _names(node) & NAMES
    if in_main or tag == "article":
        found -= {"header"}
    # a wrapper named after something it also holds ("content-with-sidebar")
    return bool(found) and not (_names(node) & MAIN_NAMES and _size(node) > 0.6 * whole) and not any(n.tag in ("article", "main") and n is not node for n in node.nodes())


class Block:
    __slots__ = ("texts", "text", "linked")

    def __init__(self, texts: list[tuple[str, str]], text: str, linked: int):
        """texts: of each text node that isn't blank, the path of its element, and its text."""
        self.texts, self.text, self.linked = texts, text, linked


def blocks(top: Node, path: str, in_main: bool, whole: int) -> list[Block]:
    """The blocks of text below an element, without what stands apart."""
    out: list[Block] = []
    parts: list[str] = []
    texts: list[tuple[str, str]] = []
    state = {"linked": 0}

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(Block(texts.copy(), text, state["linked"]))
        parts.clear()
        texts.clear()
        state["linked"] = 0

    # an explicit stack: pages nest deeper than calls may
    todo: list[tuple] = [("open", top, path, in_main, False)]
    while todo:
        what, node, at, inside, linked = todo.pop()
        if what == "close":
            flush()
            continue
        if node.tag == "#":
            parts.append(node.text)
            if text := " ".join(node.text.split()):
                texts.append((at, text))
            state["linked"] += len(node.text.strip()) * linked
            continue
        if node is not top and _apart(node, inside, whole):
            if node.tag in BLOCKS:
                flush()
            continue
        if node.tag == "br":
            parts.append(" ")
        here = f"{at}/{node.label()}" if node is not top else at
        block = node.tag in BLOCKS
        if block:
            flush()
            todo.append(("close", node, at, inside, linked))
        inside = inside or node.tag in ("article", "main")
        todo += [("open", c, here, inside, linked or node.tag == "a") for c in reversed(node.children)]
    flush()
    return out


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _mark(path: str, text: str) -> int:
    return _key(f"{path}\0{text}")


def _within(group: int, mark: int) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<qq", group, mark)) - (1 << 63)


def _candidates(root: Node) -> list[tuple[str, Node]]:
    """Elements that stand apart from nothing, in page order, with their paths."""
    whole, out = _size(root), []
    todo = [("", root, False)]
    while todo:
        path, node, inside = todo.pop()
        at = f"{path}/{node.label()}"
        if node.tag == "#" or (node is not root and _apart(node, inside, whole)):
            continue
        out.append((at, node))
        todo += [(at, c, inside or node.tag in ("article", "main")) for c in reversed(node.children)]
    return out


def _plain(root: Node) -> dict[int, int]:
    """Characters of text outside links below each element."""
    out: dict[int, int] = {}
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, linked, done = todo.pop()
        if node.tag == "#":
            out[id(node)] = 0 if linked else len(node.text.strip())
        elif done:
            out[id(node)] = sum(out[id(c)] for c in node.children)
        else:
            todo.append((node, linked, True))
            todo += [(c, linked or node.tag == "a", False) for c in node.children]
    return out


def _densest(found: list[tuple[str, Node]]) -> list[tuple[str, Node]]:
    """The deepest block, of those in found, with most of the plain text that the largest has."""
    sizes, blocks_ = _plain(found[0][1]), [(p, n) for p, n in found if n.tag in BLOCKS and n.tag not in ("p", "html")]
    if not blocks_:
        return []
    apart = {id(n) for _, n in found}
    for _, n in reversed(found):  # without what stands apart
        sizes[id(n)] = sum(sizes[id(c)] for c in n.children if c.tag == "#" or id(c) in apart)
    most = max(sizes[id(n)] for _, n in blocks_)
    return [max((x for x in blocks_ if sizes[id(x[1])] >= 0.7 * most), key=lambda x: x[0].count("/"))] if most else []


#: A page's part in a group (KIND 0: level in deep, characters of its texts in size), a text (1: its element in up) or
#: an element (2: m is its path's key, up its parent's, deep the path's length if it may be a main place); plain counts characters outside links.
ROWS = "kind int, g long, m long, up long, deep long, size long, plain long, n long"


def _count(counts: dict, page: str, groups: list[tuple[int, int]]) -> None:
    """Adds a page to the counts of its groups (key and level: 0 host, else section or layout), of which the first is the host."""
    root = parse(page)
    whole, texts, elements = _size(root), {}, []
    todo = [("", 0, root, False, False)]
    while todo:
        path, up, node, inside, linked = todo.pop()
        if node.tag == "#":
            if text := " ".join(node.text.split()):
                old = texts.get(mark := _mark(path, text), (up, 0, 0))
                texts[mark] = (up, old[1] + len(text), old[2] + len(text) * (not linked))
            continue
        if node is not root and _apart(node, inside, whole):
            continue
        path = f"{path}/{node.label()}"
        key = _key(path)
        elements.append((key, up, len(path) if node.tag in BLOCKS and node.tag != "p" else 0))
        inside, linked = inside or node.tag in ("article", "main"), linked or node.tag == "a"
        todo += [(path, key, c, inside, linked) for c in reversed(node.children)]
    parents, plain = {key: up for key, up, _ in elements}, dict.fromkeys((key for key, _, _ in elements), 0)
    for up, _, n in texts.values():
        plain[up] += n
    for key in reversed(parents):  # parents come before their children
        if parents[key]:
            plain[parents[key]] += plain[key]

    def add(kind: int, g: int, m: int, up: int, deep: int, size: int, n: int) -> None:
        old = counts.setdefault((kind, g, m), [up, deep, 0, 0, 0])
        old[2:] = old[2] + size, old[3] + n, old[4] + 1

    for g, level in groups:
        add(0, g, 0, 0, level, sum(x[1] for x in texts.values()), sum(x[2] for x in texts.values()))
        for mark, (up, size, n) in texts.items():
            add(1, g, _within(g, mark), up, 0, size, n)
    for key, up, deep in {x[0]: x for x in elements}.values():
        add(2, groups[0][0], key, up, deep, 0, plain[key])


def _main(elements: list[tuple[int, int, int, int]], constant: list[tuple[int, int]]) -> int | None:
    """The key of the main place.  elements: m, up, deep, plain.  constant: up and plain of the template's texts."""
    parents, slots = {m: up for m, up, _, _ in elements}, {m: n for m, _, _, n in elements}
    for at, n in constant:
        while at and n:
            slots[at] -= n
            at = parents[at]
    usable = [(deep, m) for m, _, deep, _ in elements if deep and slots[m] > 0]
    whole = max((slots[m] for _, m in usable), default=0)
    return max(((deep, m) for deep, m in usable if slots[m] >= 0.7 * whole), default=(0, None))[1]


def induce(pages: list[str]) -> dict:
    """The wrapper of a host's pages: marks of the template's texts, and the path of the main place."""
    pages, counts = sorted(set(pages)), {}
    for p in pages:
        _count(counts, p, [(0, 0)])
    constant = {m: x for (kind, _, m), x in counts.items() if kind == 1 and x[4] >= CONSTANT * len(pages)}
    if len(pages) < LEAST or sum(x[2] for x in constant.values()) == counts[0, 0, 0][2]:
        return {}  # too few, or they differ in nothing
    main = _main([(m, x[0], x[1], x[3]) for (kind, _, m), x in counts.items() if kind == 2], [(x[0], x[3]) for x in constant.values()])
    return {"template": sorted(constant), "main": next((path for p in pages for path, _ in _candidates(parse(p)) if _key(path) == main), "")}


def extract(page: str, wrapper: dict) -> str:
    """The main text of a page: its blocks, an empty line between them.

    wrapper: template, main (a path or its key), and the groups whose marks the template holds.
    """
    if not page:
        return ""
    root = parse(page)
    whole, found = _size(root), _candidates(root)
    by = lambda test: [(p, n) for p, n in found if test(p, n)]
    tops = by(lambda p, n: n.tag == "article") or by(lambda p, n: n.tag == "main" or n.attributes.get("role") == "main")
    if not tops:
        named = by(lambda p, n: n.tag in BLOCKS and n.tag not in ("html", "body") and (_names(n) & MAIN_NAMES or "articlebody" in n.attributes.get("itemprop", "").lower()))
        tops = [max(named, key=lambda x: _size(x[1]))] if named and max(_size(n) for _, n in named) > 0.3 * whole else []
    marked, main = bool(tops), wrapper.get("main")
    if main:
        main = _key(main) if isinstance(main, str) else main
        places, sizes = by(lambda p, n: _key(p) == main), _plain(root)
        held = lambda some: sum(sizes[id(n)] for _, n in some)
        largest = max(places, key=lambda x: sizes[id(x[1])], default=None)
        if largest and sizes[id(largest[1])] >= 0.5 * held(places):
            places = [largest]
        # the host's main place decides, if this page fills it; an article in it, or around it, bounds the text
        if held(places) and 3 * held(places) >= held(tops):
            below = {id(n) for _, x in places for n in x.nodes()}
            tops = [x for x in tops if id(x[1]) in below] or [x for x in tops if any(id(n) in below for n in x[1].nodes())]
            tops, marked = tops or places, bool(tops)
    tops = tops or _densest(found) or found[:1]
    template, groups, out, inner = set(wrapper.get("template", ())), wrapper.get("groups", (0,)), [], set()

    def fixed(block: Block) -> bool:
        marks = (_mark(*x) for x in block.texts)
        return bool(template) and all(any(_within(g, m) in template for g in groups) for m in marks)

    for path, top in tops:
        if id(top) in inner:
            continue
        inner |= {id(n) for n in top.nodes()}
        here = blocks(top, path, top.tag in ("article", "main"), whole)
        # where nothing marks the article, blocks that are all links are menus
        out += [b.text for b in here if not fixed(b) and (marked or b.linked < 0.8 * len(b.text))]
    return "\n\n".join(out)


GROUPS = ["host", "section", "layout"]


def grouped(pages: DataFrame) -> DataFrame:
    """pages with html as text, and the keys of the groups each is in."""
    html, host = F.coalesce(F.col("html").cast("string"), F.lit("")), host_of(F.col("url").cast("string"))
    keys = [F.xxhash64(host), F.xxhash64(F.lit(1), host, section_of(F.col("url").cast("string"))), F.xxhash64(F.lit(2), host, layout_of(html))]
    return pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), *(k.alias(name) for k, name in zip(keys, GROUPS, strict=True)))


def wrappers(rows: DataFrame) -> DataFrame:
    """host, section, layout, template and main of the groups of pages that have one."""
    different = rows.groupBy("host", "layout", F.md5(F.col("html").cast("binary")).alias("k")).agg(F.collect_set("section").alias("sections"), F.first("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list] = {}
        names = [x.split()[0] for x in ROWS.split(", ")]

        def held() -> pa.RecordBatch:
            columns = list(zip(*((*k, *v) for k, v in counts.items()), strict=True)) or [[]] * len(names)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(columns)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for host, layout, sections, page in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    _count(counts, page, [(host, 0), (layout, 2), *((s, 1) for s in sections)])
                    if len(counts) > HELD:
                        yield held()
        yield held()

    counted = different.select("host", "layout", "sections", "html").mapInArrow(run, ROWS)
    total = counted.groupBy("kind", "g", "m").agg(F.max("up").alias("up"), F.max("deep").alias("deep"), *(F.sum(c).alias(c) for c in ("size", "plain", "n")))
    total = cut(total.filter((F.col("kind") != 1) | (F.col("n") >= LEAST)), "texts")
    groups = total.filter((F.col("kind") == 0) & (F.col("n") >= LEAST)).select("g", F.col("deep").alias("level"), F.col("n").alias("pages"), F.col("size").alias("whole"))
    constant = cut(total.filter("kind = 1").join(groups, "g").filter(F.col("n") >= CONSTANT * F.col("pages")), "constant")
    fixed = constant.groupBy("g").agg(F.collect_list("m").alias("template"), F.sum("size").alias("fixed"))
    found = groups.join(fixed, "g", "left").fillna(0, ["fixed"]).filter(F.when(F.col("level") == 0, F.col("fixed") < F.col("whole")).otherwise(2 * F.col("fixed") <= F.col("whole")))
    found = cut(found.select("g", "level", F.coalesce("template", F.array().cast("array<long>")).alias("template")), "groups")

    def place(pdf):
        import pandas as pd

        elements, texts = pdf[pdf["kind"] == 2], pdf[pdf["kind"] == 1]
        main = _main(list(zip(*(elements[c].tolist() for c in ("m", "up", "deep", "plain")), strict=True)), list(zip(texts["up"].tolist(), texts["plain"].tolist(), strict=True)))
        return pd.DataFrame({"g": pdf["g"][:1], "main": pd.array([main], "Int64")})

    columns = ["g", "kind", "m", "up", "deep", "plain"]
    hosts = found.filter("level = 0").select("g")
    parts = total.filter("kind = 2").select(columns).unionByName(constant.filter("level = 0").select(columns)).join(hosts, "g", "left_semi")
    mains = cut(parts.groupBy("g").applyInPandas(place, "g long, main long"), "mains")

    met = rows.select(GROUPS).distinct()
    for name in GROUPS:
        met = met.join(found.select(F.col("g").alias(name), F.col("template").alias(f"of_{name}")), name, "left")
    met = met.join(mains.withColumnRenamed("g", "host"), "host", "left")
    template = F.concat(*(F.coalesce(f"of_{name}", F.array().cast("array<long>")) for name in GROUPS))
    return met.select(*GROUPS, template.alias("template"), "main").filter((F.size("template") > 0) | F.col("main").isNotNull())


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = grouped(pages)
    found = cut(wrappers(rows), "wrappers")
    small = (found.agg(F.sum(8 * F.size("template") + 40)).first()[0] or 0) < BROADCAST_BYTES
    rows = rows.join(F.broadcast(found) if small else found, GROUPS, "left").select("page_id", "url", "html", *GROUPS, "template", "main")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece, texts = batch.slice(lo, 512), []
                for i, (page, *groups) in enumerate(zip(*(c.to_pylist() for c in piece.columns[2:6]), strict=True)):
                    wrapper = known.get(key := tuple(groups))
                    if wrapper is None:
                        known = {} if len(known) > 1000 else known
                        wrapper = known[key] = {"groups": key, "template": frozenset(piece.column(6)[i].as_py() or ()), "main": piece.column(7)[i].as_py()}
                    texts.append(extract(page, wrapper))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

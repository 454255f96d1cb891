"""A small forgiving HTML parser, in time linear in the page however broken that is.

Tags are found by a scanner that reads every character at most twice; open elements are
looked up by name, so an end tag costs what it closes.  Elements nested more than ``DEPTH`` deep
stand beside their parent's other children, as in browsers, so paths stay short.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Fixed values of HTML: elements without content, of raw text, and those that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's start closes, up to the nearest of the elements in the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

DEPTH = 512

_NUMBER = re.compile(r"\d+")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^'\">]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element, or a text (tag "#", with its characters in ``text``)."""

    __slots__ = ("tag", "attributes", "children", "text")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attributes, self.text = tag, attributes or {}, text
        self.children: list[Node] = []

    def label(self) -> str:
        """Element and first class, or id, without the numbers that tell pages apart."""
        name = (self.attributes.get("class") or self.attributes.get("id") or "").split()
        return f"{self.tag}.{_NUMBER.sub('', name[0])}" if name else self.tag

    def nodes(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)

    def walk(self, path: str = "") -> Iterator[tuple[str, Node]]:
        stack = [(path, self)]
        while stack:
            path, node = stack.pop()
            at = f"{path}/{node.label()}"
            yield at, node
            stack += [(at, c) for c in reversed(node.children)]


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Where each tag starts and ends, whether it is an end tag, its name and the rest; comments and declarations have no name.

    The consumer may send a place to go on from.  A "<" that begins nothing is text.  Once quotes of a
    tag don't close, tags of the page end at the next ">", quoted or not.
    """
    at, quotes = 0, True
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            at = (yield start, at, False, "", "") or at
            continue
        name = _NAME.match(source, start + 1)
        if name is None:
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                end = source.find(">", start + 2)
                if end < 0:
                    break
                at = end + 1
                at = (yield start, at, False, "", "") or at
            continue
        end = name.end()
        while quotes:
            end = _PLAIN.match(source, end).end()
            if end < len(source) and source[end] == ">":
                break
            end = source.find(source[end], end + 1) + 1 if end < len(source) else 0
            if not end:
                quotes = False
        if not quotes and (end := source.find(">", name.end())) < 0:
            break
        at = end + 1
        at = (yield start, at, name[0][0] == "/", name[0].lstrip("/").lower(), source[name.end() : end]) or at


class _Open:
    """The open elements, with the depths of those of each name, of blocks, and of what ``CLOSES`` asks for."""

    _ASKS = CLOSES | {"": ({"p"}, {"td", "th", "button", "table", "object"})}

    def __init__(self, root: Node):
        self.stack, self.named, self.blocks = [root], {}, [0]
        self.asked: dict[str, list[int]] = {k: [] for k in self._ASKS}
        self.beyond: dict[str, int] = {}  # elements too deep to be opened

    def push(self, node: Node) -> None:
        if len(self.stack) >= DEPTH:
            self.beyond[node.tag] = self.beyond.get(node.tag, 0) + 1
            return
        depth = len(self.stack)
        self.stack.append(node)
        self.named.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)
        for k, (names, limit) in self._ASKS.items():
            if node.tag in names or node.tag in limit:
                self.asked[k].append(depth)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.named[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
            for k, (names, limit) in self._ASKS.items():
                if node.tag in names or node.tag in limit:
                    self.asked[k].pop()

    def close_for(self, key: str) -> None:
        """Closes what the start of such an element closes."""
        at = self.asked[key]
        if at and self.stack[at[-1]].tag in self._ASKS[key][0]:
            self.cut(at[-1])

    def end(self, tag: str) -> None:
        if self.beyond.get(tag):
            self.beyond[tag] -= 1
        elif (at := self.named.get(tag)) and (tag in BLOCKS or at[-1] > self.blocks[-1]):
            self.cut(at[-1])


def parse(source: str) -> Node:
    root = Node("#root")
    opened, at = _Open(root), 0

    def add_text(piece: str) -> None:
        if piece:
            opened.stack[-1].children.append(Node("#", text=" " if piece.isspace() else html.unescape(piece)))

    found = tags(source)
    skip = None
    while True:
        try:
            start, end, ends, tag, rest = found.send(skip)
        except StopIteration:
            break
        skip = None
        add_text(source[at:start])
        at = end
        if not tag:
            continue
        if ends:
            opened.end(tag)
            continue
        if tag in BLOCKS:
            opened.close_for("")
        if tag in CLOSES:
            opened.close_for(tag)
        attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest and rest.strip("/ ") else {}
        node = Node(tag, attributes)
        opened.stack[-1].children.append(node)
        if tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(source, at)
            if tag == "title":
                node.children.append(Node("#", text=html.unescape(source[at : done.start() if done else len(source)])))
            at = skip = done.end() if done else len(source)
        elif tag not in VOID:
            opened.push(node)
    add_text(source[at:])
    return root

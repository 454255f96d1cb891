"""Changes to SQL text before Catalyst sees it, token by token: strings, quoted names and comments stay untouched."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<text>'(?:[^'\\]|\\.|'')*')
    |(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?[A-Za-z]*|\d+[A-Za-z]*)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark>.)""",
    re.X | re.S,
)

#: What ends the keys of an ORDER BY at its own depth.
_ENDS = frozenset("limit offset fetch rows range groups union intersect except minus window".split())


def tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup or "mark", m[0]) for m in _TOKEN.finditer(sql)]


def first_statement(sql: str) -> str:
    out = []
    for kind, text in tokens(sql):
        if kind == "mark" and text == ";" and "".join(out).strip():
            break
        if not (kind == "mark" and text == ";"):
            out.append(text)
    return "".join(out).strip()


def standard_names(sql: str) -> str:
    """"name" becomes `name`."""
    return "".join("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`" if kind == "name" and t[0] == '"' else t for kind, t in tokens(sql))


def float_literals(sql: str) -> str:
    """Numbers with a point or an exponent become FLOAT, the type of typed-CSV numbers."""
    return "".join(t + "F" if kind == "number" and re.fullmatch(r"[\d.]+(?:[eE][+-]?\d+)?", t) and re.search(r"[.eE]", t) else t for kind, t in tokens(sql))


def nulls_last(sql: str) -> str:
    """Every sort key that doesn't say where nulls go gets NULLS LAST."""
    out: list[str] = []
    stack: list[dict | None] = [None]  # per depth: the ORDER BY that is open there
    words: list[str] = []  # the last two words at this point

    def finish(state: dict | None) -> None:
        if state and not state["said"] and state["filled"]:
            at = len(out)
            while at and not out[at - 1].strip():
                at -= 1
            out.insert(at, " NULLS LAST")

    for kind, text in tokens(sql):
        word = text.lower() if kind == "word" else ""
        if kind == "mark" and text == "(":
            stack.append(None)
        elif kind == "mark" and text == ")" and len(stack) > 1:
            finish(stack.pop())
            if stack[-1]:
                stack[-1]["filled"] = True
        elif kind == "mark" and text == "," and stack[-1]:
            finish(stack[-1])
            stack[-1] = {"said": False, "filled": False}
        elif word in _ENDS and stack[-1]:
            finish(stack[-1])
            stack[-1] = None
        elif word == "nulls" and stack[-1]:
            stack[-1]["said"] = True
        elif kind != "skip" and stack[-1]:
            stack[-1]["filled"] = True
        out.append(text)
        if kind != "skip":
            words = (words + [word or text])[-2:]
            if words == ["order", "by"]:
                stack[-1] = {"said": False, "filled": False}
    while stack:
        finish(stack.pop())
    return "".join(out)


_SINGLE = re.compile(r"\s*select\s+(min|max|sum|avg|count)\s*\(\s*(?:[\w`]+\.)?`?(\w+)`?\s*\)(?:\s+(?:as\s+)?[\w`]+)?\s+from\b", re.I)


def single_aggregate(sql: str) -> tuple[str, str] | None:
    """(function, column) if the query is one aggregate of a bare column without groups."""
    found = _SINGLE.match(sql)
    depth, grouped, words = 0, False, [("", "")]
    for kind, text in tokens(sql):
        depth += (text == "(") - (text == ")") if kind == "mark" else 0
        if kind == "word" and depth == 0:
            grouped |= text.lower() == "by" and words[-1][1] == "group" or text.lower() in ("union", "intersect", "except")
            words.append((kind, text.lower()))
    return (found[1].lower(), found[2]) if found and not grouped else None

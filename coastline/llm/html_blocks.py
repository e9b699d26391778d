"""Leaf blocks of an HTML page: their text and the elements they stand in."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "title", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms mtext msup msub mfrac msqrt object q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open one ends where another of its group begins.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>?",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.IGNORECASE)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_PART = re.compile(r"[a-z]{2,}")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    """An open element: its parent, and the features that its ancestors don't have."""

    __slots__ = ("depth", "fresh", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, fresh: tuple[str, ...]):
        self.tag, self.parent, self.fresh, self.score = tag, parent, fresh, None
        self.depth = parent.depth + 1 if parent else 1

    def features(self) -> set[str]:
        """Those of the element and all around it."""
        out, node = set(), self
        while node:
            out.update(node.fresh)
            node = node.parent
        return out


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked  # linked: characters inside links


def _names(attrs: str) -> list[str]:
    """Words of class, id and role names; "mainContent" has two."""
    if "=" not in attrs:
        return []
    return [w for m in _NAMES.finditer(attrs) for w in _PART.findall(_HUMP.sub(" ", m[1] or m[2] or m[3] or "").lower())]


def _hidden(attrs: str) -> bool:
    """Whether an element isn't shown: by the attribute of that name, or by its style."""
    return _HIDDEN.search(attrs) is not None and (_HIDDEN.search(_QUOTED.sub("", attrs)) is not None or "display" in attrs.lower())


def blocks(html: str | None) -> list[Block]:
    """The page's non-empty blocks in order; white space inside each is one space.

    A line break is white space inside a block. Elements that aren't shown have no
    blocks. A header inside an article or main element is told from the page's.

    Time and memory grow with the page's length, whatever its depth: an
    element knows its parent, and only what it adds to it.
    """
    out: list[Block] = []
    stack: list[tuple[Node, list[str]]] = []
    seen: Counter = Counter()  # features of the open elements
    tags: Counter = Counter()
    parts: list[str] = []
    linked, links = 0, 0
    covered = 0  # the depth of the stack at which a hidden element is open, or 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][0] if stack else None, linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not covered:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop() -> None:
        nonlocal covered
        if covered == len(stack):
            covered = 0
        node, own = stack.pop()
        tags[node.tag] -= 1
        seen.subtract(own)

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag == "br":
            add(" ")
        if tag in INLINE or tag == "br":
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if tags[tag]:
                while stack[-1][0].tag != tag:
                    pop()
                pop()
                links = 0
            continue
        group = SELF_CLOSING.get(tag, "").split()
        while stack and stack[-1][0].tag in group:
            pop()
        if not attrs.endswith("/"):
            own = [] if tag in ("html", "body") else list(dict.fromkeys(["in:header of article" if tag == "header" and (tags["article"] or tags["main"]) else f"in:{tag}", *(f"name:{n}" for n in _names(attrs))]))
            stack.append((Node(tag, stack[-1][0] if stack else None, tuple(f for f in own if not seen[f])), own))
            seen.update(own)
            tags[tag] += 1
            if not covered and attrs and _hidden(attrs):
                covered = len(stack)
    flush()
    return out

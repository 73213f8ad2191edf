"""A small tree of a saved page: enough to find elements by name, class and id, and to read their text (PA1, PA2)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements that take a line of their own, elements without content, and marks of a block page.
BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li tr table section article blockquote ul ol dl dt dd hr pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_MARKERS = ["zbyt dużą liczbę zapytań", "/captcharenderer/", 'id="captchaImage"', "captchaform", "Access Denied", "Request Rejected"]
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def has(self, tag: str = "", cls: str = "", id: str = "") -> bool:
        classes = (self.attrs.get("class") or "").split()
        return (not tag or self.tag == tag) and (not cls or cls in classes) and (not id or self.attrs.get("id") == id)

    def all(self, tag: str = "", cls: str = "", id: str = "") -> list[Node]:
        return [n for n in self.walk() if n.has(tag, cls, id)]

    def first(self, tag: str = "", cls: str = "", id: str = "") -> Node | None:
        return next((n for n in self.walk() if n.has(tag, cls, id)), None)

    def up(self, test) -> Node | None:
        n = self.parent
        while n is not None and not test(n):
            n = n.parent
        return n

    def after(self, tag: str) -> Node | None:
        """The next sibling of a kind."""
        if self.parent is None:
            return None
        nodes = [c for c in self.parent.children if isinstance(c, Node)]
        return next((n for n in nodes[nodes.index(self) + 1 :] if n.tag == tag), None)

    def pieces(self, skip=("script", "style")):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in skip:
                yield from c.pieces(skip)

    def text(self, between: str = "") -> str:
        parts = self.pieces()
        return squash(between.join(p.strip() if between else p for p in parts if p.strip() or not between))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES and self.at.tag in _CLOSES[tag]:
            self.at = self.at.parent
            if tag == "tr" and self.at.tag == "tr":
                self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def squash(text: str | None) -> str:
    return re.sub(r"[\s ​]+", " ", text or "").strip()


def block_text(node: Node | None, without=()) -> str:
    """PA1: a line for each block, inline elements joined, no empty lines, no scripts or styles.

    ``without``: nodes to leave out.
    """
    lines = [""]

    def read(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                lines[-1] += c.replace("\n", " ").replace("\r", " ")
            elif c.tag not in ("script", "style") and c not in without:
                if c.tag in BLOCKS:
                    lines.append("")
                read(c)
                if c.tag in BLOCKS:
                    lines.append("")

    if node is not None:
        read(node)
    plain = (x.replace(" ", " ").replace("​", "").replace("‑", "-") for x in lines)
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", p).strip() for p in plain) if x)


def looks_blocked(html: str | None) -> bool:
    """PA2."""
    return any(m in (html or "")[:8000] for m in BLOCK_MARKERS)

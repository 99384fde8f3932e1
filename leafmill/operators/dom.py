"""A small document tree over the standard library's parser, for the operators that need a page's structure."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

# Element names of the HTML standard, by how they nest and end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
RAW = frozenset(("script", "style"))
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
FENCES = frozenset("ul ol dl table article main section div body blockquote".split())


class Node:
    """An element, with children that are elements or strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def add(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def up(self) -> Iterator[Node]:
        """The element itself and those around it."""
        n: Node | None = self
        while n is not None:
            yield n
            n = n.parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def replace(self, other: Node) -> None:
        siblings = self.parent.children
        siblings[next(i for i, c in enumerate(siblings) if c is self)] = other
        other.parent = self.parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.at = self.root

    def end(self, tags: tuple[str, ...]) -> None:
        for n in self.at.up():
            if n.tag in tags:
                self.at = n.parent
                return
            if n.tag in FENCES:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.end(("p",))
        if tag in ENDS:
            self.end(ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.at.add(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "circle"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        for n in self.at.up():
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data):
        self.at.add(data)


def parse(source: str) -> Node:
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    return builder.root


def body_of(root: Node) -> Node:
    return next(root.find("body"), root)


def serialise(node: Node | str) -> str:
    if isinstance(node, str):
        raw = html.escape(node, quote=False)
        return raw
    inner = "".join(c if isinstance(c, str) and node.tag in RAW else serialise(c) for c in node.children)
    if node.tag == "#document":
        return inner
    attrs = "".join(f' {k}="{html.escape(v, quote=True)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"

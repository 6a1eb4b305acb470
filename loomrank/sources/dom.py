"""A small document tree from HTML, for readers that run inside Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in _BLOCKS}
_STOP = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)  # elements and texts

    def elements(self) -> Iterator[Element]:
        """All elements below, in the order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def find_all(self, *tags: str, where: Callable[[Element], bool] | None = None) -> list[Element]:
        return [e for e in self.elements() if (not tags or e.tag in tags) and (where is None or where(e))]

    def text(self) -> str:
        """The text of all nodes below, white space as single spaces."""
        parts, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                stack.extend(reversed(x.children))
        return " ".join("".join(parts).split())

    def closest(self, test: Callable[[Element], bool]) -> Element | None:
        e: Element | None = self
        while e is not None and not test(e):
            e = e.parent
        return e

    def has_class(self, *names: str) -> bool:
        return bool(set(self.attrs.get("class", "").split()) & set(names))

    def following(self) -> list[Element]:
        """Elements after this one with the same parent."""
        if self.parent is None:
            return []
        own = [c for c in self.parent.children if isinstance(c, Element)]
        return own[next(k for k, c in enumerate(own) if c is self) + 1 :]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends, stop = _ENDS.get(tag, ()), _STOP.get(tag, {"td", "th", "table", "button"})
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in ends:
                del self.open[k:]
                break
            if self.open[k].tag in stop:
                break
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(page: str | None) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def body(root: Element) -> Element:
    return next(iter(root.find_all("body")), root)


def normalized(text: str) -> str:
    return re.sub(r"\s+", " ", text or "").strip()

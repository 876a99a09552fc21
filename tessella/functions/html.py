"""Heading, title, bold and italic texts of HTML pages.

A small part of the HTML tree rules on top of the standard library's scanner:
raw-text elements, void elements, ends that others imply, and formatting
elements (b, i, ...) that open again in the next block when they were not
closed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from tessella.functions.entities import unescaped_texts

TAGS = {"title": "title", "h1": "h1", "h2": "h2", "h3": "h3", "b": "b", "strong": "b", "i": "i", "em": "i"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SPECIAL = _CLOSES_P | frozenset("body html li dd dt td th tr tbody caption button".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    __slots__ = ("attributes", "first", "name", "text")

    def __init__(self, name: str, attributes: tuple) -> None:
        self.name, self.attributes = name, attributes
        self.first = ""  # kind of the first child: "", "text" or "element"
        self.text: list[str] = []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.formats: list[_Node] = []
        self.found: list[_Node] = []

    # -- building -----------------------------------------------------------------

    def _enter(self, name: str, attributes: tuple) -> _Node:
        if self.open and not self.open[-1].first:
            self.open[-1].first = "element"
        elif self.open and self.open[-1].first == "text":
            self.open[-1].first = "done"  # its first text has ended
        node = _Node(name, attributes)
        self.open.append(node)
        if name in TAGS:
            self.found.append(node)
        return node

    def _names(self) -> list[str]:
        return [n.name for n in self.open]

    def _leave(self, name: str) -> None:
        while self.open and self.open.pop().name != name:
            pass

    def _restore(self) -> None:
        """Open again the formatting elements that a block's end has closed."""
        for k, node in enumerate(self.formats):
            if node not in self.open:
                self.formats[k] = self._enter(node.name, node.attributes)

    def _close_p(self) -> None:
        if "p" in self._names():
            self._leave("p")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = tuple(attrs)
        if tag in ("html", "head", "body"):
            return
        if tag in _CLOSES_P:
            self._close_p()
        if tag in _HEADINGS and self.open and self.open[-1].name in _HEADINGS:
            self.open.pop()
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            for node in reversed(self.open):
                if node.name == tag or {node.name, tag} == {"dd", "dt"}:
                    self._leave(node.name)
                    break
                if node.name in _SPECIAL and node.name not in ("address", "div", "p"):
                    break
            if tag in ("li", "dd", "dt"):
                self._close_p()
        if tag == "a" and any(n.name == "a" for n in self.formats):
            self._end_format("a")
        if tag in _VOID:
            if tag not in ("link", "meta", "base", "hr"):
                self._restore()
            self._enter(tag, attributes)
            self.open.pop()
            return
        if tag in _FORMAT:
            self._restore()
            self.formats.append(self._enter(tag, attributes))
            same = [n for n in self.formats if (n.name, n.attributes) == (tag, attributes)]
            if len(same) > 3:
                self.formats.remove(same[0])
            return
        if tag not in _SPECIAL and tag not in ("title", "script", "style", "textarea"):
            self._restore()
        self._enter(tag, attributes)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _end_format(self, tag: str) -> None:
        """The end of a formatting element: it closes, what was opened inside blocks stays open in them."""
        node = next((n for n in reversed(self.formats) if n.name == tag), None)
        if node is None:
            if tag in self._names():
                self._leave(tag)
            return
        self.formats.remove(node)
        if node not in self.open:
            return
        at = self.open.index(node)
        block = next((k for k in range(at + 1, len(self.open)) if self.open[k].name in _SPECIAL), None)
        if block is None:
            del self.open[at:]
        else:
            del self.open[at]

    def handle_endtag(self, tag: str) -> None:
        if tag in _FORMAT:
            self._end_format(tag)
        elif tag == "p" and "p" not in self._names():
            self._enter("p", ())
            self.open.pop()
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag in _HEADINGS:
            name = next((n for n in reversed(self._names()) if n in _HEADINGS), None)
            if name:
                self._leave(name)
        elif tag in self._names():
            if tag in _SPECIAL or tag in ("title", "script", "style"):
                self._leave(tag)
            else:
                for node in reversed(self.open):
                    if node.name == tag:
                        self._leave(tag)
                        break
                    if node.name in _SPECIAL:
                        break

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1].name in ("title", "script", "style", "textarea")) and data.strip():
            self._restore()
        if not self.open:
            return
        top = self.open[-1]
        if not top.first:
            top.first = "text"
        if top.first == "text":
            top.text.append(data)

    def handle_comment(self, data: str) -> None:
        if self.open:
            self.open[-1].first = self.open[-1].first and "done" if self.open[-1].first != "element" else "element"
            self.open[-1].first = self.open[-1].first or "element"


def tag_texts(html: str | None) -> dict[str, list[str]]:
    """For each kind of tag the leading texts of its elements, in document order, blanks collapsed."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out: dict[str, list[str]] = {}
    for node in tree.found:
        if node.text:
            out.setdefault(TAGS[node.name], []).append(" ".join("".join(node.text).split()))
    return {k: [t for t in v if t] for k, v in out.items() if any(v)}


_TOKEN = re.compile("[a-z0-9]+")


@F.arrow_udf(MapType(StringType(), ArrayType(StringType())))
def _tag_texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for page in pages:
        yield pa.array([list(tag_texts(html.as_py()).items()) for html in page], pa.map_(pa.string(), pa.list_(pa.string())))  # one page at a time


def tag_map(html: str | Column) -> Column:
    """MAP<tag, texts>, an Arrow UDF."""
    return _tag_texts(F.col(html) if isinstance(html, str) else html)


def tag_tokens(tags: str | Column) -> Column:
    """MAP<tag, tokens> of a tag map: its texts' tokens, one after another, not stemmed."""
    from tessella.functions.text import strip_tags, tokens

    column = F.col(tags) if isinstance(tags, str) else tags
    stripped = F.transform_values(column, lambda _, texts: F.transform(texts, strip_tags))
    return F.transform_values(unescaped_texts(stripped), lambda _, texts: F.flatten(F.transform(texts, tokens)))

"""HTML character references, by the rules of Go's html.UnescapeString."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([a-zA-Z0-9]+;?))")
#: The longest name that counts without its semicolon.
_LONGEST_BARE = max(len(name) for name in html5 if not name.endswith(";"))


def _character(code: int) -> str:
    if 0x80 <= code <= 0x9F:  # as in windows-1252, where that has a character
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)
    return "�" if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


def _resolved(found: re.Match) -> str:
    if found[3] is None:
        digits, base = (found[1], 16) if found[1] else (found[2], 10)
        return _character(int(digits.lstrip("0")[:9] or "0", base))  # nine digits are beyond all characters
    name = found[3]
    if name in html5:
        return html5[name]
    for size in range(min(len(name) - 1, _LONGEST_BARE), 1, -1):
        if name[:size] in html5:
            return html5[name[:size]] + name[size:]
    return found[0]


def unescape(text: str | None) -> str | None:
    """text with numeric and named references resolved once, with or without their semicolons."""
    return _REFERENCE.sub(_resolved, text) if text and "&" in text else text


def unescaped_array(texts: pa.Array) -> pa.Array:
    """unescape of strings; only those with an & become Python's."""
    has = pc.fill_null(pc.match_substring(texts, "&"), False)
    if not pc.any(has).as_py():
        return texts
    return pc.replace_with_mask(texts, has, pa.array([unescape(t) for t in texts.filter(has).to_pylist()], texts.type))


@F.arrow_udf(StringType())
def _unescaped(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for text in texts:
        yield unescaped_array(text)


@F.arrow_udf(MapType(StringType(), ArrayType(StringType())))
def _unescaped_maps(maps: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.map_(pa.string(), pa.list_(pa.string()))
    for each in maps:
        yield pa.array([None if tags is None else [(k, None if v is None else [unescape(t) for t in v]) for k, v in tags] for tags in each.to_pylist()], kind)


def unescaped(text: Column) -> Column:
    """unescape of a column, an Arrow UDF.

    Marked as nondeterministic so that Spark computes it, and what is made of
    it, once a row: it would inline a plain UDF's column where it is used, even
    in the lambda over all words.
    """
    return _unescaped.asNondeterministic()(text)


def unescaped_texts(tags: Column) -> Column:
    """unescape of all texts of a MAP<tag, texts>, as in unescaped."""
    return _unescaped_maps.asNondeterministic()(tags)

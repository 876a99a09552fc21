"""The English (Porter2) stemming algorithm, as published with the Snowball project."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_V = "[aeiouy]"
_R = re.compile("[aeiouy][^aeiouy]")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            one = len(head)
            break
    else:
        m = _R.search(w)
        one = m.end() if m else len(w)
    m = _R.search(w, one)
    return one, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in "aeiouy" and w[1] not in "aeiouy"
    return len(w) > 2 and w[-3] not in "aeiouy" and w[-2] in "aeiouy" and w[-1] not in "aeiouywxY"


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'") if word.startswith("'") else word
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub("([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end in ("eed", "eedly"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif re.search(_V, w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    for end in ("ization", "ational", "fulness", "ousness", "iveness", "tional", "biliti", "lessli", "entli", "ation", "alism", "aliti", "ousli", "iviti", "fulli", "enci", "anci", "abli", "izer", "ator", "alli", "bli", "ogi", "li"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    if w[:-3].endswith("l"):
                        w = w[:-1]
                elif end == "li":
                    if w[-3:-2] and w[-3] in "cdeghkmnrt":
                        w = w[:-2]
                else:
                    w = w[: -len(end)] + _STEP2[end]
            break
    # 3
    for end in ("ational", "tional", "alize", "icate", "iciti", "ative", "ical", "ness", "ful"):
        if w.endswith(end):
            if end == "ative":
                if len(w) - 5 >= r2:
                    w = w[:-5]
            elif len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP3[end]
            break
    # 4
    for end in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(end)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


class Stems(dict):
    """Stems of the words seen so far, emptied when it has grown large."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = stem(word)
        return out


@F.arrow_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = Stems()
    for words in batches:
        coded = words.flatten().cast(pa.string()).dictionary_encode()
        own = pa.array([None if w is None else known[w] for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), own, mask=words.is_null() if words.null_count else None)


def stems(words: str | Column) -> Column:
    """The stems of an array of words, in order.

    An Arrow UDF with a memory of words for each task: no shuffle of the
    vocabulary, and a word is stemmed once a task.
    """
    return _stems(F.col(words) if isinstance(words, str) else words)

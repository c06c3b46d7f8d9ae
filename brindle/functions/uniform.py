"""One uniform form of texts for the whole library: Unicode folded, then one scan that tells tokens apart.

Texts are folded in batches by Arrow's kernel. The scan finds typed tokens: dates, ranges between numbers, numbers with
their thousands, sign and percent sign, comparators, and words, also those broken at a line's end. From its pieces come
the tokens (for comparing), and the spelling (the text with its tokens in one form, for expressions that look further).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs that mean minus; comparators and their spellings; quotation marks, which no word is split at.
DASHES = "-−‒–—‐‑﹣－"
MARKS = {"<=": "≤", ">=": "≥", "+/-": "±", "+-": "±", "≤": "≤", "≥": "≥", "±": "±", "<": "<", ">": ">"}
QUOTATION = "‘’“”'\"`´"

_DASH = re.escape(DASHES)
_BREAK = r"-\s*\n\s*"
#: What begins a date is no number and ends no range.
_NO_DATE = rf"(?!\d{{4}}[{_DASH}/]\d{{1,2}}[{_DASH}/]\d{{1,2}}(?!\w))"
_KINDS = {
    "broken": rf"(?<=\w){_BREAK}(?=\w)",  # a word or number goes on in the next line
    "date": rf"(?<!\w)(?P<year>\d{{4}})[{_DASH}/](?P<month>\d{{1,2}})[{_DASH}/](?P<day>\d{{1,2}})(?!\w)",
    "range": rf"(?<=\d)\s*[{_DASH}]\s*(?=\d){_NO_DATE}",
    "mark": rf"<=|>=|\+/?[{_DASH}]|[≤≥±<>]",
    "number": rf"(?<![\w.])[+{_DASH}]?{_NO_DATE}\d+(?:{_BREAK}\d+)*(?:,\d{{3}}(?!\w))*(?:\.\d+)?(?:\s*%)?",
    "word": rf"[A-Za-z]+(?:(?:{_BREAK}|[{QUOTATION}]+)[A-Za-z]+)*",
    "digits": r"\d+(?:,\d{3}(?!\w))*(?:\s+(?=%))?",  # of a name or a longer number: no token
    "dash": rf"[{_DASH}]",
}
_SCAN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KINDS.items()))
_SILENT = ("digits", "dash", "broken")
_TO_HYPHEN = str.maketrans({dash: "-" for dash in DASHES})


def _piece(found: re.Match) -> str:
    """How a piece is spelt in the uniform form."""
    raw, kind = found[0], found.lastgroup if found.lastgroup not in ("year", "month", "day") else "date"
    if found["date"]:
        return f" DATE{int(found['year']):04d}{int(found['month']):02d}{int(found['day']):02d} "
    if kind == "range":
        return " to "
    if kind == "mark":
        return MARKS[raw.translate(_TO_HYPHEN)]
    if kind == "word":
        return re.sub(_BREAK, "", raw) if "\n" in raw else raw
    if kind == "broken":
        return ""
    plain = re.sub(_BREAK, "", raw).translate(_TO_HYPHEN).replace(",", "")
    return "".join(plain.split())


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


def spelt(folded: str) -> str:
    """A folded text with its tokens in the uniform form and all else as it is."""
    return _SCAN.sub(_piece, folded)


def tokens(text: str | None, folded: bool = False) -> list[str]:
    """Words in lower case, numbers with sign, decimals and percent sign, comparators, dates, and ``to`` for a range."""
    found = []
    for m in _SCAN.finditer(text or "" if folded else fold(text)):
        if m.lastgroup not in _SILENT:
            value = _piece(m).strip().lower()
            found.append(value.translate(_NO_QUOTATION) if m["word"] else value)
    return found


_NO_QUOTATION = str.maketrans("", "", QUOTATION)


def folded(texts: pd.Series) -> list[str]:
    """A batch of texts folded; nulls are empty."""
    return ["" if t is None else t for t in pc.utf8_normalize(pa.array(texts, pa.string(), from_pandas=True), form="NFKC").to_pylist()]


@F.pandas_udf(T.StringType())
def canon(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """texts in the uniform spelling."""
    for batch in batches:
        yield pd.Series([spelt(t) for t in folded(batch)], dtype=object)


@F.pandas_udf(T.StringType())
def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """texts' tokens joined by spaces."""
    for batch in batches:
        yield pd.Series([" ".join(tokens(t, True)) for t in folded(batch)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canon_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """lists of texts, each in the uniform spelling."""
    for batch in batches:
        yield pd.Series([None if some is None else [spelt(fold(t)) for t in some] for some in batch], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normal_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """lists of texts, the tokens of each joined by spaces."""
    for batch in batches:
        yield pd.Series([None if some is None else [" ".join(tokens(t)) for t in some] for some in batch], dtype=object)

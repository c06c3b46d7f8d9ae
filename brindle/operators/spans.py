"""Sequential span operators over texts: sentences, chunks, repair, masking. Arrow-batched, one text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which no sentence ends.
PROTECTED = {"e.g.", "i.e.", "et al.", "fig.", "figs.", "dr.", "vs.", "cf.", "approx.", "no.", "eq.", "ref.", "refs.", "ca."}
_END = re.compile(r"[.!?]+(?=\s+[A-Z(\"'\[])")
_INITIAL = re.compile(r"(?:^|\s)[A-Za-z]\.$")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences: a mark, white space and a capital or opening sign end one, protected words don't."""
    out, start = [], 0
    for m in _END.finditer(text):
        head = text[start : m.end()]
        last = head.rsplit(None, 1)[-1].lower() if head.split() else ""
        if last in PROTECTED or head.lower().endswith(" et al.") or _INITIAL.search(head):
            continue
        out.append((start, m.end()))
        start = m.end() + re.match(r"\s*", text[m.end() :]).end()
    if text[start:].strip():
        out.append((start, start + len(text[start:].rstrip())))
    return out


def chunks(text: str, most: int, overlap: int = 1) -> list[tuple[int, int]]:
    """(start, end) of chunks of whole sentences within ``most`` characters, each strictly ahead of the one before."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    spans = sentences(text)
    out, first, before = [], 0, -1
    while first < len(spans):
        last = first
        while last + 1 < len(spans) and spans[last + 1][1] - spans[first][0] <= most:
            last += 1
        out.append((spans[first][0], spans[last][1]))
        if last + 1 == len(spans):
            break
        before, first = first, max(first + 1, last + 1 - overlap)
    return out


def repair(text: str, surface: str, start: int) -> tuple[int | None, str]:
    """(start, outcome) of a claimed span: the occurrence nearest to the claim, the smaller among equals."""
    if not surface:
        return None, "empty_surface"
    if text[start : start + len(surface)] == surface and start >= 0:
        return start, "exact"
    at, best = text.find(surface), None
    while at >= 0:
        if best is None or (abs(at - start), at) < (abs(best - start), best):
            best = at
        at = text.find(surface, at + 1)
    return (best, "span_repaired") if best is not None else (None, "not_found")


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans blanked to their length; of overlapping ones the longest stays, then the first."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
        if all(b <= c or a >= d for c, d in taken):
            taken.append((a, b))
    out = list(text)
    for a, b in taken:
        out[a:b] = "[" + "_" * (b - a - 2) + "]" if b - a > 1 else "_"
    return "".join(out)


def chunked(docs: DataFrame, id_col: str, text_col: str, most: int, overlap: int = 1) -> DataFrame:
    """(id, chunk, start, end, text): chunks of every text; offsets are characters, and text is the raw slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(i, k, a, b, text[a:b]) for k, (a, b) in enumerate(chunks(text or "", most, overlap))]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "chunk", "start", "end", "text"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, chunk int, start int, end int, text string")


def repaired(claims: DataFrame) -> DataFrame:
    """(id, surface, claimed, start, outcome) for rows (id, text, surface, claimed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, surfaces, claimed = (c.to_pylist() for c in batch.columns)
            found = [repair(t or "", s or "", c if c is not None else 0) for t, s, c in zip(texts, surfaces, claimed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found])], names=["id", "surface", "claimed", "start", "outcome"])

    return claims.select("id", "text", "surface", "claimed").mapInArrow(run, "id long, surface string, claimed int, start int, outcome string")

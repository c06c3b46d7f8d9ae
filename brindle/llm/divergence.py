"""How far the sources of a language lie from each other and from the language as a whole, in exact whole numbers.

Three-dimensional cube partitioning: the sources of a language are dealt into blocks by hash, and so are its terms; a
cell of the cube is (block of sources, block of sources, block of terms) and belongs to one task. A slice, the counts of
one block of sources in one block of terms, is replicated to all cells that it is a side of; a cell puts out partial
divergences of its pairs of sources, and partials are added along the axis of terms. A divergence is symmetric, so only
cells whose first block is not beyond the second exist.

Terms are counted inside the tasks that read the documents, so that what is shuffled is a row for each task, source and
term, however often a term occurs. Terms that neither side of a cell holds add the same to a pair, each; they are added
at the end by their number, and no row is made of them.

What bounds it: a task that counts holds FLUSH terms; a cell holds about SOURCE_BLOCK sources a side and TERM_BLOCK
terms, both by hash. Only the largest number of terms of a language comes to the driver; counts of sources and the cells'
parts are written, so that no plan that the driver holds has another one within it. The result has a row for each
ordered pair of sources of a language, as is asked.

Defined cases: null texts, languages and sources are empty strings; each row is a document, repeated ids and rows
included; a source without terms takes part with zero counts; a language without a term in enough documents has
divergences of 0 and no terms; a language of one source has no pairs; ties go to the smaller item by its UTF-8 bytes;
texts are read whole, in slabs of SLAB bytes; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.storage import cut

#: Bytes of a text that are split into terms at a time.
SLAB = 1 << 20
#: Terms that a counting task holds before it puts them out.
FLUSH = 300_000
#: Sources and terms of a block, in the mean.
SOURCE_BLOCK = 32
TERM_BLOCK = 4096
#: Blocks of terms at least, so that a few languages still make many cells.
TERM_BLOCKS = 128
#: Bytes of a term, A-Z lower-cased; all others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTED = "lang string, source string, term binary, n long, docs long"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slab at a time."""
    clean, start = text.translate(_TERM), 0
    while start < len(clean):
        end = len(clean) if len(clean) - start <= SLAB else clean.rfind(b" ", start, start + SLAB)
        if end <= start:  # a term beyond a slab
            end = clean.find(b" ", start + SLAB)
            end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end + 1


def _batch(counted: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """A row for each source and term, and one without a term for each source."""
    for (lang, source), (n, docs) in counted.items():
        terms = [None, *n]
        columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary())]
        columns += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
        for lang, source, text in zip(langs, sources, texts, strict=True):
            n, docs = counted.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _words(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
        if held >= FLUSH:
            yield from _batch(counted)
            counted, held = {}, 0
    yield from _batch(counted)


#: 1 + floor(10**9 (count + 2) / (total + 2 terms)) in decimals, exact; null where a language has no terms.
_SHARE = "CASE WHEN terms > 0 THEN 1 + (CAST({n} + 2 AS DECIMAL(20,0)) * 1000000000) DIV CAST({total} + 2 * terms AS DECIMAL(20,0)) END"
#: A term's part of the divergence of two shares, each of them below 2**31.
_PART = "(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def kept_counts(docs: DataFrame, least_docs: int, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the terms that least_docs documents of their language hold, written.

    A row without a term and with n = 0 stands for each source; ``first`` marks one row of each language's term.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = plain.mapInArrow(_count, _COUNTED).withColumn("term", F.col("term").cast("string"))
    # Dealt by language and term, so that sums by source and by language are both made where the rows are.
    by_source = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = by_source.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "first": F.col("source") == F.min("source").over(term)})
    return cut(found.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).drop("docs", "lang_docs"), "terms")


def sizes_of(kept: DataFrame) -> DataFrame:
    """(lang, source, total, zero, lang_total, terms), written: a row for each source, zero being its share of a term it lacks."""
    sources = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("term").isNotNull() & F.col("first")).alias("terms"))
    return cut(sources.join(langs, "lang").withColumn("zero", F.expr(_SHARE.format(n="0", total="total"))), "sizes")


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of one cell: (low block, high block, block of terms) of a language."""
    lang, low, high, _ = key
    heads, body = rows[rows["term"].isna()], rows[rows["term"].notna()]
    names = [name for who in heads["who"] for name in who]
    side = np.repeat(heads["block"].to_numpy(), heads["who"].map(len))
    zeros = np.concatenate(list(heads["p"]))
    at = {name: k for k, name in enumerate(names)}
    codes, terms = pd.factorize(body["term"])
    share = np.repeat(zeros[:, None], len(terms), axis=1)
    if len(terms):
        share[[at[name] for who in body["who"] for name in who], np.repeat(codes, body["who"].map(len))] = np.concatenate(list(body["p"]))
    out = []
    for a in np.flatnonzero(side == low):
        others = np.arange(a + 1, len(names)) if low == high else np.flatnonzero(side == high)
        gap, both = share[a] - share[others], share[a] + share[others]
        part = (gap * gap // np.maximum(both, 1)).sum(axis=1)
        out += [(lang, names[a], names[b], int(v), len(terms), int(zeros[a]), int(zeros[b])) for b, v in zip(others, part, strict=True)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "part", "seen", "p", "q"])


def _listed(share: str) -> Column:
    """The sources of a block with their shares; 0 stands for the share of a language without terms."""
    return F.collect_list(F.struct("source", F.coalesce(share, F.lit(0)).alias("p"))).alias("entries")


def _apart(slices: DataFrame) -> DataFrame:
    return slices.withColumns({"who": F.col("entries.source"), "p": F.col("entries.p")}).drop("entries")


def pairs(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each ordered pair of sources of a language."""
    terms_most = sizes.agg(F.max("terms")).first()[0] or 0
    term_blocks = max(TERM_BLOCKS, -(-terms_most // TERM_BLOCK))
    dealt = sizes.groupBy("lang").agg(F.ceil(F.count("source") / SOURCE_BLOCK).alias("blocks"))
    sizes = sizes.join(dealt, "lang").withColumn("block", F.expr("pmod(xxhash64(source), blocks)"))
    shares = kept.where("term is not null").join(sizes, ["lang", "source"]).withColumn("p", F.expr(_SHARE.format(n="n", total="total")))
    slices = shares.groupBy("lang", "blocks", "block", "term").agg(_listed("p"))
    slices = _apart(slices).withColumn("at", F.expr(f"pmod(xxhash64(term), {term_blocks}L)"))
    heads = sizes.groupBy("lang", "blocks", "block").agg(_listed("zero"))
    heads = _apart(heads).withColumns({"term": F.lit(None).cast("string"), "at": F.explode(F.sequence(F.lit(0), F.lit(term_blocks - 1)).cast("array<bigint>"))})
    sides = slices.unionByName(heads).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    sides = sides.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    sides = sides.select("lang", "low", "high", "at", "block", "term", "who", "p")
    cells = cut(sides.groupBy("lang", "low", "high", "at").applyInPandas(_cell, "lang string, source string, item string, part long, seen long, p long, q long"), "cells")
    # Along the axis of terms; what no cell has seen of a pair has both shares at their least.
    added = cells.groupBy("lang", "source", "item").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"), F.max("p").alias("p"), F.max("q").alias("q"))
    langs = sizes.select("lang", "terms").distinct()
    rest = F.expr(f"CASE WHEN terms > 0 THEN part + (terms - seen) * ({_PART.format(p='p', q='q')}) ELSE 0L END")
    found = added.join(langs, "lang").withColumn("value", rest)
    return found.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair"), "value").select("lang", "pair.*", "value")


def marked_terms(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value): what each term that a source has more of than its language adds to their divergence."""
    shares = kept.where("term is not null and n > 0").join(sizes, ["lang", "source"])
    shares = shares.withColumns({"p": F.expr(_SHARE.format(n="n", total="total")), "q": F.expr(_SHARE.format(n="lang_n", total="lang_total"))})
    return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_PART.format(p="p", q="q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows, all of them, and the ``top`` first ``term`` rows of a source."""
    kept = kept_counts(docs, least_docs, lang_col, source_col, text_col)
    sizes = sizes_of(kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumns({"part": F.lit(part), "rank": F.row_number().over(order)})
    found = ranked(pairs(kept, sizes), "pair").unionByName(ranked(marked_terms(kept, sizes), "term").where(F.col("rank") <= top))
    return found.select("lang", "source", "part", "item", "value", "rank")

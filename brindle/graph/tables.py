"""Property tables of a triple graph: one row a subject, a column a predicate; a child table for what has many values.

Questions over entities, resources and reviews (the other modules of this package) take a mapping of such tables, as
:func:`shred` makes them of triples. A subject without a value has null there, which is an unbound variable; optional
patterns are left joins, MINUS and NOT EXISTS are anti joins, alternatives of a path are unions, repeats are kept where
the question keeps them. Results have no order: sort them where they are printed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tables(Mapping[str, DataFrame]):
    """Property tables by name, each made when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[Tables], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def shred(triples: DataFrame, columns: Mapping[str, str], subject: str = "s") -> DataFrame:
    """One row for each subject of (s, p, o) that has any of the predicates, with the smallest object of each.

    columns: column name -> predicate. One aggregation by subject, whatever the number of predicates.
    """
    chosen = triples.where(F.col("p").isin(*columns.values()))
    return chosen.groupBy(F.col("s").alias(subject)).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in columns.items()])


def child(triples: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    """(subject, value) rows of a predicate with many values."""
    return triples.where(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(value)).distinct()


def as_(df: DataFrame, **names: str) -> DataFrame:
    """``df``'s columns under other names: ``as_(df, key="cause_key", e="cause")`` keeps these two only."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def listed(value: Column, separator: str) -> Column:
    """Distinct values of a group in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def squeezed(value: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(value, r"\s+", " ")

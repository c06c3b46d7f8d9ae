"""Mixing documents to target weights of soft domains.

A classifier, multinomial naive Bayes over hashed words, learns the domains of labelled documents and predicts for every
document a posterior over domains. Document rates then solve a least-squares problem: with n_d words and posterior p_d,
the rates r_d >= 0 should make the expected words of every domain, sum of r_d n_d p_dk, meet its target. It is solved by
distributed projected gradient: a step moves every rate against the gradient of the squared error, in the metric that
weighs a document by its words and scales errors by the domains' Gram matrix, and projects it on [least, most]. Moves
add up before they are projected, so a rate is one less the inner product of p_d with one number a domain, projected,
and no rates are stored; of the rates that meet the targets the steps come to those nearest to one. Steps have momentum,
which starts anew where it leads uphill, and end where errors settle. A step is one aggregation that brings k + 1 numbers
to the driver: first of the words of documents by rounded posterior, then, from there, of all documents' posteriors as
they are. What can't be met ends by itself, and by how much the worst domain misses is part of the result.

The budget is, unless given, the smallest number of words at which no domain has to be thinned, so that targets are met
by repeating what there is too little of. With soft posteriors no rates of one or more meet it: repeating any document
adds to every domain. So where there is a least rate and no budget, shares of the words are met, whatever their sum.
Rates become whole numbers of copies by rounding at random, by a hash of the id, so that the expected number is the rate.

Defined cases: null and empty texts have no words and the prior as posterior, and stay with one copy; labels that are
null don't count; domains without labelled documents have the posterior 0 and their target weight is shared by the
others; repeated rows each have a rate, the same one, as have texts whose posteriors tie; long texts are read whole; an
empty table gives an empty result; other columns are ignored by the model, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.storage import cut
from brindle.llm.words import raw_texts, slabs

BITS = 16
#: Steps of the solver at most, on rounded and on full posteriors.
MOST_STEPS, MOST_FULL_STEPS = 300, 30
#: Steps without progress after which targets count as out of reach.
PATIENCE = 40
#: Share of all words by which a domain may miss its target.
TOLERANCE = 1e-4
#: Share of all words within which the solver's errors count as none.
SETTLED, SETTLED_FULL = 3e-5, 5e-5
#: Where shares are met by repeating alone, no document is repeated more often: no budget bounds the rates there.
MOST_RATE = 100.0
#: First steps look at documents by posteriors rounded to multiples of this.
GRID = 1 / 512
#: Rows of the rounded table that a task adds up.
TASK_ROWS = 1 << 16
#: What a document's words share between them, in whole numbers.
UNIT = 1 << 40
#: Numbers of words that a text's averaged evidence may count as.
EVIDENCE = (0.5, 1, 2, 4, 8, 16, 32, 64)


class Model(NamedTuple):
    likely: np.ndarray  # log likelihood of each hashed word in each domain
    prior: np.ndarray  # log share of each domain
    evidence: float


def _features(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the batch, hashed words of the lower-cased text) for every text."""
    for slab in slabs([t.lower() if t else t for t in texts]):
        rows = (slab.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        starts = np.r_[0, slab.ends[:-1]]
        for doc, a, b in zip(slab.docs, starts.tolist(), slab.ends.tolist()):
            yield doc, rows[a:b]


def _counted(sample: DataFrame, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods, log priors) of (id, text, label).

    Executors add up the words; domains * 2^BITS sums at most come to the driver, however many tasks there were. Sums
    are of whole numbers, so that they don't depend on the order of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            for place, rows in _features(raw_texts(batch.column(1))):
                # A document counts once, whatever its length; the word -1 counts documents.
                words, n = np.unique(rows, return_counts=True)
                words = np.r_[-1, words]
                share = np.r_[UNIT, np.round(UNIT * (n / max(1, len(rows))))].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), labels[place])), pa.array(words), pa.array(share)], names=["k", "word", "share"])

    made = sample.select("id", "text", "label").mapInArrow(run, "k long, word long, share long")
    got = made.groupBy("k", "word").agg(F.sum("share").alias("share")).toArrow()
    k, word, share = (got[c].to_numpy() for c in ("k", "word", "share"))
    counts, docs = np.zeros((domains, 1 << BITS)), np.zeros(domains)
    docs[k[word < 0]] = share[word < 0] / UNIT
    counts[k[word >= 0], word[word >= 0]] = share[word >= 0] / UNIT
    prior = np.where(docs > 0, np.log(np.maximum(docs, 1) / max(1, docs.sum())), -np.inf)
    if not docs.any():
        prior = np.full(domains, -np.log(domains))
    smooth = counts * 400 + 0.05
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32), prior


def fit(sample: DataFrame, shares: list[float]) -> Model:
    """Model of a bounded sample of (id, text, label) from labels whose domains have the given shares.

    How much evidence counts is chosen on one half of the sample by the likelihood of a model of the other half.
    """
    domains = len(shares)
    half = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)) == 0
    likely, prior = _counted(sample.where(half), domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(EVIDENCE))
        for batch in batches:
            labels = batch.column(2).to_pylist()
            for place, rows in _features(raw_texts(batch.column(1))):
                for k, evidence in enumerate(EVIDENCE):
                    total[k] += max(-50.0, np.log(max(_posterior(likely, prior, evidence, rows)[labels[place]], 1e-30)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(range(len(EVIDENCE)), pa.int64())], names=["fit", "k"])

    fits = np.zeros(len(EVIDENCE))
    for row in sample.where(~half).select("id", "text", "label").mapInArrow(run, "fit double, k long").groupBy("k").agg(F.sum("fit").alias("fit")).collect():
        fits[row["k"]] = row["fit"]
    likely, prior = _counted(sample, domains)
    with np.errstate(divide="ignore"):
        known = np.where(np.isfinite(prior), np.log(np.array(shares) / sum(shares)), -np.inf)
    return Model(likely, known, float(EVIDENCE[int(fits.argmax())]))


def _posterior(likely: np.ndarray, prior: np.ndarray, evidence: float, rows: np.ndarray) -> np.ndarray:
    logs = prior + (likely[:, rows].mean(axis=1, dtype=np.float64) * min(evidence, len(rows)) if len(rows) else 0)
    p = np.exp(logs - logs.max())
    return p / p.sum()


def posteriors(rows: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``rows`` without the text, with the columns ``_n``, words of the text, and ``_p``, its posterior.

    The model, of fixed size, is broadcast.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place_of_text = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            out = np.zeros((batch.num_rows, len(own.prior)))
            for place, words in _features(raw_texts(batch.column(place_of_text))):
                sizes[place] = len(words)
                out[place] = _posterior(own.likely, own.prior, own.evidence, words)
            others = [c for k, c in enumerate(batch.columns) if k != place_of_text]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sizes), pa.array(list(out), pa.list_(pa.float64()))], names=schema.names)

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != text_col], T.StructField("_n", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


class Solution(NamedTuple):
    slopes: list[float]  # by domain: the rate is one less the posterior's product with them, projected
    shift: float  # added to every rate before it is projected
    least: float
    reached: list[float]  # expected words by domain
    goal: list[float]
    missed: float  # share of all words by which the worst domain misses its goal
    steps: int


def solve(members: DataFrame, targets: list[float], budget: float | None = None, least: float = 0.0, start: list[float] | None = None, settled: float = SETTLED, most_steps: int = MOST_STEPS) -> Solution:
    """Rates for a table of (q, w0, w1, ...): a posterior, and words in each domain expected of its documents.

    members stays distributed; the first aggregation brings k * k + k numbers to the driver and each step k. Targets that
    the solution does not meet within TOLERANCE of all words are also reported by a warning.
    """
    k = len(targets)
    own, q = [F.col(f"w{i}") for i in range(k)], [F.col("q")[i] for i in range(k)]
    first = members.agg(*[F.sum(own[i]).alias(f"t{i}") for i in range(k)], *[F.sum(own[i] * q[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    have = np.array([first[f"t{i}"] or 0.0 for i in range(k)])
    weight = np.where(have > 0, targets, 0.0)
    weight = weight / weight.sum() if weight.sum() else weight
    # Where nothing may be thinned and the budget is free, shares alone are sought: errors are those of reached - weight * all.
    free = budget is None and least > 0
    if budget is None:
        budget = float(max((h / w for h, w in zip(have, weight) if w > 0), default=0.0))
    goal, share = (np.zeros(k), weight) if free else (weight * budget, np.zeros(k))
    gram = np.array([[first[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    gram = gram - np.outer(share, have) - np.outer(have, share) + have.sum() * np.outer(share, share)
    scale = np.linalg.pinv((gram + gram.T) / 2, rcond=1e-9, hermitian=True)

    def reach(slopes: np.ndarray) -> np.ndarray:
        """Expected words by domain."""
        rate = _rate(slopes.tolist(), least, "q", float(share @ slopes))
        row = members.agg(*[F.sum(own[i] * rate).alias(f"r{i}") for i in range(k)]).first()
        return np.array([row[f"r{i}"] or 0.0 for i in range(k)])

    before = ahead = np.array(start, float) if start else np.zeros(k)
    best, pace, since, steps = (np.inf, ahead, have), 1.0, 0, 0
    while steps < most_steps and have.any():
        steps += 1
        reached = reach(ahead)
        error = reached - share * reached.sum() - goal
        off = np.abs(error).max() / max(budget if not free else 0.0, reached.sum())
        since = 0 if off < 0.999 * best[0] else since + 1
        best = min(best, (off, ahead, reached), key=lambda x: x[0])
        if off <= settled or since >= PATIENCE:
            break
        now = ahead + scale @ error
        if error @ (now - before) < 0:  # momentum leads uphill
            pace = 1.0
        then = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = now + (pace - 1) / then * (now - before)
        before, pace = now, then
    _, slopes, reached = best
    goal = weight * reached.sum() if free else goal
    missed = float(np.abs(reached - goal).max() / max(1.0, goal.sum()))
    if missed > TOLERANCE:
        warnings.warn(f"mixing: targets missed by up to {missed:.4f} of all words: reached {reached.tolist()}, goal {goal.tolist()}", stacklevel=2)
    return Solution(slopes.tolist(), float(share @ slopes), least, reached.tolist(), goal.tolist(), missed, steps)


def _rate(slopes: list[float], least: float, posterior: str, shift: float = 0.0) -> Column:
    """The rate of a posterior: one and shift, less its product with the slopes, no less than least; with a least rate, no more than MOST_RATE."""
    moved = F.lit(max(1.0, least) + shift)
    for i, slope in enumerate(slopes):
        moved = moved - F.col(posterior)[i] * F.lit(float(slope))
    projected = F.greatest(moved, F.lit(float(least)))
    return F.least(projected, F.lit(max(MOST_RATE, float(least)))) if least > 0 else projected


def _rounded() -> Column:
    return F.transform("_p", lambda x: F.round(x / GRID) * GRID)


def _solved(found: DataFrame, targets: list[float], budget: float | None, least: float) -> Solution:
    """Rates of a written table of (_n, _p): steps on rounded posteriors first, then on the full ones."""
    words = [(F.col("_n") * F.col("_p")[i]).alias(f"w{i}") for i in range(len(targets))]
    full = found.where("_n > 0").select(F.col("_p").alias("q"), *words)
    grouped = found.where("_n > 0").select(_rounded().alias("q"), *words).groupBy("q").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(targets))])
    rounded = cut(grouped, "members")
    rounded = rounded.coalesce(max(1, -(-rounded.count() // TASK_ROWS)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the full posteriors tell
        near = solve(rounded, targets, budget, least)
    return solve(full, targets, budget, least, near.slopes, SETTLED_FULL, MOST_FULL_STEPS)


def _decided(found: DataFrame, solution: Solution, key: Column) -> DataFrame:
    """``found`` with ``mix_rate`` and ``mix_copies``; a text without words has the rate one."""
    rate = F.when(F.col("_n") > 0, _rate(solution.slopes, solution.least, "_p", solution.shift)).otherwise(1.0)
    chance = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    return found.withColumn("mix_rate", rate).withColumn("mix_copies", F.floor(F.col("mix_rate") + chance).cast("int"))


def _key(id_col: str, text_col: str) -> Column:
    """What a row's rounding goes by."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")), F.lit("copies"))


def rates(docs: DataFrame, model: Model, targets: list[float], budget: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, posterior, mix_rate, mix_copies, mix_missed), one row per row of docs; copies rounds the rate at random.

    mix_missed, the same for all rows, is the share of all words by which the worst domain misses its target.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    found = cut(posteriors(narrow.select("id", _key("id", "text").alias("key"), "text"), model, "text"), "posteriors")
    solution = _solved(found, targets, budget, least)
    out = _decided(found, solution, F.col("key"))
    return out.select("id", F.col("_n").alias("n_words"), F.col("_p").alias("posterior"), "mix_rate", "mix_copies", F.lit(solution.missed).alias("mix_missed"))


def mixed(docs: DataFrame, model: Model, targets: list[float], budget: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the mix takes, with ``mix_rate`` and ``mix_copies``, how often each is to be repeated.

    These two take the place of columns of docs with such names, all others stay. Texts are read and scored twice, once for the posteriors, which are kept, and once for the rows themselves, rather than shuffled.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    solution = _solved(cut(posteriors(docs.select(text), model, "text"), "posteriors"), targets, budget, least)
    others = [c for c in docs.columns if c not in ("mix_rate", "mix_copies")]
    packed = docs.select(_packed(others), _key(id_col, text_col).alias("key"), text)
    out = _decided(posteriors(packed, model, "text"), solution, F.col("key"))
    return out.where("mix_copies > 0").select("row.*", "mix_rate", "mix_copies")


def _packed(columns: list[str]) -> Column:
    """Columns as one struct, out of the way of names that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def repeated(rows: DataFrame) -> DataFrame:
    """Each row of a mix ``mix_copies`` times, in place."""
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return rows.where("mix_copies > 0").select(_packed(rows.columns), copies.alias("copy")).select("row.*")

"""Near-duplicate groups against the similarity of all pairs."""

import random

import numpy as np
from test_llm_operators import WORDS, table

import corpus_pipeline
from brindle.llm import alike


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(i for i, _ in rows if find(i) == i)


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = rng.choice(WORDS) + "x"
    return " ".join(w)


def test_groups_of_similar_texts(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) for _ in range(200)) for _ in range(40)]
    texts = base + [edited(rng, base[k % 40], 1 + k % 6) for k in range(160)]
    texts += [edited(rng, base[0], 3) for _ in range(60)] + [None, "", " ", "one two", "One  two", "one three", base[1]]
    rows = list(enumerate(texts))
    assert len(brute_kept(rows)) > 45
    docs = table(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    assert alike.near_duplicates(table(spark, [])).count() == 0
    assert sorted(r.doc_id or 0 for r in alike.clean(table(spark, [(None, "a"), (None, "a"), (3, "b"), (3, "b")])).collect()) == [0, 0, 3]


def test_simhash_proposes_pairs(spark, monkeypatch):
    """Without cells, texts within a few bits are still found, and only those that are similar enough are linked."""
    monkeypatch.setattr(alike, "_cells", lambda own: np.zeros(0, np.uint64))
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) + str(k) for k in range(2000)) for _ in range(3)]
    rows = list(enumerate([*base, *[edited(rng, t, 1) for t in base], "one two", "one two", "one three"]))
    assert brute_kept(rows) == [0, 1, 2, 6, 8]
    found = {r.id: r.component for r in alike.near_duplicates(table(spark, rows)).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2, 6: 6, 7: 6, 8: 8}


def test_whole_rows_stay_in_the_engine(spark):
    """Only rows that share an id are told apart in Python; others are kept by their id."""
    kept = alike.clean(table(spark, [(1, "a b c"), (2, "a b c"), (3, "d e f")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()

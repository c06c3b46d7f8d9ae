"""The pipeline against a brute-force composition of its stages, and the registered queries' shape."""

import random

import pytest
from test_llm_operators import PROSE, WORDS, brute_print

import corpus_pipeline
from brindle.llm import decontaminate, queries, toxicity

random.seed(9)


def prose(n=70):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    passage, item = prose(55), prose(30)
    rows, labels = [], []
    for k in range(160):
        toxic, good = k % 5 == 0, k % 3 > 0
        words = prose().split() + (["nastyword"] * 4 if toxic else [])
        random.shuffle(words)
        rows.append((k, " ".join(words) if good else " ".join(w + "%%%" for w in words), "en", "s", 0))
        labels.append((k, int(good), int(toxic)))
    rows += [(200, PROSE[0], "en", "s", 1), (201, PROSE[0], "en", "s", 1), (202, PROSE[0].replace(" ", "\n", 3), "en", "s", 1)]
    rows += [(210 + k, f"{prose()} {passage} {prose()}", "en", "s", 1) for k in range(4)]
    rows += [(220, f"{prose()} {item} {prose()}", "en", "s", 1), (221, f"{prose()} {item.title()}", "en", "s", 1), (230, None, "en", None, None), (231, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(25))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, item


def test_stages(spark, folder):
    where, rows, item = folder
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    table, bias = queries.toxicity_model(docs, labels)
    left = [(i, t) for i, t, *_ in rows if toxicity.score((t or "").encode(), table, bias) < corpus_pipeline.TOXIC]
    assert len(rows) - len(left) > 20
    # Near duplicates, all pairs.
    root = {i: i for i, _ in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = [(i, brute_print(t)) for i, t in left]
    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    left = [(i, t) for i, t in left if find(i) == i]
    # Repeated windows.
    own = {}
    for i, t in left:
        w = (t or "").split()
        for k in range(len(w) - 12):
            own[tuple(w[k : k + 13])] = min(i, own.get(tuple(w[k : k + 13]), i))
    cleaned = []
    for i, t in left:
        w, cover = (t or "").split(), set()
        for k in range(len(w) - 12):
            if own[tuple(w[k : k + 13])] < i:
                cover.update(range(k, k + 13))
        cleaned.append((i, " ".join(x for k, x in enumerate(w) if k not in cover) if cover else t))
    assert sum(a != b for a, b in zip(left, cleaned)) == 3
    # Leaks: every window of the item's length.
    words = item.lower().encode().split()

    def leaks(text):
        w = (text or "").lower().encode().split()
        return any(decontaminate.similarity(w[k : k + len(words)], words) >= 0.8 for k in range(max(1, len(w) - len(words) + 1)) if w)

    wanted = {i: t for i, t in cleaned if not leaks(t)}
    assert len(cleaned) - len(wanted) == 2
    got = corpus_pipeline.run(spark, where)
    assert got.columns == [*docs.columns, "mix_rate", "mix_copies"]
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in found.items()} == wanted
    assert all(r.mix_rate >= 1 and r.mix_copies >= 1 for r in found.values())
    changed = [r for i, r in found.items() if dict(left)[i] != r.text]
    assert all(r.n_chars == len(r.text) for r in changed)


def test_columns_of_queries(spark, folder):
    where = folder[0]
    assert queries.op1_toxicity(spark, where).dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert queries.op7_quality(spark, where).columns == ["doc_id", "held_out", "score", "predicted"]
    assert queries.op8_licenses(spark, where).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}

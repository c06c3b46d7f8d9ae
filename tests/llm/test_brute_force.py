"""Operators against independent, plain versions of the same method."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_llm_operators import LONG, PROSE, ROWS, WORDS, table

import corpus_pipeline
from brindle.llm import alike, decontaminate, labelled, licenses, mixing, neighbours, quality, queries, simhash, tokens, toxicity

MASK = (1 << 64) - 1


def scrambled(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ (x >> 33)


def plain_rows(text):
    """Table rows of a text by the definition: words, and 3 to 5 bytes of each word between its borders."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    out = []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", lower):
        total = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & MASK
        out.append(scrambled(total) >> 46)
    flat = b" " + bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in lower) + b" "
    for n in toxicity.GRAMS:
        for k in range(len(flat) - n + 1):
            gram = flat[k : k + n]
            if 32 not in gram[1:-1]:
                packed = int.from_bytes(gram, "big")
                out.append((((packed * 0x9E3779B97F4A7C15 & MASK) ^ n) * 0xD6E8FEB86659FD93 & MASK) >> 46)
    return out


@pytest.mark.parametrize("text", [b"", b"  ", b"Nasty wOrd", "é日本 b".encode(), PROSE[0].encode(), b"a\tb\n\ncd"])
def test_toxicity_rows_and_score(text):
    rows = Counter(r for part in toxicity.rows_of(text) for r in part.tolist()) if text.strip() else Counter()
    assert rows == (Counter(plain_rows(text)) if text.strip() else Counter())
    model = np.random.default_rng(1).standard_normal(1 << toxicity.BITS).astype(np.float32)
    own = plain_rows(text) if text.strip() else []
    logit = 0.3 + (sum(float(model[r]) for r in own) / len(own) if own else 0.0)
    assert abs(toxicity.score(text, model, 0.3) - 1 / (1 + np.exp(-logit))) < 1e-6


def test_toxicity_training_lowers_the_softmax_loss(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) + (" vile" if k % 2 else "") for k in range(80)]
    bags = [toxicity.bag(t.encode()) for t in texts]
    model, bias = toxicity.train(bags, np.arange(80) % 2)
    loss = -np.mean([np.log(p if k % 2 else 1 - p) for k, t in enumerate(texts) for p in [toxicity.score(t.encode(), model, bias)]])
    assert loss < np.log(2) * 0.9
    # The same sample in another number of partitions gives the same model.
    df = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "id long, text string, label int")
    a, b = toxicity.fit(df.repartition(5), (0.5, 0.5)), toxicity.fit(df.coalesce(1), (0.5, 0.5))
    assert a[1] == b[1] and (a[0] == b[0]).all()


def test_quality_by_hand(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(WORDS) + ("%%" if k % 2 else "") for _ in range(200))) for k in range(160)] + [(900, None), (901, ""), (902, LONG[:30_000])]
    docs = table(spark, rows)
    known = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)], "doc_id long, label int")
    model = quality.fit(labelled.sample(docs, known, 100), labelled.shares(known))
    sizes = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.id: r.score for r in quality.scores(docs, model).collect()}
    for k, text in rows:
        raw = (text or "").encode()
        blocks = [raw[at : at + 1024] for at in range(0, len(raw), 1024)]
        x = sum(len(sizes[1].compress(b)) - len(sizes[0].compress(b)) for b in blocks) / len(raw) * 10 if raw else 0.0
        x = min(max(x, -4.0), 4.0)
        logit = max(x, 0.0) * model.curve[0] + min(x, 0.0) * model.curve[1] + model.curve[2]
        assert abs(got[k] - 1 / (1 + np.exp(-logit))) < 1e-9
    long = b"q" * 20_000
    assert b"".join(quality.blocks_of(long)) == long


def test_samples_are_bounded_in_bytes(spark):
    docs = table(spark, [(k, "x" * (10 if k < 20 else 5000)) for k in range(40)])
    known = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    got = labelled.sample(docs, known, 100, class_bytes=100).collect()
    held = Counter(r.label for r in got)
    assert all(len(r.text) == 10 for r in got) and held == {0: 9, 1: 9}


def test_mixing_against_projected_gradient(spark):
    rng = np.random.default_rng(7)
    q = rng.dirichlet([0.6, 0.9, 0.5], 400)
    q = np.round(q * 512) / 512
    words = rng.integers(20, 300, 400).astype(float)
    have = (words[:, None] * q).sum(axis=0)
    targets, budget = np.array([0.2, 0.3, 0.5]), float(1.2 * have.sum())
    rows = [(q[i].tolist(), *(words[i] * q[i]).tolist()) for i in range(400)]
    found = mixing.solve(spark.createDataFrame(rows, "q array<double>, w0 double, w1 double, w2 double"), targets.tolist(), budget=budget)
    # Nonnegative rates by projected gradient on the weighted squared error.
    a = (words[:, None] * q) / np.sqrt(have)
    goal, rate = targets * budget / np.sqrt(have), np.ones(400)
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(4000):
        rate = np.maximum(0, rate - step * (a @ (a.T @ rate - goal)))
    assert np.abs(a.T @ rate - goal).max() / np.abs(goal).max() < 1e-3
    assert np.abs(np.array(found.reached) - targets * budget).max() / budget < 1e-3
    own = np.maximum(found.least, 1 + found.shift - q @ np.array(found.slopes))
    assert own.min() >= 0 and np.allclose(own @ (words[:, None] * q), found.reached)
    # Of rates that meet the targets those nearest to one are taken.
    assert (words * (own - 1) ** 2).sum() <= (words * (rate - 1) ** 2).sum() * 1.001


def plain_similarity(a, b):
    x, y = (Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_decontamination_recall(spark):
    rng = random.Random(11)
    items = [[rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(30, 90))] for _ in range(25)]
    rows = []
    for k in range(240):
        own = list(items[k % 25])
        for _ in range(k % 4):
            at = rng.randrange(len(own) - 1)
            match rng.randrange(3):
                case 0:
                    own[at] = "other"
                case 1:
                    del own[at]
                case _:
                    own[at], own[at + 1] = own[at + 1], own[at]
        around = [[rng.choice(WORDS) for _ in range(rng.randrange(40))] for _ in range(2)]
        rows.append((k, around[0] + own + around[1]))
    wanted = set()
    for k, words in rows:
        for i, item in enumerate(items):
            n = len(item)
            if any(plain_similarity(words[at : at + n], item) >= 0.8 for at in range(max(1, len(words) - n + 1))):
                wanted.add((k, i))
    docs = table(spark, [(k, " ".join(w)) for k, w in rows])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert all(plain_similarity(rows[r.id][1][r.start : r.start + r.n_words], items[r.item]) >= 0.8 for r in got)
    found = {(r.id, r.item) for r in got}
    assert found <= wanted and len(found) >= 0.9 * len(wanted) and len(wanted) > 80


def plain_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    form = f" {' '.join(words)} "
    found = [(form[: m.start()].count(" ") - 1, form[: m.end()].count(" "), r.priority, i, r.label) for i, r in enumerate(licenses.rules()) for m in re.finditer(r.expression, form)]
    beats = lambda o, d: (o[2], o[1] - o[0], -o[3]) > (d[2], d[1] - d[0], -d[3])
    kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and beats(o, d) for o in found)]
    return len(words), base, {d[4] for d in kept}, sorted((d[0], d[1], d[4]) for d in kept)


def test_licenses_against_every_rule(spark):
    rng = random.Random(9)
    phrases = ["under the MIT License", "Apache License, Version 2.0", "CC-BY-NC-SA 4.0", "cc by nc", "GNU General Public License v3", "licensed under the LGPL", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.", "Copyright (c) 2019", "the terms of the PSF License", "Eclipse Public License 2.0", "public domain", "gpl", "word", "É", "under", "license"]
    texts = [" ".join(rng.choice(phrases + WORDS[:5]) for _ in range(rng.randrange(1, 25))) for _ in range(150)] + [None, "", "gpl license " * 700]
    got = {r.id: r for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        n, base, labels, spans = plain_labels(text)
        r = got[k]
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b[1] for b in base}))
        assert set(filter(None, r.labels.split(","))) == labels | {b[1] for b in base}, text
        assert sorted((d.s, d.e, d.label) for d in r.detections) == spans
    assert len(licenses.rules()) > 200 and all(r.keyword for r in licenses.rules())


def test_groups_of_a_repeated_id_stay(spark):
    rows = [(1, PROSE[0]), (1, PROSE[1]), (2, PROSE[2]), (2, PROSE[2]), (3, PROSE[0])]
    for clean in (simhash.clean, alike.clean):
        kept = clean(table(spark, rows)).select("doc_id", "text").collect()
        assert sorted(map(tuple, kept)) == sorted({(1, PROSE[0]), (1, PROSE[1]), (2, PROSE[2])})


def test_repeated_queries_are_one(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows + [rows[50]], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("id") % 50 == 0).collect()
    for q in (0, 50):
        own = sorted((r["rank"], r.id) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and len({r[1] for r in own}) == 5


def test_tokens_without_spaces_and_forgetting(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = tokens.Transducer(path)
    rng = random.Random(6)
    texts = ["".join(rng.choice(a) for _ in range(6000)) for a in ("ab", "abcdefghijklmnop", "é日本aのthe", "ab ", "▁ a")]
    monkeypatch.setattr(tokens, "SEGMENT", 700)
    monkeypatch.setattr(tokens, "MOST_STATES", 1500)
    for _ in range(2):
        assert machine.counts([t.encode() for t in texts]) == [len(library.encode(t)) for t in texts]
    assert len(machine.list) < 1500 + 2 * 700 + 2


def test_rows_without_an_id_are_not_held_out(spark):
    found = spark.createDataFrame([(None, 0.5), (3, 0.1)], "id long, score double")
    assert {r.doc_id: r.held_out for r in queries._decided(found, labelled.remainder("doc_id", 4) == 2).collect()}[None] is False


CLASH = ["_id", "_row", "_kind", "_start", "_size", "_n", "_p", "_q", "_copy", "row", "fp", "key", "print", "copy", "0"]


def tables(spark, where, rows, labels, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)}).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")


def test_pipeline_of_odd_tables(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    tables(spark, f"{tmp_path}/a", rows + rows[:3], [(k, k % 2, 0) for k in range(4)], [])
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASH, "mix_rate", "mix_copies"]
    held = Counter((r.doc_id, r.text) for r in got.collect())
    assert {i for i, _ in held} == {None, 1, 3, 4, 7, 8, 11} and all(r["_n"] == CLASH.index("_n") for r in got.collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    tables(spark, f"{tmp_path}/b", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0

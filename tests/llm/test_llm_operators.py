"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, extra columns, and no rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import decontaminate, labelled, licenses, mixing, neighbours, passages, quality, simhash, tokens, toxicity, warc
from brindle.llm.components import roots

random.seed(5)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7))) for _ in range(400)]
PROSE = [" ".join(random.choice(WORDS) for _ in range(60)) for _ in range(12)]
LONG = " ".join(random.choice(WORDS) for _ in range(60_000))
#: id, text, and columns whose names operators use inside.
ROWS = [(1, PROSE[0]), (2, PROSE[0]), (2, PROSE[0]), (3, PROSE[1] + "\n" + PROSE[0]), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, PROSE[2].upper()), (9, PROSE[2]), (None, PROSE[3]), (11, "é日本 " + PROSE[4])]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit(k) for k, c in enumerate(["id", "row", "fp", "score", "label", "n", "start", "kind", "component", "rate", "p", "q"])}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not w:
        return 0
    s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    prints = {(i, t): brute_print(t) for i, t in ROWS}
    assert sorted((r.id or 0, r.fp % 2**64) for r in got) == sorted((i or 0, prints[i, t]) for i, t in ROWS)
    group = {r.id: r.component for r in got}
    assert group[1] == group[2] == 1 and group[4] == group[5] == group[6] == 4 and group[8] == group[9] == 8
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = simhash.clean(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 11]


def test_simhash_links_of_large_cells(spark, monkeypatch):
    random.seed(1)
    centre = random.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:  # a family round one fingerprint, and strangers
        prints.add(random.choice(sorted(prints)) ^ (1 << random.randrange(64)) if len(prints) < 200 else random.getrandbits(64))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    got = {r.vertex % 2**64: r.root % 2**64 for r in roots(simhash.links(df)).collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    ours, theirs = {}, {}
    for p in prints:
        ours.setdefault(got.get(p, p), set()).add(p)
        theirs.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {tuple(r) for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 140)} | {(200, 200), (201, 200)}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cleaned(rows):
    own = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k : k + 13])
            own[key] = min(i, own.get(key, i))
    out = []
    for i, w in split:
        cover = set()
        for k in range(len(w) - 12) if i is not None else ():
            if own[tuple(w[k : k + 13])] < i:
                cover.update(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in cover]
        out.append((i or 0, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    shared = " ".join(WORDS[:30])
    rows = ROWS + [(20 + k, f"{PROSE[5]} {k} {shared}  {PROSE[6 + k % 3]}") for k in range(9)] + [(40, "w " * 50), (41, "w\t" * 20 + shared)]
    df = table(spark, rows)
    got = sorted((r.id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in passages.cleaned(df).collect())
    assert got == brute_cleaned(rows)
    kept = passages.clean(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in kept.collect()) == [(x[0], x[3]) for x in got]
    assert passages.cleaned(table(spark, [])).count() == 0


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, PROSE[0]), (2, PROSE[2].title()), (3, None), (4, ""), (5, " ".join(random.choice(WORDS) for _ in range(40))), (6, PROSE[3]), (7, PROSE[1].replace(PROSE[1].split()[0], "changed", 1))], "item_id long, text string")
    got = sorted((r.id or 0, r.item) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(0, 6), (1, 1), (2, 1), (2, 1), (3, 1), (3, 7), (8, 2), (9, 2)]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7, 11]
    assert decontaminate.leaks(table(spark, []), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/\r\nb", big), (2, None, big), (3, "u", "small"), (4, "v", "small"), (5, "w", None), (5, "w", None), (6, "x", big), (7, "y", "z" * 3_000_000)], "page_id long, url string, html string")
    got = warc.round_trip(pages.withColumn("digest", F.lit(1)).withColumn("head", F.lit(2))).collect()
    assert sorted((r.id, r.record_type, r.refers_to) for r in got) == sorted([(1, "revisit", 6), (2, "revisit", 6), (3, "response", None), (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)])
    assert all(r.payload_bytes == len(big.encode()) and r.payload_digest == hashlib.sha1(big.encode()).hexdigest() for r in got if r.id in (1, 2, 6))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.record("response", 1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(good)[1] == b"payload"
    for bad in (good.replace(b"payload\r\n", b"paylord\r\n"), good[:-2], b"HTTP" + good):
        with pytest.raises(warc.Broken):
            warc.parse(bad)
    import io

    with pytest.raises(warc.Broken):
        list(warc.members(io.BytesIO(warc.member(good)[:-6])))


def test_token_counts(spark, docs, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in tokens.counts(docs, path).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS)
    parts = ["a", "the ", " ", "  ", " " * 17, "\n", "\t", "▁", "é", "日本", "😀", "<s>", "<unk>", "\x00", "ing", "12", "==", "x" * 300]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(400)]
    monkeypatch.setattr(tokens, "SLAB", 500)
    assert tokens.transducer(path).counts([t.encode() for t in texts]) == [len(library.encode(t)) for t in texts]
    assert tokens.counts(table(spark, []), path).count() == 0


def test_license_scan(spark):
    texts = {1: "Under the MIT License, under the MIT license under the mit license.", 2: "CC-BY-NC 4.0 and cc by nc", 3: None, 4: "", 5: "é Licensed under the Apache License, Version 2.0 (the License)", 6: "mit mir", 7: "SPDX-License-Identifier: GPL-3.0-or-later", 8: "All rights reserved " * 300}
    rows = list(texts.items()) + [(1, texts[1])]
    got = licenses.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (12, 3, 0, 8, "mit")
    assert (by[2].n_base, by[2].first_word, by[2].last_word) == (2, 0, 6)
    assert (by[5].base_labels, by[5].labels, by[5].first_word) == ("apache-2", "apache-2", 4)
    for k in (3, 4):
        assert (by[k].n_words, by[k].n_base, by[k].first_word, by[k].base_labels, by[k].labels, by[k].score) == (0, 0, None, "", "", 0.0)
    assert by[6].labels == "" and by[7].labels == "gpl-3" and by[8].labels == "all-rights-reserved"
    assert licenses.scan(table(spark, [])).count() == 0 and len(licenses.rules()) > 200


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(600)] + [(k, [1.0] * 8) for k in range(600, 640)]
    bad = [(700, None), (750, [0.0] * 8), (800, [float("nan")] * 8), (850, [None] + [1.0] * 7), (900, [1.0] * 5), (950, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(3))
    got = neighbours.nearest(df, F.col("id") % 50 == 0).collect()
    ids = np.array([r[0] for r in rows])
    m = np.array([np.float32(r[1]) for r in rows], float)
    hit = total = 0
    for q in range(0, 640, 50):
        s = (m * m[q]).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((m[q] ** 2).sum()))
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]].tolist()
        own = sorted((r["rank"], r.id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and all(abs(s[r[1]] - r[2]) < 1e-12 for r in own)
        hit, total = hit + len({r[1] for r in own} & set(best)), total + 5
        if q == 600:
            assert [r[1] for r in own] == [601, 602, 603, 604, 605]
    assert hit / total >= 0.9 and len(got) == total
    assert neighbours.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id < 3"), F.col("id") == 0).count() == 2


@pytest.fixture(scope="module")
def marked(spark):
    rows, labels = [], []
    for k in range(300):
        toxic, good = k % 4 == 0, k % 3 > 0
        words = [random.choice(WORDS) for _ in range(50)] + (["nastyword"] * 3 if toxic else [])
        random.shuffle(words)
        rows.append((k, " ".join(words) if good else " ".join(w + "%%%" for w in words)))
        labels.append((k, int(good), int(toxic)))
    return table(spark, rows + [(400, None), (401, ""), (None, "x")]), spark.createDataFrame(labels + [(1, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, marked):
    docs, labels = marked
    known = labelled.known(labels, "toxic", labelled.remainder("doc_id", 4) != 2)
    model = toxicity.fit(labelled.sample(docs, known, 200), labelled.shares(known))
    got = {r.id: r.score for r in toxicity.scores(docs, model).collect()}
    right = [(got[k] >= 0.3) == (k % 4 == 0) for k in range(300)]
    assert sum(right) > 280 and 0 <= got[400] == got[401] <= 1
    seen = spark.createDataFrame([(1, PROSE[0] + " nastywordd nastywrd nastyword"), (2, PROSE[0])], "doc_id long, text string")
    close = {r.id: r.score for r in toxicity.scores(seen, model).collect()}
    assert close[1] > close[2]
    none = labelled.known(labels.limit(0), "toxic", F.lit(True))
    flat = toxicity.fit(labelled.sample(docs, none, 5), labelled.shares(none))
    assert {round(r.score, 6) for r in toxicity.scores(docs, flat).collect()} == {0.5}
    assert toxicity.scores(table(spark, []), model).count() == 0
    assert toxicity.clean(docs, model, 0.5).columns == docs.columns


def test_quality(spark, marked):
    docs, labels = marked
    known = labelled.known(labels, "quality", labelled.remainder("doc_id", 5) != 0)
    model = quality.fit(labelled.sample(docs, known, 200), labelled.shares(known))
    got = {r.id: r.score for r in quality.scores(docs, model).collect()}
    assert sum((got[k] >= 0.3) == (k % 3 > 0) for k in range(300)) > 280 and 0 <= got[400] == got[401] <= 1
    none = labelled.known(labels.limit(0), "quality", F.lit(True))
    flat = quality.fit(labelled.sample(docs, none, 5), labelled.shares(none))
    assert {round(r.score, 6) for r in quality.scores(docs, flat).collect()} == {0.5}
    assert quality.scores(table(spark, []), model).count() == 0


def test_mixing(spark, marked):
    docs, labels = marked
    sample = docs.select(F.col("doc_id").alias("key"), "text").join(labels.where("doc_id is not null and quality is not null"), F.col("key") == F.col("doc_id")).select(F.col("key").alias("id"), "text", F.col("quality").alias("label"))
    model = mixing.fit(sample, [100, 200])
    got = mixing.rates(docs, model, [0.5, 0.5]).collect()
    assert len(got) == docs.count()
    sums = [sum(r.mix_rate * r.n_words * r.posterior[k] for r in got) for k in (0, 1)]
    assert abs(sums[0] / sum(sums) - 0.5) < 0.01 and all(r.mix_rate >= 0 for r in got)
    assert all(r.mix_rate == 1 and r.mix_copies == 1 for r in got if not r.n_words)
    mixed = mixing.mixed(docs, model, [0.5, 0.5], least=1.0)
    assert mixed.columns == [*docs.columns, "mix_rate", "mix_copies"] and mixed.count() == docs.count()
    assert mixing.rates(table(spark, []), model, [0.5, 0.5]).count() == 0

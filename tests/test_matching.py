"""Context matching and duplicate entries against plain versions of their rules."""

import math
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brindle.operators import citations, context


def stem(token):
    token = context.SPELLING.get(token, token)
    if len(token) < 6:
        return token
    return next((token[: -len(s)] for s in context.SUFFIXES if token.endswith(s) and len(token) - len(s) >= 4), token)


def tokens(text):
    words, out = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(), []
    for w in words:
        if len(w) > 2 and w not in context.STOP_WORDS and w not in out:
            out.append(w)
    return out


@pytest.fixture(scope="module")
def data():
    colours, things = ["red", "blue", "grey", "violet"], ["anxious behaviours", "externalizing scale", "reading task", "sleep diary", "memory test"]
    rows = [(k, f"v_{things[k % 5][:3]}_{k % 7}", f"{colours[k % 4]} {things[k % 5]} {'summary' if k % 3 else 'raw values'} form{k // 9}", f"t{k % 3}", f"d{k % 2}", "s", f"{k % 2}.0") for k in range(120)]
    mentions = [(k, f"{colours[k % 4]} {things[k * 7 % 5].replace('izing', 'ized')} form{k % 13}", "summary" if k % 2 else "", "raw values" if k % 3 else "") for k in range(60)] + [(90, "the of", "", ""), (91, None, None, None)]
    return rows, mentions


def plain_scores(rows, mentions, rare):
    label = {r[0]: tokens(r[2]) for r in rows}
    df, stem_df = defaultdict(int), defaultdict(int)
    for words in label.values():
        for w in words:
            df[w] += 1
        for s in {stem(w) for w in words}:
            stem_df[s] += 1
    idf = {w: math.log(len(rows) / n) for w, n in df.items()}
    top, out = max(idf.values()), {}
    for m, text, aux, ctx in mentions:
        q = tokens(text)
        weight = {w: (context.WEAK if w in context.WEAK_TOKENS else 1.0) * idf.get(w, top) for w in q}
        strong = [w for w in q if w not in context.WEAK_TOKENS]
        stems = sorted({stem(w) for w in q if stem(w) in stem_df}, key=lambda s: (stem_df[s], s))
        few = [s for s in stems if stem_df[s] <= rare]
        for r in rows:
            own = label[r[0]]
            own_stems = {stem(w) for w in own}
            if not (own_stems & set(few) if few else stems and own_stems >= set(stems[:2])):
                continue
            met = [w for w in q if w in own or stem(w) in own_stems]
            if len([w for w in met if w in strong]) < min(2, len(strong) or 1):
                continue
            coverage = sum(weight[w] * (1.0 if w in own else context.STEMMED) for w in met) / sum(weight.values())
            a, c = tokens(aux), tokens(ctx)
            score = 0.85 * coverage + 0.15 * len(met) / len(own) + 0.12 * (len(set(a) & set(own)) / len(a) if a else 0) + min(0.06, 0.02 * len((set(c) & set(own)) - set(q)))
            out[m, r[0]] = (score, coverage)
    return out


@pytest.mark.parametrize("rare", [200, 12])
def test_scores(spark, data, rare):
    rows, mentions = data
    dictionary = context.dictionary(spark.createDataFrame(rows, "row long, name string, label string, table string, domain string, study string, release string"))
    got = {(r.mention, r.row): (r.score, r.coverage) for r in context.scores(spark.createDataFrame(mentions, "mention long, text string, auxiliary string, context string"), dictionary, rare=rare).collect()}
    wanted = plain_scores(rows, mentions, rare)
    assert set(got) == set(wanted) and len(got) > 100
    assert all(abs(got[k][0] - wanted[k][0]) < 2e-6 and abs(got[k][1] - wanted[k][1]) < 2e-6 for k in wanted)


def plain_decision(found):
    kept = sorted((c for c in found if c[3] >= context.MIN_SCORE and c[4] >= context.MIN_COVERAGE), key=lambda c: (-c[3], c[0], c[1]))
    if not kept:
        return None
    top = kept[: context.TOP]
    total, tables, domains = sum(c[3] for c in top), defaultdict(float), defaultdict(float)
    for c in top:
        tables[c[1], c[2]] += c[3]
        domains[c[2]] += c[3]
    (table, domain), mass = max(tables.items(), key=lambda kv: kv[1])
    if mass / total >= context.TABLE_MASS:
        own = [c for c in kept if c[1] == table and c[2] == domain]
        rivals = [c for c in own if c[0] != own[0][0]]
        if rivals and round(own[0][3] - rivals[0][3], 6) < context.MARGIN:
            return "family", None, table
        return "variable", own[0][0], table
    if len({c[0] for c in top}) == 1:
        return "variable", top[0][0], None
    name, most = max(domains.items(), key=lambda kv: kv[1])
    return ("domain" if most / total >= context.TABLE_MASS else "ambiguous"), None, None


def test_decisions(spark):
    import random

    rng = random.Random(3)
    rows = [(m, f"v{rng.randrange(6)}", f"t{rng.randrange(4)}", f"d{rng.randrange(3)}", round(0.4 + rng.random() * 0.6, 3), round(0.5 + rng.random() / 2, 3)) for m in range(80) for _ in range(rng.randrange(1, 16))]
    rows += [(200, "v_a_1", "t", "d", 0.9, 0.9), (200, "v_a_2", "t", "d", 0.895, 0.9), (201, "sex", "t1", "d1", 0.9, 0.9), (201, "sex", "t2", "d2", 0.9, 0.9)]
    got = {r.mention: r for r in context.decided(spark.createDataFrame(rows, "mention long, name string, table string, domain string, score double, coverage double")).collect()}
    for m in {r[0] for r in rows}:
        wanted = plain_decision([r[1:] for r in rows if r[0] == m])
        assert (m in got) == (wanted is not None)
        if wanted:
            assert (got[m].status, got[m].variable, got[m].table) == wanted, m
    assert got[200].family_prefix == "v_a_*" and got[200].family_size == 2


def test_duplicate_entries(spark):
    titles = ["A long title about the brains of mice", "A long title about the brain of mice", "Another matter altogether, in rats", "short", "<i>Another</i> matter altogether, in rats", None]
    rows = [(k, "f1" if k in (0, 7) else None, f"c{k // 3}", f"https://doi.org/10.5/{k % 5}." if k % 2 else "", str(k % 11), titles[k % 6]) for k in range(24)]
    df = spark.createDataFrame(rows, "id long, file string, content string, doi string, pmid string, title string")
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower().replace("<i>", " ").replace("</i>", " ")).split())
    wanted = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            basis = ["identical file"] if a[1] and a[1] == b[1] else ["identical text"] if a[2] == b[2] else []
            basis += ["same DOI"] if a[3] and a[3] == b[3] else []
            basis += ["same PMID"] if a[4] == b[4] else []
            x, y = plain(a[5]), plain(b[5])
            if len(x) >= 20 and len(y) >= 20:
                ratio = SequenceMatcher(None, x, y).ratio()
                basis += ["same title"] if x == y else [f"title {round(ratio * 100)}% similar"] if ratio >= 0.9 else []
            if basis:
                wanted[a[0], b[0]] = ", ".join(basis)
    assert {(r.a, r.b): r.basis for r in citations.duplicate_basis(df).collect()} == wanted
    apart = spark.createDataFrame([(3, 0), (1, 2)], "a long, b long")
    assert {(r.a, r.b) for r in citations.duplicate_basis(df, apart).collect()} == set(wanted) - {(0, 3), (1, 2)}


def test_similarity_of_titles(spark):
    pairs = [("Same Title", "same  title!"), ("A title of thirty characters or so", "A title of thirty characters or so: more"), ("abcd", "abce"), ("", "x"), (None, None)]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(citations.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:2] == [1.0, 0.95] and abs(got[2] - 0.75) < 1e-9 and got[3:] == [0.0, 0.0]


def test_aligned_quotes():
    from brindle.functions.quotes import aligned

    text = "Intro.  The quick brown fox jumps over the lazy dog near the river bank today. The quick brown fox."
    quote = "the quick brown fox jumps over the lazy dog near the river bank today"
    assert aligned("The quick brown fox", text, 8, 27) == ("exact", 1.0, 8, 27)
    assert aligned("THE quick\nbrown fox", text, 70, 80) == ("exact_offset_corrected", 1.0, 79, 98)
    assert aligned(quote.replace("lazy", "lazi"), text)[0] == "fuzzy" and text[slice(*aligned(quote.replace("lazy", "lazi"), text)[2:])].lower() == quote
    assert aligned("something else that is nowhere in the whole text", text)[0] == "not_found"
    assert aligned("", text)[:2] == ("not_found", 0.0) and aligned("x", None)[0] == "not_found"

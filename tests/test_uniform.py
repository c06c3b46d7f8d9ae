"""The uniform form of texts: folding, tokens, quantities, sections; and alignments."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brindle.functions import evidence as ev
from brindle.functions import quotes, uniform


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("ﬁnal ５ mg x²", "final 5 mg x"),
        ("½ of them", "1 2 of them"),
        ("Ｐ＜０．０５ and １，２３４", "p < 0.05 and 1234"),
        ("from 2020/1/5 to 2021-12-31", "from date20200105 to date20211231"),
        ("10 – 20 %, −5 and +3", "10 to 20% -5 and +3"),
        ("don't “quote” it", "dont quote it"),
        ("hyphen-\nated words, 12,345,678 and 1,23", "hyphenated words 12345678 and 1 23"),
        ("IL-6, B12, 1.2.3", "il 6 b 1.2"),
        ("x <= 5 +/- 2 >=1 ± 3 +- 4", "x ≤ 5 ± 2 ≥ 1 ± 3 ± 4"),
        ("", ""),
        (None, ""),
    ],
)
def test_tokens(spark, text, wanted):
    assert " ".join(uniform.tokens(text)) == wanted
    row = spark.createDataFrame([(text,)], "t string").select(uniform.normal("t").alias("n"), uniform.normal_each(F.array("t")).alias("m")).first()
    assert (row.n, row.m) == (wanted, [wanted])


def test_quantities_of_folded_texts(spark):
    rows = [("ﬁnal ５ mg",), ("x² was １２ of ４０ and ７５％",), ("Table ５",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(ev.quantities(F.col("t")).alias("q"), ev.shares(F.col("t")).alias("s"))
    got = [([(q.value, q.unit, q.pct) for q in r.q], [(s.n, s.d) for s in r.s]) for r in df.collect()]
    assert got == [([(5.0, "mg", False)], []), ([(12.0, "", False), (40.0, "", False), (75.0, "", True)], [(12, 40)]), ([], []), ([], [])]


def test_section_of_a_folded_quote(spark):
    text = "front\nMethods\nWe gave ５ mg of the ﬁnal dose.\nResults\nNothing."
    df = spark.createDataFrame([("methods", "5 mg of the final dose", text), ("results", "5 mg of the final dose", text), ("", "x", text), ("methods", "7 mg", text)], "c string, q string, t string")
    assert [r.s for r in df.select(ev.section_check(F.col("c"), F.col("q"), F.col("t")).alias("s")).collect()] == ["ok", "mismatch", "skip", "unverifiable"]


def test_locate_folds_and_guards():
    assert quotes.locate("ﬁve ５ mg", "then five 5 mg of it") == ("normalized", 1.0)
    assert quotes.locate("5 mg", "15 mg")[0] == quotes.locate("5", "-5")[0] == quotes.locate("5", "5%")[0] == "absent"
    assert quotes.locate("“5 mg”", "we gave 5 mg.") == ("exact", 1.0)
    assert quotes.locate("a b c d e f g", "x a b c d e f y") == ("paraphrase", 0.5)


def test_alignment_behind_decoys():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    quote = " ".join(rng.choice(words) for _ in range(24))
    head = " ".join(quote.split()[:3])
    decoys = [f"{head} {' '.join(rng.choice(words) for _ in range(20))}" for _ in range(300)]
    near = quote[:40] + "q" + quote[41:90] + quote[91:]
    text = ". ".join(decoys) + ". " + near + ". " + ". ".join(decoys[:20])
    status, similarity, start, stop = quotes.aligned(quote, text)
    assert status == "fuzzy" and text[start:stop] == near and similarity == round(SequenceMatcher(None, quote, near, autojunk=False).ratio(), 4)
    assert quotes.aligned(quote, ". ".join(decoys))[0] == "not_found"


def test_ends_against_all_stretches():
    rng = random.Random(2)
    for _ in range(60):
        quote, text = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 7), rng.randint(0, 14)))
        row = [0] * (len(text) + 1)  # fewest edits of a stretch that ends at each place
        for k, c in enumerate(quote, 1):
            above, row = row, [k]
            for j, t in enumerate(text, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != t)))
        got = quotes.ends(quote, text, 1)
        if text:
            assert min(got)[0] == min(row[1:]) and all(row[end] == edits for edits, end in got)
            assert all(any(abs(end - j) <= 2 * len(text) and e <= row[j] for e, end in got) for j in range(1, len(text) + 1) if row[j] <= 1)

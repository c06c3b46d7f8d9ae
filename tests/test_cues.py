"""Every term of the context score, against the rules written out."""

import re

import pytest

from brindle.operators import context

ROWS = [
    (1, "fes_p_ss_fc", "Family conflict subscale raw score [Parent]"),
    (2, "fes_y_ss_fc", "Family conflict subscale raw score"),
    (3, "fes_t_ss", "Family conflict subscale, Teacher"),
    (4, "fes_ss_pr", "Family conflict subscale prorated"),
    (5, "fes_ss_12", "Family conflict subscale"),
    (6, "fes_q7", "Family conflict subscale: does your family fight?"),
    (7, "fes_q8", "Family conflict subscale: how often would you say that people living with you at home fight, shout, argue, threaten or hurt each other badly? "),
    (8, "fes_dk", "Family conflict subscale"),
    (9, "fes_admin", "Family conflict subscale number answered"),
    (10, "fes_tscore", "Family conflict subscale T-score computed"),
    (11, None, "Family conflict subscale average"),
    (12, "height", "Standing height in inches"),
    (13, "weight", "Body weight in pounds"),
]
MENTIONS = [
    (1, "family conflict subscale", None, None), (2, "parent-reported family conflict subscale", "", ""), (3, "family conflict subscale", "youth report", "parents were asked too"), (4, "family conflict subscale", None, "as rated by the teacher"),
    (5, "family conflict subscale T-scores", None, None), (6, "mean family conflict subscale", None, "raw scores were used"), (7, "does the family conflict subscale fight?", None, None), (8, "prorated family conflict subscale", None, None),
    (9, "parent- and youth-reported family conflict subscale", None, "by teacher report"),
]


def first(text, patterns):
    return next((name for name, rx in patterns.items() if re.search(rx, text, re.I)), None)


def sole(text, patterns):
    """What one pattern alone names; several say nothing."""
    found = [name for name, rx in patterns.items() if re.search(rx, text, re.I)]
    return found[0] if len(found) == 1 else None


def terms(name, label, text, aux, ctx, tokens):
    name, asked = name or "", f"{text} {aux or ''} {ctx or ''}"
    who = first(label, context.LABEL_RESPONDENTS) or first(name.lower(), context.NAME_RESPONDENTS)
    wanted = sole(f"{text} {aux or ''}", context.PAPER_RESPONDENTS) or sole(ctx or "", context.PAPER_RESPONDENTS)
    metrics = {m for m, rx in context.LABEL_METRICS.items() if re.search(rx, label, re.I)}
    want = {m for m, rx in context.PAPER_METRICS.items() if re.search(rx, asked, re.I)}
    out = {"who": 0.0 if not wanted or not who else 0.10 if who == wanted else -0.18, "metric": 0.0 if not want else 0.08 if want & metrics else -0.05 if metrics else 0.0}
    out["item"] = -0.10 if re.search(r"___\d+$|_q\d+$|_\d{1,3}$", name) else 0.0
    asks = label.rstrip().endswith("?") and "?" not in text
    out["question"] = -0.18 if asks else 0.0
    out["long"] = -0.20 * min(1.0, (tokens - 12) / 12) if asks and tokens > 12 else 0.0
    out["admin"] = -0.22 if re.search(context.ADMINISTRATION_LABEL, label) or re.search(r"_(?:dk|nr|refuse[d]?|na)$", name) else 0.0
    out["unasked"] = -0.06 if {m for m in metrics if m in context.QUALIFIERS} - want else 0.0
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame([(*r, "t", "d", "s", "1.0") for r in ROWS], "row long, name string, label string, table string, domain string, study string, release string")
    dictionary = context.dictionary(rows)
    mentions = spark.createDataFrame(MENTIONS, "mention long, text string, auxiliary string, context string")
    plain = context.scores(mentions, dictionary)
    own = {r.row: len(r.tokens) for r in dictionary.collect()}
    keep = lambda df: {(r.mention, r.row): r.score for r in df.collect()}
    return keep(plain), keep(context.cued(plain, mentions, dictionary)), own


def test_all_terms(scored):
    plain, got, own = scored
    rows, seen = {r[0]: r[1:] for r in ROWS}, set()
    assert set(plain) == set(got) and len(got) >= 80
    for (m, r), base in plain.items():
        each = terms(*rows[r], *MENTIONS[m - 1][1:], own[r])
        seen |= {(k, v > 0) for k, v in each.items() if v}
        assert got[m, r] == pytest.approx(base + sum(each.values()), abs=3e-6), (m, r, each)
    assert seen == {("who", True), ("who", False), ("metric", True), ("metric", False), ("item", False), ("question", False), ("long", False), ("admin", False), ("unasked", False)}

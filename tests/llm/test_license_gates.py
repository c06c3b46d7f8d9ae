"""What gates license rules stands in every match: samples of each rule, and the scan without gates."""

import random
import re
from re import _parser

from test_llm_operators import table

from brindle.llm import licenses


def sample(rng, parsed):
    """A text that the expression matches; look-arounds are left out."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                kind, value = rng.choice(arg)
                out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
            case "BRANCH":
                out += sample(rng, rng.choice(arg[1]))
            case "SUBPATTERN":
                out += sample(rng, arg[3])
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
            case "ANY":
                out += "y"
    return out


def samples():
    rng = random.Random(6)
    for rule in licenses.rules():
        for _ in range(40):
            text = f" {sample(rng, _parser.parse(rule.expression))} "
            if re.search(rule.expression, text):
                yield rule, text


def test_gates_stand_in_every_match():
    seen = set()
    for rule, text in samples():
        seen.add(rule)
        assert rule.keyword in text and rule.need in text, (rule, text)
        assert any(word in text for word in licenses.TRIGGERS), (rule, text)
    assert seen == set(licenses.rules())


def test_scan_without_gates_finds_the_same(spark, monkeypatch):
    texts = ["made available under the Open Database License", "Distributed under the Boost Software License", "see the terms of the zlib", "a copy of the PSF", "nothing at all"]
    docs = table(spark, list(enumerate(texts))).select("doc_id", "text")
    got = {r.id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert [got[k][0] for k in range(5)] == ["odbl", "boost", "zlib", "python", ""]
    plain = [r._replace(keyword="", need="") for r in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: plain)
    monkeypatch.setattr(licenses, "TRIGGERS", [""])
    assert {r.id: (r.labels, r.score) for r in licenses.scan(docs).collect()} == got

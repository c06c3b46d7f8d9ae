"""Token counts of texts without restarts, whose chunks' maps are composed."""

import random
import time

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sentencepiece import SentencePieceProcessor  # noqa: E402

from brindle.llm.tokens import Transducer  # noqa: E402

POOLS = ["abcdefghijklmnopqrstuvwxyz", "ab", "the quick brown ", " ab", "éàü日本語한국 a", "aA1 .,-_/\n\t", " ", "a", "x日", "-", "ab-"]


@pytest.fixture(scope="module")
def machines():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return Transducer(path), SentencePieceProcessor(model_file=path)


def test_counts_of_random_texts(machines):
    rng = random.Random(12)
    texts = ["".join(rng.choice(rng.choice(POOLS[k % len(POOLS)]) if k % 3 else POOLS[k % len(POOLS)][0]) for _ in range(rng.choice([0, 1, 5, 300, 3000, 9000]))) for k in range(300)]
    texts += ["a" * 100_000, "ab" * 40_000, "abc" * 30_000 + " x " * 20, "x" + "-" * 70_000 + "y" + "-" * 70_000, "日本" * 5000, "aab" * 7 + "b" * 80_000]
    assert machines[0].counts([t.encode() for t in texts]) == [len(machines[1].encode(t)) for t in texts]


def test_one_letter_a_million_times(machines):
    for letter in (b"a", b"-"):
        began = time.time()
        machines[0].counts([letter * 1_000_000])
        assert time.time() - began < 10

"""Vectors of several lengths: each is searched by itself."""

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import neighbours


def test_each_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 8 * 8 * 300)  # a sample of few rows
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8 if k % 3 else 5).tolist()) for k in range(700)] + [(700, [1.0]), (3, rng.normal(size=8).tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    held, hits, all_ = {}, 0, 0
    for r in got:
        held.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    cosine = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    for q in range(0, 700, 50):
        own = rows[q][1]
        best = {}
        for k, v in rows:
            if k != q and len(v) == len(own):
                best[k] = max(best.get(k, -2), cosine(own, v))
        wanted = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        found = sorted(held[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(best[i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for i, _ in wanted} & {i for _, i, _ in found})
        all_ += 5
    assert hits / all_ >= 0.9 and 700 not in held  # the only vector of its length has no neighbour

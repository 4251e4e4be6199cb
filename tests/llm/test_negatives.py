"""Hard negatives against SQL, and against comparing all rows."""

from __future__ import annotations

import numpy as np
import pytest

from evidra.llm import op11_negatives as op
from oracle import both


def test_negatives_match_sql(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got, want = both(spark, sf_dir, op.op11_hard_negatives, op.ORACLE)
    assert got == want and len(got) > 50


def plain(rows, every, positives, k):
    """Every anchor against every row: rows are (id, label, whole numbers)."""
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        score = [(-int(np.dot(v, w)), j, m) for j, m, w in rows if j != i]
        same = sorted((s, j) for s, j, m in score if m == label)[:positives]
        other = sorted((s, j) for s, j, m in score if m != label)
        for p, j in same:
            inside = [(s, n) for s, n in other if -30 * p <= -100 * s <= -90 * p][:k]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 0.15, 1.0])
def test_negatives_by_hand(spark, monkeypatch, spread):
    """Several levels, chunks and blocks; clusters, loose vectors, and copies of one vector that fill more than a task."""
    for name, value in (("LEAF", 32), ("BUCKET", 8), ("CHUNK", 40), ("RESERVE", 64)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 6))
    x = centres[rng.integers(0, 12, 900)] + spread * rng.standard_normal((900, 6))
    x[rng.random(900) < 0.2] = x[0]
    x, labels = np.floor(16 * x), rng.integers(0, 5, 900)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(map(tuple, op.hard_negatives(df, scale=1, every=30).collect()))
    assert got == plain([(i, int(y), v) for i, (v, y) in enumerate(zip(x, labels, strict=True))], 30, 5, 10) and len(got) > 500


def test_leaves_out_what_is_too_far():
    """Well parted clusters: the lower tree scores few rows; the answers stay."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((8, 4))[np.arange(2000) % 8] * 1000 + rng.standard_normal((2000, 4)))
    tree = op.Upper(int((x * x).sum(axis=1).max()), "<i8", 0, np.zeros((0, 5)), np.zeros(0))
    lower = op.Lower(tree, x, np.arange(2000), np.zeros(2000, np.int64))
    scored = []
    near = x[:5] @ x.T
    high = np.sort(near, axis=1)[:, -100]
    lower.x = Counting(x, scored)
    w, r, s = lower.search(tree.top, x[:5], np.arange(5) - 10, np.zeros(5, np.int64), np.arange(5), np.full(5, -1e12), high, True, 10)
    assert sum(scored) < 5 * 2000 / 2
    for i in range(5):
        inside = np.flatnonzero(near[i] <= high[i])
        assert r[w == i].tolist() == inside[np.lexsort((inside, -near[i][inside]))][:10].tolist()


class Counting:
    """Rows that note how many of them were read."""

    def __init__(self, x, noted):
        self.x, self.noted = x, noted

    def __getitem__(self, rows):
        self.noted.append(len(rows))
        return self.x[rows]


def test_negatives_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (3, [0.5], 2), (3, [0.5], 2), (4, None, 2), (5, [0.5, 0.0], None), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2),
        (8, [None, 1.0], 2), (None, [0.5, 0.0], 2), (9, [], 2), (10, [0.95, 0.0], 2), (100, [0.0, 0.0], 3), (200, [-1.0, 0.0], 4), (201, [1.0, 0.0], 4),
    ]
    df = spark.createDataFrame([(i, v, y, "x", 1.0) for i, v, y in rows], "vec_id long, embedding array<float>, label int, id string, score double")
    assert sorted(map(tuple, op.hard_negatives(df).collect())) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]
    assert op.hard_negatives(df.limit(0)).count() == 0 and op.hard_negatives(df.where("vec_id = 0")).count() == 0 and op.hard_negatives(df.where("vec_id = 9")).count() == 0
    with pytest.raises(Exception, match="above 2"):
        op.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<double>, label int")).count()

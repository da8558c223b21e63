import numpy as np
from pyspark.sql import functions as F

from pollspark.llm import negatives


def brute(rows, step):
    kept = {(i, l, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, l in rows
            if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a, al, av in kept:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, l) for i, l, v in kept if i != a and len(v) == len(av))
        for ps, p, _ in [s for s in scored if s[2] == al][:5]:
            good = [(-s, i) for s, i, l in scored if l != al and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, p, k + 1, i, -ps, s) for k, (s, i) in enumerate(good)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS shard", "2 AS id", "'z' AS h1", "3 AS rank")


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    x = np.round(centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 6)), 2)
    x[100:350] = x[7]  # copies of one vector, under several labels
    x[400:420] *= 5
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1010, [0.0] * 6, 1), (1020, [float("nan")] + [1.0] * 5, 1), (1030, [None] + [1.0] * 5, 1), (1040, [], 1), (1050, [1.0] * 6, None),
             (None, [1.0] * 6, 2), (1060, [1.0, 2.0], 1), (1070, [1.0, 2.5], 1), (1071, [1.0, 2.0], 0), rows[20], rows[20], (20, rows[21][1], 1)]
    found = negatives.mine(table(spark, rows), anchor=F.col("id") % 10 == 0, shard=150)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)
    assert negatives.mine(table(spark, []), anchor=F.col("id") % 10 == 0).count() == 0


def test_tree_covers_and_skips():
    rng = np.random.default_rng(6)
    x = np.unique(np.floor(256 * (rng.normal(size=(40, 16)).repeat(50, 0) + 0.05 * rng.normal(size=(2000, 16)))), axis=0)
    tree = negatives.CoverTree.build(x)
    assert sorted(tree.order.tolist()) == list(range(len(x))) and (tree.points == x[tree.order]).all()
    q, best, taken = x[3], [-np.inf], 0

    def verify(at, scores):
        best[0] = max(best[0], scores.max())

    taken = tree.descend(q, lambda low, high: high >= best[0], verify)
    assert best[0] == (x @ q).max() and taken < len(x) / 4

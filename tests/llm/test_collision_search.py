from math import comb, erf, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import collision_search as cs

from .cases import CLASHING

QUERY = "vec_id % 50 = 0"


def brute_force(rows, k=5):
    """All cosines; the rows that take part have one length."""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == len(rows[0][1]) and np.isfinite(v).all() and any(v)]
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v.tolist()), v.tolist())
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for q, v in asked.items():
        v = np.array(v)
        score = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def table(spark, rows):
    clashing = {c: F.lit(1) for c in (*CLASHING, "v", "grp", "at", "score", "sorted", "order")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clashing)


def found(frame, **options):
    out = {}
    for r in sorted(cs.nearest(frame, F.expr(QUERY), 5, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    """Scores are exact; a found row counts if it scores no less than the last of the true ones."""
    hits = 0
    for q, best in want.items():
        assert len(got[q]) == len(best)
        hits += sum(s >= best[-1][1] - 1e-12 for _, s in got[q])
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["scattered", "clustered", "skewed"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if kind == "clustered":
        x = x[rng.integers(0, 20, 3000)] + 0.05 * x
    if kind == "skewed":
        x = x * np.geomspace(1, 0.01, 32) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(table(spark, rows), block_rows=700, group_queries=25), brute_force(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    scores = {(i, j): s for i, best in brute_force(rows, 3000).items() for j, s in best}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, best in got.items() for i, s in best)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(220, 8)))]
    rows += [(1000 - i, rows[50][1]) for i in range(9)] + [(100, rows[100][1]), (100, [9.0] * 8), (1001, [2 * x for x in rows[0][1]])]
    rows += [(None, rows[0][1]), (2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] + [1.0] * 7), (2200, [1.0]), (2250, []), (2300, [float("inf")] * 8)]
    rows += [(2350, [1e200] * 8), (7, [3e-170] * 7 + [0.0])]
    got, want = found(table(spark, rows), block_rows=64, group_queries=2), brute_force(rows[:-2] + [(2350, [1.0] * 8), (7, [1.0] * 7 + [0.0])])
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    assert [i for i, _ in got[50]] == [992, 993, 994, 995, 996]  # ties go to smaller identifiers, whichever rows came first


def test_few_none_and_all_alike(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert [i for i, _ in found(table(spark, few))[0]] == [1, 2]
    assert found(table(spark, few).limit(0)) == {}
    assert found(table(spark, few[1:])) == {}
    alike = [(i, [1.0, 2.0, 3.0]) for i in range(3000)]
    assert [i for i, _ in found(table(spark, alike), block_rows=500)[50]] == [0, 1, 2, 3, 4]


def test_windows_count_what_lies_in_them():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(4, 6))
    projections = cs.lines(16, 6, 1)
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    at = unit(x) @ projections.T
    order = np.argsort(at, 0).T
    block = {"ids": np.arange(300), "norms": np.sqrt((x * x).sum(1)), "vectors": x, "sorted": np.take_along_axis(at.T, order, 1).astype(np.float32), "order": order.astype(np.int32)}
    search = cs.BlockSearch({k: v.tobytes() for k, v in block.items()}, projections, 5, 13)
    search.counts = np.zeros((4, 300), np.uint16)
    edges = [np.array([[np.searchsorted(s, a + h) for s, a in zip(search.sorted, row)] for row in unit(q) @ projections.T]) for h in (-0.7, -0.2, 0.2, 0.7)]
    search._expand(np.arange(4), edges[1], edges[1], edges[1], edges[2])
    search._expand(np.arange(4), *edges)
    assert (search.counts == (np.abs((unit(q) @ projections.T)[:, None] - at) < 0.7).sum(2)).mean() > 0.999


def test_threshold_is_the_binomial_tail():
    p = erf(cs.WIDTH / sqrt(2))
    for m in (8, 64):
        t = cs.threshold(m, 0.97)
        tail = lambda t: sum(comb(m, j) * p**j * (1 - p) ** (m - j) for j in range(t, m + 1))  # noqa: B023, E731
        assert tail(t) >= 0.97 > tail(t + 1)

"""Nearest neighbours against all inner products."""

import numpy as np
import pytest

from prefscope.llm import vector_forest as V

SCHEMA = "vec_id long, embedding array<float>, label int, v string, leaf int, key string, n long"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y", 3) for i, v in rows], schema)


def product(a, b):
    """Summed from the first component on; sum() would round once."""
    out = 0.0
    for x, y in zip(a, b):
        out += float(x) * float(y)
    return out


def plain(rows, k, dimension):
    use = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
           if i is not None and v is not None and len(v) == dimension and None not in v]
    use = [(i, v) for i, v in use if np.isfinite(v).all() and v.any()]
    use = list({(i, (v + 0.0).tobytes()): (i, v) for i, v in use}.values())
    out = []
    for a, (i, q) in enumerate(use):
        if i % 20 == 0:
            scored = sorted((-product(q, v), j) for b, (j, v) in enumerate(use) if b != a)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, **options):
    t = table(spark, rows)
    got = V.nearest(t, t.where("vec_id % 20 = 0"), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dimension=16, seed=1, centres=10, spread=.4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension))
    rows = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dimension))
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows.astype(np.float32))]


def test_one_leaf_is_exact(spark):
    rows = vectors(300)
    assert found(spark, rows) == plain(rows, 20, 16)


@pytest.mark.parametrize("spread", [.3, 3.0])
def test_recall_of_the_forest(spark, spread):
    rows = vectors(3000, spread=spread)
    want, got = plain(rows, 20, 16), found(spark, rows, leaf_rows=128)
    assert len(got) == len(want)
    near = lambda r: {(q, v) for q, _, v, _ in r}
    assert len(near(want) & near(got)) >= .9 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    for q, _, v, s in got:
        assert s == product(exact[q], exact[v])
    depth = V.fitted(np.array([v for _, v in rows]), 3000, 9.0, 20, leaf_rows=128)
    assert depth[0].depth == 5 and depth[1] < 4 * 32


def test_a_third_of_all_vectors_equal(spark):
    rows = vectors(600)
    rows += [(1000 + i, rows[7][1]) for i in range(300)]
    assert found(spark, rows, leaf_rows=2000) == plain(rows, 20, 16)
    got = found(spark, rows, leaf_rows=64)
    hot = [r for r in got if r[0] == 1020]
    assert [r[2] for r in hot][:3] == [7, 1000, 1001] and 1020 not in {r[2] for r in hot} and len(hot) == 20


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (20, [2.0, 1.0]), (40, None), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (9, [-1.0, -0.0]), (9, [-1.0, 0.0]),
            (1, [0.5, 0.5]), (20, [0.0, 1.0]), (100, [0.0, 0.0])]
    assert found(spark, rows) == plain(rows, 20, 2)
    assert found(spark, []) == [] and found(spark, [(0, None)]) == [] and found(spark, [(0, [1.0])]) == []


def test_doubles_stay_doubles(spark):
    t = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 0.7])], "vec_id long, embedding array<double>")
    got = V.nearest(t, t.where("vec_id = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.1 * 0.3 + 0.2 * 0.7)]


def test_longer_vectors_win(spark):
    # The nearest by angle is not the one with the largest product.
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [5.0, 4.0]), (3, [-9.0, 0.0])]
    assert [r[2] for r in found(spark, rows)] == [2, 1, 3]

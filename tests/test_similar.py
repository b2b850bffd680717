"""Exact links of vectors against all pairs."""

import numpy as np
import pytest

from prismata.operators import graph, similar


def unit_vectors(n=500, width=12):
    """Clusters of several widths, and vectors without any."""
    turn = np.random.default_rng(3)
    middle = turn.normal(size=(9, width))
    x = np.concatenate([middle[i % 9] + (0.05 + 0.1 * (i % 5)) * turn.normal(size=(1, width)) for i in range(n)] + [turn.normal(size=(100, width))])
    return x * turn.uniform(0.1, 9, (len(x), 1))


@pytest.fixture(scope="module")
def vectors(spark):
    x = unit_vectors()
    odd = [("n1", None), ("n2", [0.0] * 12), ("n3", [float("nan")] * 12), ("n4", [None] + [1.0] * 11), ("n5", [float("inf")] * 12), (None, [1.0] * 12)]
    return spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)] + odd, "accession string, vec array<double>").repartition(6), x


@pytest.mark.parametrize("t, how", [(0.9, {}), (0.9, {"cells": 12, "chunk": 20, "visits": 15}), (0.5, {"cells": 30, "chunk": 1000}), (0.995, {"cells": 3, "chunk": 7}), (1e-9, {"cells": 5})])
def test_links_are_all_pairs(spark, vectors, t, how):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = {tuple(sorted((f"v{i}", f"v{j}"))): cos[i, j] for i, j in zip(*np.nonzero(np.triu(cos >= t, 1)))}
    rows = similar.vector_edges(df, t, **how).collect()
    assert len(rows) == len(want) and {(r.src, r.dst): r.similarity for r in rows} == pytest.approx(want)
    few = similar.vector_edges(df, t, spanning=True, **how)
    assert {(r.src, r.dst) for r in few.collect()} <= set(want)
    number = lambda e: e.selectExpr("cast(substr(src, 2) as bigint) as a", "cast(substr(dst, 2) as bigint) as b")
    roots = {r.node: r.root for r in graph.components(number(few)).collect()}
    all_ = {r.node: r.root for r in graph.components(number(spark.createDataFrame(list(want), "src string, dst string"))).collect()}
    same = lambda d: {frozenset(k for k in d if d[k] == r) for r in set(d.values())}
    assert same(roots) == same(all_)


def test_cells_leave_out_what_is_far(spark, vectors):
    df, x = vectors
    to = similar.placed(df, float(np.arccos(0.97)), 12).selectExpr("sum(size(to)) as n", "count(*) as k").first()
    assert to.k == len(x) and to.n < 3 * len(x)  # of 12 cells, of which half would be visited


def test_copies_make_few_links(spark):
    turn = np.random.default_rng(5)
    x = 1 + 0.05 * turn.normal(size=(3000, 8))
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "accession string, vec array<double>")
    assert 2999 <= similar.vector_edges(df, 0.9, chunk=500, spanning=True).count() < 8 * 3000
    with pytest.raises(ValueError):
        similar.vector_edges(df, 0)
    assert similar.vector_edges(df.limit(0), 0.9).count() == 0

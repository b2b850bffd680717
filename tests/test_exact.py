"""Quantiles and k-means that hold no group in one task, against numpy."""

import math

import numpy as np
import pytest

from prismata.operators import kmeans, quantiles, reports


def groups():
    turn = np.random.default_rng(8)
    out = {"ties": [1.0] * 700 + [2.0] * 3 + [0.5], "one": [3.25], "two": [1.0, 4.0], "many": turn.normal(size=4000).tolist(), "steep": [2.0**-k for k in range(900)], "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 1e-300]}
    out["ends"] = [float("inf"), float("-inf"), 5.0, 6.0, 7.0]
    return out


@pytest.mark.parametrize("bins", [1024, 7])
def test_quantiles(spark, bins, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", bins)
    data = groups()
    if bins == 7:
        data.pop("steep")  # each pass takes a few of its values
    rows = [(k, x) for k, v in data.items() for x in v] + [("ties", None), ("many", float("nan")), ("none", None), (None, 2.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, "k", "x", fractions).collect()}
    assert set(got) == {*data, None} and got[None] == pytest.approx([2.0, 3.5, 5.0, 7.4, 8.0])
    for k, v in data.items():
        want = np.quantile(np.nan_to_num(np.array(v), posinf=quantiles.LARGEST, neginf=-quantiles.LARGEST) / 4, fractions) * 4.0 if k != "wide" else None
        if k == "wide":
            assert got[k][0] == -1.7e308 and got[k][2] == 1e-300 and got[k][4] == 1.7e308
        elif k == "ends":
            assert got[k][2] == 6.0 and got[k][1] == 5.0
        else:
            assert got[k] == pytest.approx(want.tolist(), rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "k", "x", fractions).count() == 0


def test_boxes_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 100.0), ("b", None)], "k string, x double")
    got = {r.k: tuple(r)[1:] for r in reports.box_stats(df, "k", "x").collect()}
    assert got == {"a": (1.75, 2.5, 27.25, 1.0, 3.0), "b": (None,) * 5} or got["a"][:3] == (1.75, 2.5, 27.25) and got["b"] == (None,) * 5


def lloyd(x, c, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() < 1e-9:
            return new
        c = new
    return c


def test_centres_are_those_of_lloyds_rounds(spark):
    turn = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    rows, data = [], {}
    for ec, n in (("A", 300), ("B", 41), ("C", 3), ("D", 2), ("E", 60)):
        middle = turn.normal(size=(4, 6))
        data[ec] = [unit(middle[i % 4] + 0.3 * turn.normal(size=6)) for i in range(n)] if ec != "E" else [unit(np.ones(6))] * n
        rows += [(ec, f"{ec}{i}", x.tolist()) for i, x in enumerate(data[ec])]
    df = spark.createDataFrame(rows, "ec string, accession string, vec array<double>").repartition(6)
    vectors = df.select("accession", "vec")
    members = df.select("ec", "accession").unionByName(spark.createDataFrame([("A", "unknown"), ("F", "unknown")], "ec string, accession string"))
    first = {r.ec: np.array(r.c) for r in kmeans.starts(df.where("ec != 'D'"), 3, 0).collect()}
    found: dict = {}
    for r in kmeans.sub_prototypes(vectors, members, 3).collect():
        found.setdefault(r.ec, {})[r.proto_id] = (np.array(r.vec), r.train_count)
    assert {k: len(v) for k, v in found.items()} == {"A": 3, "B": 3, "C": 3, "D": 1, "E": 3}
    for ec in "ABCE":
        x = np.array(data[ec])
        assert all(np.abs(x - c).max(axis=1).min() < 1e-12 for c in first[ec])  # starts are members
        want = lloyd(x, first[ec], 25)
        for j in range(3):
            assert found[ec][j][0] == pytest.approx(unit(want[j]), abs=1e-9) and found[ec][j][1] == len(x)
    assert found["D"][0][0] == pytest.approx(unit(np.mean(data["D"], axis=0)), abs=1e-9)
    assert len({tuple(c) for c in first["A"]}) == 3 and kmeans.sub_prototypes(vectors, members.limit(0), 3).count() == 0


def test_starts_are_drawn_by_squared_distance(spark):
    """Of three points, the one at twice the distance is drawn four times as often, whatever the seed."""
    far = {"p": 0.0, "q": 1.0, "r": 2.0}
    rows = [(f"c{i}", k, [x]) for i in range(3000) for k, x in far.items()]
    df = spark.createDataFrame(rows, "ec string, accession string, vec array<double>")
    counts: dict = {}
    for r in kmeans.starts(df, 2, 1).collect():
        counts.setdefault(r.c[0][0], []).append(r.c[1][0])
    share = np.mean([x == 2.0 for x in counts[0.0]])
    assert all(800 < len(v) < 1200 for v in counts.values()) and abs(share - 0.8) < 4 * math.sqrt(0.8 * 0.2 / len(counts[0.0]))

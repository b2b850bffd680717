"""Classes drawn by weights among many, and the numbers that draws look up."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismata.functions import vectors
from prismata.operators import episodes, labels, settings


def members(spark, sizes):
    return spark.createDataFrame([(c, f"{c}-{i}") for c, n in sizes.items() for i in range(n)], "ec string, accession string")


def test_draws_have_the_chances_of_their_weights(spark):
    sizes = {f"c{i:02}": 2 + 40 * (i % 3) for i in range(30)}
    weight = {c: 1 / math.log(1 + n) for c, n in sizes.items()}
    total = sum(weight.values())
    rows = episodes.pick_classes(members(spark, sizes), 4000, 3, 2, 0, seed=5).collect()
    assert len(rows) == 12_000 and len({(r.episode, r.ec) for r in rows}) == 12_000 and all(r.n == sizes[r.ec] for r in rows)
    assert Counter(r.slot for r in rows) == {0: 4000, 1: 4000, 2: 4000}
    kind = lambda c: sizes[c]
    first, second = (Counter(kind(r.ec) for r in rows if r.slot == s) for s in (0, 1))
    for n in set(sizes.values()):
        own = [c for c in sizes if sizes[c] == n]
        p1 = sum(weight[c] for c in own) / total
        p2 = sum(weight[c] / total * sum(weight[d] for d in own if d != c) / (total - weight[c]) for c in sizes)
        for found, p in ((first[n], p1), (second[n], p2)):
            assert abs(found - 4000 * p) < 4.5 * math.sqrt(4000 * p * (1 - p))


def test_draws_go_on_until_all_differ(spark):
    """One class that outweighs all others: most draws repeat it."""
    sizes = {"rare": 1} | {f"c{i:02}": 2500 for i in range(12)}
    m = members(spark, {c: min(n, 300) for c, n in sizes.items()})
    rows = episodes.pick_classes(m, 60, 8, 1, 0, seed=1, few=0).collect()
    assert Counter(r.episode for r in rows) == {e: 8 for e in range(60)} and len({(r.episode, r.ec) for r in rows}) == 480
    same = episodes.pick_classes(m.repartition(7), 60, 8, 1, 0, seed=1, few=0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, same))
    flat = episodes.pick_classes(m, 60, 13, 1, 0, seed=1, few=0, boost=False).collect()
    assert len(flat) == 60 * 13


def test_tiers_of_many_classes(spark):
    sizes = {f"a{i}": 5 for i in range(2)} | {f"b{i:02}": 3 for i in range(40)} | {f"c{i}": 1 for i in range(9)}
    rows = episodes.pick_classes(members(spark, sizes), 10, 4, 2, 3, seed=2).collect()
    assert len(rows) == 40 and all((r.slot < 2) == r.ec.startswith("a") and not r.ec.startswith("c") for r in rows)
    assert episodes.pick_classes(members(spark, sizes), 10, 43, 2, 3, seed=2).count() == 0
    assert episodes.pick_classes(members(spark, sizes).limit(0), 10, 1, 1, 1, seed=2).count() == 0


def test_sums_over_ranges(spark):
    df = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 977, F.lit("-"), "id").alias("key"), (F.col("id") % 7).alias("w")).repartition(9)
    want, total = {}, 0
    for r in sorted(df.collect()):
        want[r.key] = (total, total + r.w)
        total += r.w
    for inclusive in (False, True):
        assert {r.key: r.s for r in labels.ranged(df, "key", F.col("w"), "s", inclusive).collect()} == {k: v[inclusive] for k, v in want.items()}


def test_grids_of_columns(spark):
    df = spark.createDataFrame([(0.5,), (0.01,), (50.0,)], "t double")
    for r in df.select("t", vectors.temperatures(F.col("t")).alias("g"), vectors.points(F.lit(0.6), F.lit(0.95), 0.01).alias("p")).collect():
        assert sorted(set(r.g)) == pytest.approx(vectors.temperature_grid(r.t)) and r.p == vectors.steps(0.6, 0.95, 0.01)
    keys = spark.createDataFrame([('{"70": {}, "30": 1, "config": {}, "100": "x", "-5": 1}',), ("{}",), (None,)], "j string").select(settings.numeric_keys(F.col("j")).alias("k")).collect()
    assert [r.k for r in keys] == [[30, 70, 100], [], None]

import random

import pytest

from prismata.operators import graph, shingles, splits
from prismata.plans import registry

labels = registry.labels


def lines(seed):
    turn = random.Random(seed)
    return lambda n: " ".join(f"{turn.choice('abcdefgh')}{turn.randrange(10_000)}" for _ in range(n))


def test_only_repeated_texts_are_marked(spark):
    """Texts that are classes of their own needn't move; those with a copy, or a doc_id of more texts, must."""
    line = lines(1)
    one = line(20)
    rows = [(i, line(20)) for i in range(-200, 200)] + [(300, one), (301, one), (302, line(9)), (302, line(8)), (303, line(8)), (303, "a b"), (304, one + " x"), (304, one + " x")]
    sets = shingles.sized(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    marks = shingles.repeated(sets)
    spots = {r.doc_id: r.spot - 1 for r in sets.select("doc_id", shingles.spot(shingles.BITS)).collect()}
    assert len(marks) * 8 == shingles.BITS
    assert {i for i, x in spots.items() if marks[x >> 3] >> (x & 7) & 1} == {300, 301, 302, 304}
    assert sum(x.bit_count() for x in marks) == 4


@pytest.mark.parametrize("bits", [32768, 1])
def test_a_full_filter_changes_no_class(spark, monkeypatch, bits):
    line = lines(2)
    body = line(30)
    rows = [(i, f"{body} {line(i % 3)}") for i in range(-40, 40)] + [(i, line(12)) for i in range(50, 80)] + [(7, line(5)), (50, "a b c d"), (90, None), (None, body)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = lambda: [sorted((r["class"], r.n, [x.df for x in r.g]) for r in splits.shingle_classes(docs)[1].collect()), sorted(splits.shingle_classes(docs)[0].collect())]
    want = plain()
    monkeypatch.setattr(shingles, "BITS", bits)
    assert plain() == want and len(want[0]) > 40


def test_shingles_of_few_classes_are_looked_up_once(spark, monkeypatch):
    """Pairs of near copies go to no round and no bucket, beside a group of many."""
    line = lines(3)
    named = [(i, f"{b} {line(4)}") for k in range(60) for b in [line(40)] for i in (2 * k, 2 * k + 1)]
    docs = lambda x: spark.createDataFrame(x, "doc_id long, text string").repartition(3)
    seen, pairs = [], splits.bucket_pairs
    monkeypatch.setattr(splits, "bucket_pairs", lambda rare, *a: seen.append(rare.count()) or pairs(rare, *a))
    found = splits.connecting_edges(splits.shingle_classes(docs(named), similar=0.5)[1], 0.5)
    assert seen == [0]
    assert sorted((r.a, r.b) for r in found.collect()) == [(2 * k, 2 * k + 1) for k in range(60)]
    body = line(60)
    many = named + [(i, f"{line(3)} {body} {line(i % 4)}") for i in range(1000, 1300)]
    classes = splits.shingle_classes(docs(many), similar=0.5)[1]
    found = splits.connecting_edges(classes, 0.5, pairs=2)
    roots = lambda e: sorted((r.node, r.cluster_id) for r in graph.clusters(docs(many).selectExpr("doc_id as node"), e.selectExpr("a as src", "b as dst")).collect())
    assert roots(found) == roots(splits.class_edges(classes, 0.5)) == sorted([(i, i - i % 2) for i in range(120)] + [(i, 1000) for i in range(1000, 1300)])
    assert found.count() < 60 + 3 * 300 and found.count() == found.select("a", "b").distinct().count()

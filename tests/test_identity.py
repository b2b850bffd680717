import itertools
import random

import pytest

from prismata.operators import graph, splits
from prismata.operators import labels as labels_op
from prismata.plans import registry

labels = registry.labels


def texts():
    """More than 50 equal texts, near copies of them, and a very frequent passage."""
    turn = random.Random(5)
    line = lambda n: " ".join(turn.choice("abcdefghijklmnop") + turn.choice("abcdefgh") for _ in range(n))
    one, often = line(40), line(30)
    out = [one] * 60 + [f"{one} {line(3)}" for _ in range(20)] + [f"{often} {line(turn.randint(1, 60))}" for _ in range(70)]
    return out + [line(40) for _ in range(10)] + ["", "a b", None, "a b c", "a b c", "a  b", "a\nb c\nd e", "a\nb c\nd e", "a b c\nd e f g"]


def slow_edges(named, similar):
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in named if t is not None for w in [t.split(" ")]}
    out = {}
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        both = len(sets[a] & sets[b])
        if both >= similar * (len(sets[a]) + len(sets[b]) - both):
            out[a, b] = round(both / (len(sets[a]) + len(sets[b]) - both), 6)
    return out


def slow_classes(named):
    """The first text with the same shingles, for each that has any."""
    first, out = {}, {}
    for i, t in named:
        w = (t or "").split(" ")
        key = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        if key:
            out[i] = first.setdefault(key, i)
    return out


@pytest.mark.parametrize("similar, chunk", [(0.5, 1024), (0.5, 7), (0.7, 16), (1.0, 16)])
def test_edges_have_no_bound(spark, similar, chunk):
    named = list(enumerate(texts()))
    docs = spark.createDataFrame(named, "doc_id long, text string").repartition(3)
    pairs, classes = slow_edges(named, similar), slow_classes(named)
    want = {(a, b): s for (a, b), s in pairs.items() if classes[a] == a and classes[b] == b} | {(c, i): 1.0 for i, c in classes.items() if c != i}
    got = splits.shingle_edges(docs, similar, chunk=chunk).collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.similarity for r in got} == pytest.approx(want)
    nodes = docs.select(docs.doc_id.alias("node"))
    clusters = lambda e: {r.node: r.cluster_id for r in graph.clusters(nodes, e).collect()}
    assert clusters(splits.shingle_edges(docs, similar, chunk=chunk)) == clusters(spark.createDataFrame(list(pairs), "src long, dst long"))
    few = splits.shingle_edges(docs, similar, chunk=chunk, connecting=True)
    assert clusters(few) == clusters(spark.createDataFrame(list(pairs), "src long, dst long"))
    assert {(r.src, r.dst): r.similarity for r in few.collect()}.items() <= {k: pytest.approx(v) for k, v in want.items()}.items()
    assert splits.shingle_edges(docs.limit(0), similar).count() == splits.shingle_edges(docs.limit(0), similar, connecting=True).count() == 0


def test_near_copies_make_few_links(spark):
    """Copies of a text with words of their own: links grow with the copies, and not with their pairs."""
    turn = random.Random(7)
    line = lambda n: " ".join(f"{turn.choice('abcdefgh')}{turn.randrange(300)}" for _ in range(n))
    bodies = [line(60) for _ in range(3)]
    named = [(i, f"{line(3)} {bodies[i % 3]} {line(i % 5)}") for i in range(2400)]
    docs = spark.createDataFrame(named, "doc_id long, text string").repartition(4)
    members, classes = splits.shingle_classes(docs)
    found = splits.connecting_edges(classes, 0.7)
    assert found.count() < 4 * len(named)
    roots = {r.node: r.root for r in graph.components(found.select("a", "b")).collect()}
    assert len(roots) == len(named) and all(len({roots[i] for i, _ in named if i % 3 == k}) == 1 for k in range(3)) and len(set(roots.values())) == 3


def test_copies_stay_in_one_fold(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts())], "doc_id long, text string, lang string")
    monkeypatch.setattr(labels, "view", lambda *_: docs)
    clusters, folds = labels.doc_folds(spark, str(tmp_path))
    placed = {r.node: r.fold for r in clusters.join(folds, "cluster_id").collect()}
    assert len({placed[i] for i in range(60)}) == 1


def slow_representatives(order, links):
    out = {}
    for x in order:
        out[x] = next((y for y in order if out.get(y) == y and ((x, y) in links or (y, x) in links)), x)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_representatives(spark, seed):
    turn = random.Random(seed)
    links = {(a, b) for a, b in ((turn.randrange(60), turn.randrange(60)) for _ in range(70)) if a != b} | {(i, i + 1) for i in range(60, 80)}
    order = list(range(85))
    turn.shuffle(order)
    nodes = spark.createDataFrame([(x, f"{i:04}") for i, x in enumerate(order)], "node long, turn string")
    got = graph.representatives(nodes, spark.createDataFrame(list(links), "src long, dst long")).collect()
    assert {r.node: r.representative for r in got} == slow_representatives(order, links) and len(got) == 85
    alone = graph.representatives(nodes, spark.createDataFrame([], "src long, dst long")).collect()
    assert all(r.node == r.representative for r in alone) and len(alone) == 85


def test_representatives_of_texts(spark):
    named = list(enumerate(texts()))
    docs = spark.createDataFrame(named, "doc_id long, text string")
    pairs, classes = slow_edges(named, 0.5), slow_classes(named)
    size = {i: len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) for i, t in named for w in [(t or "").split(" ")]}
    firsts = sorted({c for c in classes.values()}, key=lambda c: (-size[c], c))
    rep = slow_representatives(firsts, set(pairs))
    got = {r.doc_id: r.representative for r in splits.shingle_representatives(docs, 0.5).collect()}
    assert got == {i: rep[classes[i]] if i in classes else i for i, _ in named}


def test_numbers_of_many_rows(spark):
    """Over several ranges, with a column that only one of the plan's branches needs."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(300_000).selectExpr("md5(cast(id as string)) as k", "id as payload", "id as _part", "repeat('x', 50) as y")
        got = labels_op.numbered(rows, "k", "idx")
        assert got.columns == [*rows.columns, "idx"]
        low, high, n = got.selectExpr("min(idx)", "max(idx)", "count(distinct idx)").first()
        assert (low, high, n) == (0, 299_999, 300_000)
        assert got.selectExpr("idx - (row_number() over (order by k) - 1) as off").where("off != 0").count() == 0
        assert got.selectExpr("sum(payload) - sum(_part)").first()[0] == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

import random

from prismata.operators import shingles, splits


def test_shared_shingles_of_many_buckets(spark, monkeypatch):
    """Classes, their sizes and the counts of shared shingles, by buckets of a few; doc_ids with more texts or repeated rows."""
    monkeypatch.setattr(shingles, "GRAMS", 50)
    monkeypatch.setattr(shingles, "PART", 300)
    turn = random.Random(6)
    line = lambda n: " ".join(turn.choice(["a", "bé", "", "c\n", "d"]) for _ in range(n))
    rows = [(i, line(turn.randrange(30))) for i in range(-20, 60)]
    rows += [(i + 100, t) for i, t in rows[:30]] + rows[:9] + [(200, None), (201, ""), (None, "a a a a"), (5, "x y z x y z"), (2**40, "x y z x y z x")]
    sets = [(i, frozenset(tuple(w[k : k + 3]) for w in [t.split(" ")] for k in range(len(w) - 2))) for i, t in rows if i is not None and t]
    first = {}
    for i, g in sets:
        if g:
            first[g] = min(first.get(g, i), i)
    members, classes = splits.shingle_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, r["class"], r.n) for r in members.collect()} == {(i, first[g], len(g)) for i, g in sets if g}
    got = {r["class"]: (r.n, [x.df for x in r.g], [x.h for x in r.g]) for r in classes.collect()}
    assert classes.count() == len(got)
    chosen = {}
    for c in set(first.values()):
        own = [g for g, x in first.items() if x == c]
        chosen[c] = next(g for g in own if len(own) == 1 or len(g) == got.get(c, (3,))[0])  # "x y z x y z" shares nothing
    df = {}
    for g in chosen.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    assert {c: (n, sorted(d)) for c, (n, d, _) in got.items()} == {c: (len(g), sorted(df[x] for x in g if df[x] > 1)) for c, g in chosen.items() if any(df[x] > 1 for x in g)}
    assert all(d == sorted(d) for _, d, _ in got.values())
    names = {}
    for _, d, h in got.values():
        for x, y in zip(h, d):
            assert names.setdefault(x, y) == y
    assert len(names) == sum(n > 1 for n in df.values())


def test_tasks_get_packed_shingles(spark):
    """No plan has a row for each shingle of a text: what is written of unique texts is a few values."""
    turn = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(str(turn.random()) for _ in range(400))) for i in range(50)], "doc_id long, text string")
    found = shingles.sized(docs, 3)
    assert set(found.columns) == {"doc_id", "key", "n"} and {r.n for r in found.collect()} == {398}
    assert splits.shingle_classes(docs)[1].count() == 0


def test_room_of_a_shingle_does_not_grow_with_the_buckets():
    """Hashes and classes that are sent together take as much in 64 buckets as in one."""
    import numpy as np

    _, _, unpacked, dealt = shingles.tools(3)
    turn = np.random.default_rng(1)
    h, c = np.sort(turn.integers(0, 1 << 64, 1 << 18, np.uint64)), turn.integers(0, 60_000, 1 << 18).astype(np.uint64)
    room = {}
    for buckets in (1, 64):
        to, blobs = dealt(((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), h, c)
        assert to == list(range(buckets))
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*(unpacked(b, 2) for b in blobs)), (h, c)))
        room[buckets] = sum(map(len, blobs)) / len(h)
    assert room[64] < 9.5 and room[64] < 1.05 * room[1]


def test_classes_that_share_too_few_are_left_out(spark, monkeypatch):
    """Only what can be in a pair is written, and shingles have small numbers; ids may be negative."""
    monkeypatch.setattr(shingles, "GRAMS", 64)
    turn = random.Random(4)
    line = lambda n: " ".join(str(turn.random()) for _ in range(n))
    body, often = line(40), line(6)
    rows = [(i, f"{body} {line(3)}") for i in range(-10, 10)] + [(i, f"{line(40)} {often}") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every, some = (splits.shingle_classes(docs, similar=x)[1].collect() for x in (0.0, 0.5))
    assert {r["class"] for r in every} == {i for i, _ in rows} and {r["class"] for r in some} == set(range(-10, 10))
    assert sorted(some) == sorted(r for r in every if r["class"] < 10)
    assert all(0 <= x.h < 10_000 for r in every for x in r.g)

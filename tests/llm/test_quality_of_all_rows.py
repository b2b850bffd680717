import numpy as np

from prismata.llm import quality


def drawn(turn, n):
    return " ".join(turn.choice(["stone", "river", "quiet", "market", "a", "of", "BUY!!", "12"], n))


def test_every_labelled_row_teaches(spark):
    """Bin edges, cut and weights are of all labelled rows, however many, and don't depend on how they are stored."""
    turn = np.random.default_rng(6)
    rows = [(i, drawn(turn, int(turn.integers(1, 12)) + 6 * (i % 2)) + (" stone" * 3 if i % 2 else ""), i % 2) for i in range(9500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    x = np.array([quality.features(r[1].encode()) for r in rows])
    for i in range(len(quality.NAMES)):
        want = np.unique(np.quantile(x[:, i], np.linspace(0, 1, quality.BINS + 1)[1:-1]))
        assert len(want) == len(model.edges[i]) and np.allclose(want, model.edges[i], rtol=1e-12, atol=1e-12)
    y = np.array([r[2] for r in rows])
    raw = model.raw(x, quality.word_shares([r[1].encode() for r in rows]))
    fair = lambda cut: ((raw[y == 1] >= cut).mean() + (raw[y == 0] < cut).mean()) / 2
    assert fair(model.cut) >= max(fair(c) for c in np.quantile(raw, np.linspace(0.002, 0.998, 499))) - 1e-3
    assert abs(model.scale - raw.std() / 2) < 1e-4 * model.scale
    again = quality.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.weight, again.weight) and np.array_equal(model.words, again.words) and abs(model.cut - again.cut) < 1e-9


def test_blocks_and_rare_classes(spark):
    """Many blocks learn as well as one, and a class with fewer rows than blocks is in all of them."""
    turn = np.random.default_rng(7)
    good = [(i, " ".join(turn.choice(["stone", "river", "quiet", "market"], 20)), 1) for i in range(600)]
    bad = [(600 + i, " ".join(turn.choice(["BUY!!", "$$$", "click", "river"], 20)), 0) for i in range(5)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad], "doc_id bigint, quality int")
    model = quality.train(docs, labels, block=50)
    got = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in good]) > 0.97 and all(got[r[0]] == 0 for r in bad)
    packed = quality.dealt(quality.featured(docs.join(labels, "doc_id").selectExpr("*", "1L as own"), ["doc_id", "quality", "own"]), {1: 600, 0: 5}, 12).collect()
    ys = [np.frombuffer(r.y, np.int8) for r in packed]
    assert len(packed) == 12 and all((y % 2 == 0).any() and (y % 2 == 1).any() for y in ys) and sum((y < 2).sum() for y in ys) == 605


def test_pairs_hold_every_row():
    turn = np.random.default_rng(1)
    seen = []

    class Noted:
        def permutation(self, x):
            seen.extend(x)
            return turn.permutation(x)

    model = quality.Model([np.zeros(0)] * len(quality.NAMES), np.zeros(len(quality.NAMES) * quality.BINS), np.zeros(quality.WORD_BUCKETS))
    shares = np.eye(50, quality.WORD_BUCKETS, dtype=np.float32)
    place = np.tile(np.arange(len(quality.NAMES)) * quality.BINS, (50, 1))
    _, words = quality.taught(model, place, shares, np.arange(40), np.arange(40, 50), 40, 0.2, Noted())
    assert set(seen) == set(range(50)) and (words[:40] > 0).all() and (words[40:50] < 0).all()

from prismata.operators import splits
from prismata.plans import registry

labels = registry.labels


def test_all_folds_are_returned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("en", "de")[i % 2], "web") for i in range(24)], "doc_id long, lang string, source string")
    clusters = spark.createDataFrame([(i, i // 2) for i in range(24)], "node long, cluster_id long")
    folds = spark.createDataFrame([(c, c % 3) for c in range(12)], "cluster_id long, fold int")
    monkeypatch.setattr(labels, "view", lambda *_: docs)
    monkeypatch.setattr(labels, "doc_folds", lambda *_: (clusters, folds))
    rows = labels.fold_splits(spark, "").collect()
    for f in range(3):
        own = {r.accession for r in rows if r.fold == f and r.split == "test"}
        assert own == {i for i in range(24) if i // 2 % 3 == f}
        assert {r.accession for r in rows if r.fold == f and r.split != "test"} == set(range(24)) - own
        members = docs.selectExpr("doc_id AS accession", "concat_ws('.', lang, source) AS ec")
        want = splits.fold_members(members, clusters, folds, f, 3, 3, labels.SEED).collect()
        assert sorted((r.split, r.ec, r.accession) for r in rows if r.fold == f) == sorted(map(tuple, want))


def test_folds_by_size_and_labels(spark):
    """Sizes count entries, also those of several labels or none."""
    import random

    turn = random.Random(3)
    sizes = {c: turn.randint(1, 9) for c in range(60)}
    counts = {c: {k: turn.randint(1, n) for k in turn.sample("abc", turn.randint(0, 3))} for c, n in sizes.items()}
    histogram = spark.createDataFrame([(c, k, n) for c, v in counts.items() for k, n in v.items()], "cluster_id long, label string, n long")
    found = splits.assign_folds(histogram, 3, spark.createDataFrame(list(sizes.items()), "cluster_id long, size long"))
    have, held, want = [dict() for _ in range(3)], [0] * 3, {}
    target = {k: sum(v.get(k, 0) for v in counts.values()) / 3 for k in "abc"}
    for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c))):

        def cost(f, c=c):
            keys = set(have[f]) | set(counts[c])
            return round(sum((have[f].get(k, 0) + counts[c].get(k, 0) - target[k]) ** 2 for k in keys) + (held[f] + sizes[c] - sum(sizes.values()) / 3) ** 2, 6), held[f], f

        want[c] = i if i < 3 else min(cost(f) for f in range(3))[2]
        held[want[c]] += sizes[c]
        for k, n in counts[c].items():
            have[want[c]][k] = have[want[c]].get(k, 0) + n
    assert {r.cluster_id: r.fold for r in found.collect()} == want

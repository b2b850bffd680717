"""Scenarios of few-shot evaluation and sampling, and checks of sequential operators against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.functions import augment
from prismata.functions import vectors as vec
from prismata.operators import benchmark, episodes, graph, kmeans, labels, reports, scoring, settings, splits, training
from prismata.sources import readers, writers


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def small(spark):
    v = rows(spark, [("x1", [1.0, 0.0]), ("x2", [0.6, 0.8])], "accession string, vec array<double>")
    bank = rows(spark, [("A", 0, [1.0, 0.0], 2), ("B", 0, [0.0, 1.0], 1)], "ec string, proto_id int, vec array<double>, train_count int")
    truth = rows(spark, [("x1", "A"), ("x2", "A"), ("x2", "B")], "accession string, ec string")
    return v, bank, truth


@pytest.mark.parametrize("tau, recall", [(0.5, 1.0), (0.7, 0.75)])
def test_thresholds_and_ensured_best_class(small, tau, recall):
    v, bank, truth = small
    decided = scoring.judged(scoring.decide(scoring.logits(scoring.cosines(v, bank)), tau), truth)
    assert scoring.micro_macro(scoring.per_class(decided)).first().macro_recall == recall
    assert scoring.coverage(scoring.answerable(truth, truth, v, bank)).first().coverage == 1.0


def test_queries_without_known_labels(spark, small):
    v, bank, _ = small
    truth = rows(spark, [("x1", "C"), ("x2", "D")], "accession string, ec string")
    c = scoring.coverage(scoring.answerable(truth, truth, v, bank)).first()
    assert (c.queries_covered, c.missing_labels, c.coverage) == (0, 2, 0.0)
    nothing = scoring.judged(scoring.decide(scoring.logits(scoring.cosines(v.limit(0), bank)), 0.5), truth)
    assert scoring.micro_macro(scoring.per_class(nothing)).first().micro_f1 == 0.0
    assert scoring.cosines(v, bank.limit(0)).count() == 0


def test_prototypes_of_multi_label_members(spark):
    v = rows(spark, [("x1", [1.0, 0.0]), ("x2", [0.0, 1.0]), ("x3", [1.0, 1.0])], "accession string, vec array<double>")
    m = rows(spark, [("A", "x1"), ("A", "x2"), ("B", "x1"), ("B", "x3"), ("B", "none")], "ec string, accession string")
    bank = {r.ec: r for r in scoring.prototypes(v, m).collect()}
    assert {k: r.train_count for k, r in bank.items()} == {"A": 2, "B": 2}
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in bank.values())
    two = kmeans.sub_prototypes(v, m, 2).collect()
    assert sorted((r.ec, r.proto_id) for r in two) == [("A", 0), ("A", 1), ("B", 0), ("B", 1)]
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in two)


def test_blocks_of_prototypes_change_nothing(spark):
    turn = np.random.default_rng(0)
    v = rows(spark, [(f"q{i}", turn.normal(size=8).tolist()) for i in range(20)], "accession string, vec array<double>")
    bank = rows(spark, [(f"c{i % 5}", i, turn.normal(size=8).tolist()) for i in range(15)], "ec string, proto_id int, vec array<double>")
    a, b = (sorted(map(str, scoring.cosines(v, bank, n).withColumn("cos", F.round("cos", 9)).collect())) for n in (1 << 20, 200))
    assert a == b and len(a) == 300


def members(spark, **classes):
    return rows(spark, [(k, a) for k, v in classes.items() for a in v], "ec string, accession string")


def test_single_cluster_classes_are_skipped(spark):
    m = members(spark, A=["a1", "a2", "a3"], B=["b1", "b2"])
    c = rows(spark, [("a1", "ca1"), ("a2", "ca2"), ("a3", "ca3"), ("b1", "cb"), ("b2", "cb")], "accession string, cluster_id string")
    chosen = episodes.pick_classes(m, 20, 1, 1, 1, seed=123, clusters=c)
    assert {r.ec for r in chosen.collect()} == {"A"}
    s = episodes.disjoint(chosen, m, c, 1, 1, 123).collect()
    for e in range(20):
        own = [r for r in s if r.episode == e]
        assert {r.role for r in own} == {"support", "query"} and len({r.cluster_id for r in own}) == 2


def test_infeasible_episodes_are_not_given(spark):
    m = members(spark, C=["c1", "c2"])
    c = rows(spark, [("c1", "k"), ("c2", "k")], "accession string, cluster_id string")
    assert episodes.pick_classes(m, 5, 1, 1, 1, seed=7, clusters=c).count() == 0


def test_repeats_fill_small_classes(spark):
    m = members(spark, A=["a1", "a2"])
    chosen = episodes.pick_classes(m, 1, 1, 2, 2, seed=1)
    s = episodes.with_repeats(chosen, m, 2, 2, 1)
    use = episodes.usage(m, s, 2, 2).first()
    assert (use.support_count, use.query_count, use.fallback_episodes) == (2, 2, 1)
    assert sorted(r.occurrence for r in s.collect() if r.accession == "a1")[0] == 1
    assert episodes.pick_classes(m, 1, 1, 2, 2, seed=1, tail=False).count() == 0


def test_coverage_counts_tail_classes(spark):
    m = members(spark, A=["a1", "a2", "a3"], B=["b1"])
    assert tuple(episodes.coverage(m, 1, 2).first()) == (2, 1, 1, 0)


def test_episodes_do_not_depend_on_partitioning(spark):
    m = members(spark, **{f"c{i}": [f"m{i}_{j}" for j in range(4 + i % 6)] for i in range(12)})
    draw = lambda x: sorted(map(str, episodes.standard(episodes.pick_classes(x, 8, 4, 2, 2, 5), x, 2, 2, 5).collect()))
    assert draw(m.repartition(1)) == draw(m.repartition(7))


def test_top_up_equals_choosing_in_turn(spark):
    turn = random.Random(4)
    counts = [(f"c{i}", turn.randint(0, 6)) for i in range(15)]
    pool = [(f"c{turn.randint(0, 14)}", f"a{turn.randint(0, 40):02}") for _ in range(150)]
    used = [(f"a{i:02}",) for i in range(0, 40, 9)]
    want, taken = set(), {u for (u,) in used}
    for ec, n in sorted(counts, key=lambda x: (x[1], x[0])):
        for a in sorted({a for e, a in pool if e == ec} - taken)[: max(0, min(5 - n, 3))]:
            want.add((ec, a))
            taken.add(a)
    got = splits.top_up(rows(spark, counts, "ec string, n int"), rows(spark, pool, "ec string, accession string"), rows(spark, used, "accession string"), 5, 3)
    assert {tuple(r) for r in got.collect()} == want


def test_folds_equal_greedy_assignment(spark):
    turn = random.Random(2)
    histogram = [(f"k{i:03}", f"l{j}", turn.randint(1, 5)) for i in range(80) for j in turn.sample(range(6), 2)]
    folds, sizes, total = 4, {}, {}
    for k, j, n in histogram:
        sizes[k] = sizes.get(k, 0) + n
        total[j] = total.get(j, 0) + n
    have, size, want = [{} for _ in range(folds)], [0] * folds, {}
    for i, k in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k))):
        own = {j: n for c, j, n in histogram if c == k}
        cost = lambda f: sum((have[f].get(j, 0) + own.get(j, 0) - total[j] / folds) ** 2 for j in total if have[f].get(j, 0) or own.get(j, 0)) + (size[f] + sizes[k] - sum(total.values()) / folds) ** 2  # noqa: B023, E731
        f = i if i < folds else min(range(folds), key=lambda f: (cost(f), size[f], f))
        want[k] = f
        size[f] += sizes[k]
        for j, n in own.items():
            have[f][j] = have[f].get(j, 0) + n
    got = splits.assign_folds(rows(spark, histogram, "cluster_id string, label string, n int"), folds)
    assert {r.cluster_id: r.fold for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components_equal_union_find(spark, kind):
    turn = random.Random(6)
    n = 300
    edges = {"random": [(turn.randrange(n), turn.randrange(n)) for _ in range(220)], "chain": [(i, i + 1) for i in range(0, 150)], "star": [(7, i) for i in range(0, 200, 3)], "none": []}[kind]
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = graph.clusters(spark.range(n).withColumnRenamed("id", "node"), rows(spark, edges, "src bigint, dst bigint"))
    assert {r.node: r.cluster_id for r in got.collect()} == {i: find(i) for i in range(n)}


def test_split_sizes():
    assert [splits.split_bounds(n) for n in (0, 1, 2, 3, 5, 10, 25)] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (3, 1, 1), (8, 1, 1), (20, 2, 3)]


def test_holdout_covers_every_class_once(spark):
    m = members(spark, **{f"c{i}": [f"a{i}_{j}" for j in range(1 + i % 5)] for i in range(30)})
    got = splits.holdout_split(m, 3, 9).collect()
    assert len(got) == 30 and len({r.ec for r in got}) == 30
    assert all(r.split == "test" for r in got if int(r.ec[1:]) % 5 < 2)


def test_early_stopping_and_training_slope():
    assert training.early_stop([0.1, 0.2, 0.2005, 0.19, 0.2004], 3, 0.01) == (1, 4)
    assert training.early_stop([0.1, 0.2, 0.3], 2, 0.0) == (2, 2)
    turn = np.random.default_rng(0)
    w, x, y = turn.normal(size=(3, 5)), (turn.normal(size=(4, 5)), turn.normal(size=(6, 5))), (np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1, 1, 0]))
    loss, slope = training.loss_and_slope(w, x, y, 2)
    for i, j in ((0, 0), (1, 3), (2, 4)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        near = (training.loss_and_slope(w + d, x, y, 2)[0] - training.loss_and_slope(w - d, x, y, 2)[0]) / 2e-6
        assert abs(near - slope[i, j]) < 1e-5


@pytest.mark.parametrize("multi", [True, False])
def test_training_slope_with_levels(multi):
    turn = np.random.default_rng(1)
    w, x = turn.normal(size=(3, 5)), (turn.normal(size=(6, 5)), turn.normal(size=(4, 5)))
    own = np.array([[1.0, 0, 1], [0, 1, 0], [0, 0, 1], [0, 0, 0]]) if multi else np.array([0, 1, 2, 2])
    y, codes = (np.array([0, 0, 1, 1, 2, 2]), own), ["1.2.3.4", "1.2.5.1", "1.3.1.1"]  # one code at the first level
    loss, slope = training.with_levels(w, x, y, codes, 3, 0.5)
    coarse = np.stack([own[:, :2].max(axis=1), own[:, 2]], axis=1) if multi else np.array([0, 0, 1, 1])
    parts = [training.loss_and_slope(w, x, y, 3)[0], 0.5 / 3 * training.loss_and_slope(w, x, (np.array([0, 0, 0, 0, 1, 1]), coarse), 2)[0], 0.5 / 3 * training.loss_and_slope(w, x, y, 3)[0]]
    assert abs(loss - sum(parts)) < 1e-12
    for i, j in ((0, 0), (1, 3), (2, 4)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        near = (training.with_levels(w + d, x, y, codes, 3, 0.5)[0] - training.with_levels(w - d, x, y, codes, 3, 0.5)[0]) / 2e-6
        assert abs(near - slope[i, j]) < 1e-5


def test_adam_steps():
    adam, mean, square = training.Adam(0.1), 0.0, 0.0
    for t, g in enumerate([1.0, -2.0, 0.5], 1):
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        assert abs(adam.step(g) - 0.1 * (mean / (1 - 0.9**t)) / (math.sqrt(square / (1 - 0.999**t)) + 1e-8)) < 1e-12


def test_training_checks_and_stops(spark):
    turn = np.random.default_rng(2)
    centre = {c: turn.normal(size=6) for c in "ABCD"}
    v = rows(spark, [(f"{c}{i}", (m + turn.normal(0, 0.3, 6)).tolist()) for c, m in centre.items() for i in range(8)], "accession string, vec array<double>")
    m = members(spark, **{c: [f"{c}{i}" for i in range(8)] for c in "ABCD"})
    draw = lambda n, seed: episodes.standard(episodes.pick_classes(m, n, 3, 2, 3, seed), m, 2, 3, seed)
    first = training.train(draw(30, 1), v, 4, 0.01, validation=draw(5, 2), every=4, patience=2, at_once=7)
    again = training.train(draw(30, 1), v, 4, 0.01, validation=draw(5, 2), every=4, patience=2, at_once=30)
    assert first.losses == again.losses and first.checks == again.checks and (first.weights == again.weights).all()
    values = [a for _, a in first.checks]
    at, stop = training.early_stop(values, 2, 1e-3)
    assert stop == len(values) - 1 and [n for n, _ in first.checks][:-1] == [4 * i + 4 for i in range(len(values) - 1)]
    assert (len(first.losses) == 30) or len(values) - at == 3
    assert training.train(draw(0, 1), v, 4).weights is None


def test_drawn_members_are_different_and_all_come_up(spark):
    m = members(spark, A=[f"a{i}" for i in range(9)], B=["b1", "b2"])
    chosen = rows(spark, [(e, c, s) for e in range(200) for s, c in enumerate("AB")], "episode long, ec string, slot int")
    got = episodes.standard(chosen, m, 2, 3, 11).collect()
    by = {}
    for r in got:
        by.setdefault((r.episode, r.ec), []).append(r)
    assert all(len({r.accession for r in x}) == len(x) == (5 if k[1] == "A" else 2) for k, x in by.items()) and len(by) == 400
    assert all(sum(r.role == "support" for r in x) == 2 for x in by.values())
    seen = [r.accession for r in got if r.ec == "A"]
    assert all(80 < seen.count(f"a{i}") < 142 for i in range(9))  # 111 on average


def slow_uniform(seed, *keys):
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:13], 16) / 2**52


def slow_events(n, p, draw, stop, after):
    """Positions of events: each is met after a geometric number of others, the next one can be `after(j)` further on."""
    at, j, out = 0, 0, []
    while True:
        at += min(math.floor(math.log(1 - draw("gap", j)) / math.log(1 - p)), n)
        if at >= stop:
            return out
        out.append(at)
        at, j = at + after(j), j + 1


def slow_views(seq, key, seed):
    seq = seq.upper()
    if len(seq) < 8:
        return seq, seq
    draw = lambda step: lambda name, j: slow_uniform(seed, key, f"{step}-{name}", j)

    def mask(s, p, d):
        span = lambda j: 3 + math.floor(d("span", j) * 6)
        for j, at in enumerate(slow_events(len(s), p, d, len(s), span)):
            s = s[:at] + "X" * len(s[at : at + span(j)]) + s[at + span(j) :]
        return s

    def swap(s, p, d):
        out = list(s)
        for j, at in enumerate(slow_events(len(s), p, d, len(s) - 1, lambda _: 2)):
            to = at + 1 if d("side", j) < 0.5 else max(0, at - 1)
            out[at], out[to] = out[to], out[at]
        return "".join(out)

    def crop(s, d):
        if len(s) <= 120 or d("whether", 0) >= 0.3:
            return s
        n = 80 + math.floor(d("size", 0) * (len(s) - 79))
        at = math.floor(d("place", 0) * (len(s) - n + 1))
        return s[at : at + n]

    a = crop(swap(mask(seq, 0.05, draw("a-mask")), 0.015, draw("a-swap")), draw("a-crop"))
    b = swap(seq, 0.02, draw("b-swap"))
    b = mask(b, 0.04, draw("b-mask")) if draw("b-mask")("whether", 0) < 0.5 else b
    return a, crop(b, draw("b-crop"))


def test_views_equal_their_definition(spark):
    turn = np.random.default_rng(3)
    given = [(f"k{i}", "".join(turn.choice(list("acdefghiklmnpqrstvwy"), n))) for i, n in enumerate([0, 1, 7, 8, 9, 20, 119, 121, 300, 900] * 12)]
    df = rows(spark, [*given, ("none", None)], "key string, seq string")
    got = {r.key: (r.a, r.b) for r in augment.sequence_views(df, "key", "seq", 5).collect()}
    assert got.pop("none") == (None, None)
    assert got == {k: slow_views(s, k, 5) for k, s in given}
    long = [(s.upper(), *got[k]) for k, s in given if len(s) == 900]
    moved = sum(x != y for s, _, b in long if len(b) == 900 and "X" not in b for x, y in zip(s, b))
    assert moved and any("X" in a for _, a, _ in long) and any(len(a) < 900 for _, a, _ in long)


def test_grids():
    g = vec.temperature_grid(1.0)
    assert len(g) == 25 and abs(g[0] - 0.1) < 1e-9 and abs(g[-1] - 10) < 1e-9
    assert vec.steps(0.6, 0.95, 0.01)[-1] == 0.95 and len(vec.steps(0.6, 0.95, 0.01)) == 36


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|X\nAC\nDE \n>empty\n>two words\nGG\n")
    assert sorted(map(tuple, readers.fasta(spark, f"file://{tmp_path}/a.fasta").collect())) == [("P1", "ACDE"), ("two", "GG")]
    (tmp_path / "t.tsv").write_text("Entry\tEC\tLength\nP1\t1.1.1.1; 2.1.1.1\t4\n\t1.1\t2\nP9\tNA\t1\n")
    t = readers.joined_entries(readers.tsv(spark, f"file://{tmp_path}/t.tsv"), readers.fasta(spark, f"file://{tmp_path}/a.fasta"))
    assert [(r.accession, r.ec, r.sequence) for r in t.collect()] == [("P1", "1.1.1.1; 2.1.1.1", "ACDE")]
    (tmp_path / "c.tsv").write_text("a\tk1\n\nshort\nb\tk2\n")
    assert sorted(map(tuple, readers.cluster_map(spark, f"file://{tmp_path}/c.tsv").collect())) == [("a", "k1"), ("b", "k2")]
    with pytest.raises(KeyError):
        labels.normalize(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        readers.vector_width(rows(spark, [([1.0],), ([1.0, 2.0],)], "vec array<double>"))
    writers.cache(rows(spark, [("1.1", "p")], "ec string, accession string"), f"file://{tmp_path}/cache", F.current_timestamp())
    meta = spark.read.parquet(f"file://{tmp_path}/cache/meta").withColumn("ec", F.col("ec").cast("string"))
    kept = spark.read.parquet(f"file://{tmp_path}/cache/rows").withColumn("ec", F.col("ec").cast("string"))
    assert readers.cached(kept, meta, F.current_timestamp() + F.make_interval(days=F.lit(9)), 7).count() == 0
    assert readers.cached(kept, meta, F.current_timestamp() + F.make_interval(days=F.lit(9)), 0).count() == 1


def test_status_lines_and_trends(spark):
    lines = rows(spark, [(1, "t phase=a event=start cutoff=70"), (2, "noise")], "line_no int, line string")
    assert [r["fields"] for r in readers.status(lines).orderBy("line_no").collect()] == [{"phase": "a", "event": "start", "cutoff": "70"}, {}]
    t = rows(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), ("c", 1, 1.0), ("c", 2, 0.0), ("c", 3, 5.0)], "k string, o int, v double")
    assert {r.k: r.trend for r in reports.trend(t, "k", "o", "v").collect()} == {"a": "increases", "b": "stable", "c": "varies"}


def test_the_rest_works_without_the_llm_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['prismata.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship_top1' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_redraws_until_no_class_is_short(spark):
    """A has one cluster per member, B and C are short: episodes of one class are drawn again until A comes."""
    m = rows(spark, [(c, f"{c}{i}") for c in "ABC" for i in range(6)], "ec string, accession string")
    k = rows(spark, [(f"{c}{i}", f"{c}{i if c == 'A' else i % 2}") for c in "ABC" for i in range(6)], "accession string, cluster_id string")
    own, short = episodes.redrawn(m, k, 12, 1, 2, 2, 4)
    own, short = own.collect(), short.collect()
    assert {r.ec for r in own} == {"A"} and {r.ec for r in short} <= {"B", "C"} and all((r.have, r.need) == (2, 4) for r in short)
    for e in {r.episode for r in own}:
        draws = [r for r in own if r.episode == e]
        assert len({r.cluster_id for r in draws}) == 4 and draws[0].attempt == sum(r.episode == e for r in short)
    never = {r.episode for r in short if r.attempt == 9}
    assert {r.episode for r in own} | never == set(range(12)) and not {r.episode for r in own} & never
    report = episodes.shortage_report(None, rows(spark, [tuple(r) for r in short], "attempt int, episode long, ec string, have long, need int")).collect()
    assert sum(r.events for r in report) == len(short) and all(r.dropped <= r.episodes for r in report)
    alone = rows(spark, [("A", "a1")], "ec string, accession string")
    assert [tuple(r) for r in episodes.single_cluster_classes(alone, k).collect()] == [("A", 1)]
    none, lost = episodes.redrawn(m.where("ec != 'A'"), k, 2, 1, 2, 2, 4)
    assert none.count() == 0 and lost.count() == 20 and episodes.shortage_report(none, lost).agg(F.sum("dropped")).first()[0] >= 2


def test_best_or_last(spark):
    score = lambda hit: rows(spark, [(0, "a", 0, s, float(s == hit), int(s == 0)) for s in (0, 1)], "episode int, accession string, own int, slot int, logit double, label int")
    assert tuple(episodes.best_or_last(score(0), score(0)).first()) == (1.0, 1.0, "best")
    assert tuple(episodes.best_or_last(score(1), score(0)).first()) == (0.0, 1.0, "last")
    none = episodes.validation_accuracy(score(0).limit(0)).first()
    assert tuple(none) == (0, 0.0) and episodes.evaluation(score(0).limit(0).withColumn("ec", F.lit("A")), 0.5).first().micro_f1 == 0


def test_choices_of_calibration_and_sources(spark):
    curve = rows(spark, [(0.1, 0.5, 0.3), (0.2, 0.4, 0.3), (0.3, 0.4, 0.2)], "temperature double, bce double, brier double")
    assert [scoring.best_temperature(curve, m, 0.7).first()[0] for m in ("bce", "brier", "none")] == [0.2, 0.3, 0.7]
    own, call = rows(spark, [("A", 0.1), ("B", 0.2)], "ec string, tau double"), rows(spark, [("B", 0.9), ("C", 0.8)], "ec string, tau double")
    assert sorted(map(tuple, scoring.overridden(own, call).collect())) == [("A", 0.1), ("B", 0.9), ("C", 0.8)]
    assert scoring.overridden(None, call) is call and scoring.overridden(own, None) is own
    m, s = rows(spark, [("A", "x"), ("A", "y")], "ec string, accession string"), rows(spark, [("x", "TrEMBL")], "accession string, source string")
    left = lambda source: sorted(r.accession for r in scoring.source_members(m, s, source).collect())
    assert (left("SwissProt"), left("TrEMBL"), left(None), left("Other")) == (["y"], ["x"], ["x", "y"], ["x", "y"])


def test_status_fields_and_values(spark):
    lines = rows(spark, [(1, "t a=1 b=x=y a=2"), (2, None)], "line_no int, line string")
    assert [r["fields"] for r in readers.status(lines).orderBy("line_no").collect()] == [{"a": "2", "b": "x=y"}, None]


def test_stored_tables_and_settings(spark, tmp_path):
    where = lambda name: f"file://{tmp_path}/{name}"
    v = rows(spark, [("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "accession string, vec array<float>")
    writers.vectors(v, where("good"))
    assert readers.matrix(spark, where("good"), 2).count() == 2
    for name, bad in (("twice", v.unionAll(v)), ("none", rows(spark, [(None, [1.0])], v.schema)), ("wide", rows(spark, [("a", [1.0]), ("b", [1.0, 2.0])], v.schema))):
        bad.write.parquet(where(name))
        with pytest.raises(ValueError):
            readers.matrix(spark, where(name))
    with pytest.raises(ValueError):
        readers.matrix(spark, where("good"), 3)
    writers.projection([[1, 2], [3, 4]], [0.5, 0], where("projection"), spark)
    assert readers.projection(spark, where("projection")) == ([[1.0, 2.0], [3.0, 4.0]], [0.5, 0.0])
    (tmp_path / "settings.yaml").write_text("a: 1\nb:\n  - x\n")
    assert readers.config(spark, where("settings.yaml")) == {"a": 1, "b": ["x"]}


def test_benchmark_goes_on_where_it_was(spark, tmp_path):
    asked = []

    def evaluate(cutoff, fold):
        asked.append((cutoff, fold))
        if len(asked) == 3:
            raise RuntimeError("broken off")
        return rows(spark, [("A", "x"), ("B", "x"), ("A", "y")], "ec string, accession string"), rows(spark, [(0.5, None)], "f1 double, other double")

    run = lambda settings: benchmark.run(spark, f"file://{tmp_path}/runs", (30, 50), 2, settings, evaluate).collect()
    with pytest.raises(RuntimeError):
        run({"seed": 1})
    got = run({"seed": 1})
    assert asked == [(30, 0), (30, 1), (50, 0), (50, 0), (50, 1)] and len(got) == 4
    assert got[0].metrics == {"f1": 0.5} and got[0].label_stats == {"rows": 3.0, "entities": 2.0, "multi": 1.0, "classes": 2.0, "multi_ratio": 0.5}
    assert len(run({"seed": 2})) == 4 and len(asked) == 9


def test_settings_are_chosen_in_order():
    assert settings.first_given(None, [], [3, 4], default=5) == 3 and settings.first_given(None, default=5) == 5
    chosen = settings.scoring_settings({"tau_multi": None}, {"tau_multi": 0.5, "temperature": 2.0}, {"temperature": 3.0, "shortlist_topN": 7})
    assert chosen == {"tau_multi": 0.5, "temperature": 2.0, "shortlist_topN": 7}
    assert settings.scoring_settings({}, {"temperature": 2.0}, {}, use_calibration=False)["temperature"] == settings.DEFAULTS["temperature"]
    assert (settings.similarity_cutoff(30), settings.similarity_cutoff("0.3"), settings.similarity_cutoff(1)) == (0.3, 0.3, 1.0)
    assert settings.may_repeat(True, "val", "all") and settings.may_repeat(True, "train", "train_only") and not settings.may_repeat(True, "val", "train_only") and not settings.may_repeat(False, "train", "all")
    same = {"threshold": 0.3, "folds": 5, "definition": "x", "seed": 1}
    assert settings.same_splits(same, same) and not settings.same_splits({}, same) and not settings.same_splits(same | {"seed": 2}, same)
    assert settings.unwrapped({"metrics": {"metrics": {"f1": 1}}}) == {"f1": 1}
    assert (settings.chosen_k(5, [1, 3], [1, 3]), settings.chosen_k(None, [1, 3], [1, 3]), settings.chosen_k(None, [9], [5, 2]), settings.chosen_k(1, [], [])) == (3, 3, 2, None)


@pytest.mark.parametrize("tau, shortlist, temperature", [(0.5, 0, 0.1), (0.5, 3, 0.1), (0.99, 0, 0.5), (0.5, 2, 0.001), (0.0, 0, 1.0)])
@pytest.mark.parametrize("block", [1 << 20, 200])
def test_promising_cells_decide_like_all_cells(spark, tau, shortlist, temperature, block):
    turn = np.random.default_rng(4)
    v = rows(spark, [(f"q{i}", turn.normal(size=4).tolist()) for i in range(15)], "accession string, vec array<double>")
    protos = [(f"c{i % 7}", i, scoring_unit(turn.normal(size=4))) for i in range(11)]
    bank = rows(spark, [*protos, ("d1", 0, protos[0][2]), ("d2", 0, protos[0][2])], "ec string, proto_id int, vec array<double>")  # d1 and d2 tie
    over = rows(spark, [("c1", 0.2), ("d2", 0.9)], "ec string, tau double")
    truth = rows(spark, [(f"q{i}", f"c{i % 9}") for i in range(18)], "accession string, ec string")
    asked = (tau, temperature, shortlist, over)
    every = scoring.judged(scoring.decide(scoring.logits(scoring.cosines(v, bank)), *asked), truth)
    few = scoring.judged(scoring.decide(scoring.promising(v, bank, *asked, block_bytes=block), *asked), truth, v, bank)
    plain = lambda df: sorted((r.accession, r.ec, r.hit, r.true) for r in df.where(F.col("hit") | F.col("true")).collect())
    assert plain(every) == plain(few)
    a, b = (scoring.micro_macro(c).first() for c in (scoring.per_class(every), scoring.all_classes(scoring.per_class(few), bank)))
    assert a == b


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_losses_within_batches(spark, block):
    turn = np.random.default_rng(5)
    v = rows(spark, [(f"q{i}", turn.normal(size=4).tolist()) for i in range(9)], "accession string, vec array<double>")
    bank = rows(spark, [(f"c{i % 4}", i, scoring_unit(turn.normal(size=4))) for i in range(6)], "ec string, proto_id int, vec array<double>")
    truth = rows(spark, [(f"q{i}", f"c{i % 5}") for i in range(7)], "accession string, ec string")
    every = scoring.losses(scoring.judged(scoring.logits(scoring.cosines(v, bank)), truth), [0.1, 1.0])
    both = [sorted(map(tuple, df.collect())) for df in (every, scoring.bank_losses(v, bank, truth, [0.1, 1.0], block))]
    assert np.allclose(both[0], both[1], atol=2e-6)
    none = bank.where("false")
    assert scoring.bank_losses(v, none, truth, [0.1]).count() == 0 and scoring.promising(v, none, 0.5).count() == 0


def scoring_unit(x):
    return (x / np.linalg.norm(x)).tolist()

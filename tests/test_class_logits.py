import random

import pytest

from prismata.operators import scoring


def test_logits_of_large_classes_leave_a_batch_as_sums(spark):
    """Classes that go over several blocks give the logits of all cosines, and no cell of theirs is shuffled."""
    turn = random.Random(2)
    vec = lambda: [turn.gauss(0, 1) for _ in range(5)]
    queries = spark.createDataFrame([(f"q{i}", vec()) for i in range(20)], "accession string, vec array<double>").repartition(3)
    bank = spark.createDataFrame([(f"L{i % 4 if i else 'one'}", i, vec()) for i in range(90)], "ec string, proto_id int, vec array<double>")
    bank = scoring.projected(bank)
    want = {(r.accession, r.ec): r.logit for r in scoring.logits(scoring.cosines(queries, bank)).collect()}
    for size in (200, 1500, 1 << 20):
        got = scoring.class_logits(queries, bank, size).collect()
        assert len(got) == len(want) == 100 and {(r.accession, r.ec): r.logit for r in got} == pytest.approx(want)
    assert scoring.class_logits(queries, bank.limit(0)).count() == scoring.class_logits(queries.limit(0), bank).count() == 0

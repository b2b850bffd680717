import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp bigint, spans string, runs int, n int, keep_id string, bands string, _wanted string, run_doc string, Runs_Found int, removed_doc string"


def ugly_rows():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows and near copies."""
    turn = random.Random(3)
    words = [w + e for w in ("stone", "river", "lantern", "quiet", "market", "window", "copper", "garden", "winter", "signal", "harbor", "ledger") for e in ("", "s", "ed", "ing")]
    line = lambda n: " ".join(turn.choice(words) for _ in range(n))
    passage = [line(60) for _ in range(4)]
    long = "\n".join(line(30) for _ in range(300))
    texts = [None, "", "   \n\t ", "x", "Ünïcödé 東京 ß\u0000 end", "A" * 5000, long, long, long.replace("stone", "stones", 1)]
    texts += [passage[0]] * 6 + [passage[0] + " tail"] * 3
    texts += ["\n".join([line(25), passage[1], passage[2], passage[3], line(25)]) for _ in range(12)]
    texts += ["\n".join(line(12) for _ in range(turn.randint(1, 9))) for _ in range(40)]
    rows = [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], None, len(t or ""), "k", i, "s", 1, 2, "z", "b", "w", "r", 3, None) for i, t in enumerate(texts)]
    rows.append((None, passage[1], *[None] * 14))
    return rows + [rows[20], rows[20]]


@pytest.fixture(scope="session")
def ugly(spark):
    return spark.createDataFrame(ugly_rows(), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def named(ugly):
    """Texts by doc_id, null as empty."""
    return {r.doc_id: (r.text or "") for r in ugly.collect() if r.doc_id is not None}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)

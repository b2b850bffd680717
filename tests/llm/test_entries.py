"""The registered queries on a small table with very long rows, nulls, ties, repeated rows and extra columns."""

import base64
import hashlib

import numpy as np
import pytest

from prismata.llm import queries
from tests.llm.test_duplicates import slow_fingerprint

LONG = 9 << 20  # bytes, over the bound of a batch


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    turn = np.random.default_rng(8)
    words = np.array(["".join(turn.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(5000)])
    line = lambda n: " ".join(turn.choice(words, n))
    lines = "\n".join(line(30) for _ in range(200))
    texts = {1: line(LONG // 8 + 1), 2: lines, 3: lines, 4: None, 5: "", 6: "x", 7: "x", 8: lines + "\nend", 9: " \n\t ", 10: "Ünïcödé 東京 <|endoftext|>", 11: line(40)}
    texts[12] = texts[1]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, "a", "b") for i, t in texts.items()]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([*rows, rows[10]], "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, digest string, row string")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(lines.split()[:20])), (2, "x"), (3, None), (None, "x")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for n in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{n}.parquet").write.parquet(f"{folder}/none/{n}.parquet")
    return str(folder), {k: (v or "").encode() for k, v in texts.items()}


def got(spark, tables, name):
    rows = queries.QUERIES[name](spark, tables[0]).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*tables[1], 11])
    assert queries.QUERIES[name](spark, f"{tables[0]}/none").count() == 0
    return {r.doc_id: r for r in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, tables):
    from tokenizers import Tokenizer

    from prismata.llm import bpe

    library = Tokenizer.from_file(bpe.vocabulary_path())
    for i, r in got(spark, tables, "op1_bpe").items():
        ids = library.encode(tables[1][i].decode(), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))


def test_op3(spark, tables):
    rows = got(spark, tables, "op3_paragraphs")
    whole = {i for i, r in rows.items() if r.n_removed}
    assert whole == {3, 8, 12} and all(r.n_bytes == len(tables[1][i]) for i, r in rows.items())
    assert rows[12].kept_in == [1] and rows[3].kept_in == rows[8].kept_in == [2] and rows[12].n_removed > 0.85 * LONG
    assert rows[3].removed == rows[8].removed


def test_op4(spark, tables):
    for i, r in got(spark, tables, "op4_decontaminate").items():
        hit, items = {2: (20, "1"), 3: (20, "1"), 8: (20, "1"), 6: (1, "2"), 7: (1, "2")}.get(i, (0, ""))
        n = len(tables[1][i].split()) if i not in (10, 9) else {10: 3, 9: 0}[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, int(hit > 0), sha(items.encode()), hit > 0 and 20 * hit >= n)
    near = got(spark, tables, "op4_proximity")
    assert {i: r["items"] for i, r in near.items() if r["items"]} == {2: [1], 3: [1], 8: [1], 6: [2], 7: [2]}


def test_op5(spark, tables):
    groups: dict = {}
    for i, t in [*tables[1].items(), (11, tables[1][11])]:
        groups.setdefault(t, []).append(i)
    for i, r in got(spark, tables, "op5_exact_dedup").items():
        own = groups[tables[1][i]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), i == max(own), sha(tables[1][i]))


@pytest.mark.parametrize("name, pred", [("op6_langid", "lang_pred"), ("op9_quality", "predicted")])
def test_op6_and_op9(spark, tables, name, pred):
    rows = got(spark, tables, name)
    assert all(0 <= r.score <= 1 and r[pred] is not None for r in rows.values())
    same = lambda i, j: (rows[i].score, rows[i][pred]) == (rows[j].score, rows[j][pred])
    assert same(1, 12) and same(2, 3) and same(6, 7) and same(4, 5)


def test_op7(spark, tables):
    for i, r in got(spark, tables, "op7_suffix").items():
        t = tables[1][i]
        kept = {3: b"", 12: b"", 8: b"\nend"}.get(i, t)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), len(t) - len(kept), int(kept != t), sha(kept))


def test_op8(spark, tables):
    rows = got(spark, tables, "op8_simhash")
    prints = {i: slow_fingerprint(t.decode()) for i, t in tables[1].items() if len(t) < LONG}
    assert all(rows[i].fingerprint == f"{p:016x}" for i, p in prints.items())
    near = {i: min(j for j, q in prints.items() if (p ^ q).bit_count() <= 4) for i, p in prints.items()}
    assert all(rows[i].component_id == j for i, j in near.items() if near[j] == j)
    assert rows[12].component_id == 1 and rows[12].fingerprint == rows[1].fingerprint


@pytest.mark.parametrize("name", ["op10_linededup", "op10_linededup_long"])
def test_op10(spark, tables, name):
    long = name.endswith("long")
    for i, r in got(spark, tables, name).items():
        t = tables[1][i]
        kept = {3: b"", 8: b"end"}.get(i, b"" if i == 12 and long else t)
        n = t.count(b"\n") + 1 if i != 4 else 0
        lost = n if kept == b"" and kept != t else n - 1 if kept != t else 0
        assert (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) == (n, lost, int(kept != t), sha(kept))


def test_op12(spark, tables):
    from tests.llm.test_vectors_phrases_audit import brute_collocations

    want = brute_collocations([(t.decode(), "en" if i % 2 else None) for i, t in [*tables[1].items(), (11, tables[1][11])]], 30, 2000)
    assert sorted(map(tuple, queries.QUERIES["op12_phrases"](spark, tables[0]).collect())) == want
    assert queries.QUERIES["op12_phrases"](spark, f"{tables[0]}/none").count() == 0


def test_op13(spark, tables):
    from tests.llm.test_vectors_phrases_audit import brute_audit

    rows = [(i, t.decode(), "en" if i % 2 else None) for i, t in [*tables[1].items(), (11, tables[1][11])]]
    want = brute_audit(rows, {i for i in tables[1] if i % 2}, set())
    assert sorted(map(tuple, queries.QUERIES["op13_filter_audit"](spark, tables[0]).collect())) == want
    assert queries.QUERIES["op13_filter_audit"](spark, f"{tables[0]}/none").count() == 0


def test_base32():
    assert base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"

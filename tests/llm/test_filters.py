import hashlib
import zlib

import numpy as np

from prismata.llm import decontaminate, langid, quality
from prismata.llm.common import quoted
from pyspark.sql import functions as F


def test_contamination(spark, ugly, named, empty):
    items = [(1, named[20]), (2, "x"), (3, ""), (4, None), (None, "x"), (10, " ".join(named[25].split()[5:30])), (11, "signal nowhere")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    known = [(i, (t or "").encode()) for i, t in items if i is not None]
    two = spark.createDataFrame([(20, "x y"), (20, "y x x")], "doc_id bigint, text string")  # a doc_id with other texts
    docs = quoted(ugly, ["doc_id", "text"]).unionByName(two)
    rows = docs.collect()
    want = sorted((str(r.doc_id), *w) for r, w in zip(rows, decontaminate.brute_force([(r.text or "").encode() for r in rows], known)))
    for block in (1 << 20, 100):
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        names = lambda r: hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), names(r), r.contaminated) for r in got) == want
        assert all(r.n_hit == sum(r.spans[1::2]) - sum(r.spans[::2]) for r in got)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(ugly, bench.limit(0)).where("contaminated").count()
    assert decontaminate.decontaminate(ugly, bench).columns == ugly.columns


def test_proximity(spark, ugly, named, empty, tmp_path):
    docs = spark.createDataFrame([(1, "red green blue one two red x blue"), (2, "blue red"), (3, None), (4, "red a b c d blue"), (5, "red"), (6, "blue x red")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "red blue"), (2, "red none"), (3, None), (4, "red")], "item_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.proximity(docs, bench, width=3).collect()}
    assert got == {1: [1, 4], 2: [1, 4], 3: [], 4: [4], 5: [4], 6: [1, 4]}
    turned = named[25].split()
    items = [(1, named[20]), (2, "x"), (3, ""), (10, " ".join(turned[5:30])), (12, " ".join(turned[20:8:-1])), (13, "stone river lantern quiet market")]
    ids = sorted(k for k in named if len(named[k]) < 6000)
    want = dict(zip(ids, decontaminate.brute_near([named[i].encode() for i in ids], [(i, t.encode()) for i, t in items])))
    assert any(12 in x for x in want.values()) and any(13 in x for x in want.values())
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 100):
        got = {r.doc_id: r["items"] for r in decontaminate.proximity(ugly.where(F.col("doc_id").isin(ids)), bench, block_bytes=block).collect()}
        assert got == want
    assert decontaminate.proximity(empty, bench).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id: r["items"] for r in decontaminate.op4_proximity(spark, str(tmp_path)).collect()} == {r.doc_id: r["items"] for r in decontaminate.proximity(docs, bench).collect()}


def sentences(n):
    turn = np.random.default_rng(5)
    stems = {"en": ["the", "and", "thing", "with", "tion", "wh"], "de": ["und", "der", "sch", "ung", "keit", "ein"]}
    return [(i, " ".join("".join(turn.choice(stems[k], 2)) for _ in range(12)), k) for i in range(n) for k in [("en", "de")[i % 2]]]


def test_language(spark, ugly, empty):
    docs = spark.createDataFrame(sentences(400), "doc_id bigint, text string, lang string")
    model = langid.train(docs.where(~langid.held_out(5, 0)), per_language=120)
    got = langid.identify(docs, model).join(docs.where(langid.held_out(5, 0)), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = langid.identify(ugly, model).join(ugly.select("doc_id", "text"), "doc_id").collect()
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in rows)
    assert langid.identify(empty, model).count() == 0 and langid.accepted(ugly, model).columns == ugly.columns
    assert langid.accepted(ugly, model).where("text is null or trim(text) = ''").count() == 0
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(ugly, none).collect()} == {"und"}


def test_quality(spark, ugly, empty):
    turn = np.random.default_rng(2)
    good = [(i, ". ".join(" ".join(turn.choice(["stone", "river", "quiet", "market", "a", "of"], 9)).capitalize() for _ in range(5)) + ".") for i in range(150)]
    bad = [(i + 150, " ".join([str(turn.choice(["BUY!!", "$$$", "click"]))] * 30)) for i in range(150)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels.where(~quality.held_out(3, 1)))
    got = quality.score(docs, model).where(quality.held_out(3, 1)).collect()
    assert np.mean([r.predicted == int(r.doc_id < 150) for r in got]) > 0.97
    rows = quality.score(ugly, model).collect()
    assert len(rows) == ugly.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score(empty, model).count() == 0
    assert {r.predicted for r in quality.score(docs, quality.train(docs, labels.where("quality = 0"))).collect()} == {0}
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == 300


def slow_logits(text, model):
    """The summed logits of all n-grams of all words, letter by letter, and how many there are."""
    total, n = np.zeros(len(model.languages)), 0
    for word in text.translate(langid.TO_WORDS).split():
        letters = b"<" + word + b">"
        for size in langid.GRAMS:
            for i in range(len(letters) - size + 1):
                h = 0
                for c in letters[i : i + size]:
                    h = (h * 0x01000193 + c + 1) % (1 << 32)
                h = (h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)
                total += model.logits[(h ^ h >> 13) % langid.BUCKETS][:-1]
                n += 1
    return total / max(n, 1) + model.bias


def test_language_query_against_brute_force(spark, tmp_path):
    docs = [(i, t, k) for i, t, k in sentences(300)] + [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (903, "x" * 60_000, None), (904, sentences(1)[0][1], None), (904, sentences(1)[0][1], None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "'y' as rejected").write.parquet(f"{tmp_path}/documents.parquet")
    rows = langid.op6_langid(spark, str(tmp_path)).collect()
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet").where(~langid.held_out(5, 0)))
    assert len(rows) == len(docs)
    texts = {i: (t or "").encode() for i, t, _ in docs}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not any(c.isalpha() for c in texts[r.doc_id].decode()):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        z = slow_logits(texts[r.doc_id], model) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(r.score - p.max()) < 1e-6 and r.lang_pred in np.array(model.languages)[p > p.max() - 1e-6]
        assert r.rejected == (r.score < model.threshold)


def test_quality_query_against_brute_force(spark, tmp_path):
    turn = np.random.default_rng(4)
    docs = [(i, " ".join(turn.choice(["stone", "river", "Quiet", "market.", "a", "of"], 40)) if i % 2 else " ".join(turn.choice(["BUY!!", "now", "$$$", "click"], 30))) for i in range(240)]
    docs += [(900, None), (901, ""), (902, "!!! ??? \n" * 20_000), (903, "stone river"), (903, "stone river")]
    spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "2 as score", "3 as predicted").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, None) for i in range(240)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op9_quality(spark, str(tmp_path)).collect()
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    model = quality.train(read("documents"), read("labels").where(~quality.held_out(3, 1)))
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        raw = sum(model.weight[i * quality.BINS + int(np.searchsorted(e, v, "right"))] for i, (e, v) in enumerate(zip(model.edges, quality.features(text))))
        share: dict = {}
        for w in text.lower().split():
            b = int(quality.word_shares([w])[0].argmax())
            share[b] = share.get(b, 0) + 1
        raw += sum(model.words[b] * n for b, n in share.items()) / max(1e-12, sum(n * n for n in share.values()) ** 0.5)
        want = 1 / (1 + np.exp(-np.clip((raw - model.cut) / model.scale, -60, 60)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.held_out and r.doc_id < 240]) > 0.97


def test_clean_rows_stay_where_doc_ids_repeat(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage), (1, "clean words here"), (2, "clean words here"), (None, passage), (None, "more clean words"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(7, passage)], "item_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))

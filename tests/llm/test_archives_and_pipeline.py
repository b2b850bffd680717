import base64
import gzip
import hashlib
import os

import pytest

import corpus_pipeline
from prismata.llm import decontaminate, langid, linededup, simhash, warc


def write_table(df, folder, name):
    df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")


def test_archives(spark, tmp_path):
    pages = [(1, "http://a.b/c", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a.b/\r\nc", None), (4, "", ""), (5, "http://ü.x/", "é\r\n\r\nWARC/1.1\r\n\r\n" * 3), (6, "http://a.b", "<p>x</p>"), (6, "http://a.b", "<p>x</p>")]
    pages += [(None, "http://a.b", "<p>x</p>"), (None, None, "only here"), (None, None, "only here"), (8, "http://long.x", "ab\r\n" * 3_000_000), (9, "http://long.x", "ab\r\n" * 3_000_000)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "'x' as first", "2 as bytes", "null as record_id")
    write_table(table, tmp_path, "pages")
    rows = [tuple(r) for r in warc.op2_warc(spark, str(tmp_path)).collect()]
    assert len(rows) == len(pages) and rows.count(next(r for r in rows if r[0] == 6)) == 2
    assert sorted(r[1:2] + r[3:] for r in rows if r[0] is None) == [(8, "revisit", 1), (9, "response", None), (9, "response", None)]
    got = {r[0]: r[1:] for r in rows if r[0] is not None}
    first = {}
    want = {}
    for i, _, html in (p for p in pages if p[0] is not None):
        data = (html or "").encode()
        kept = first.setdefault(data, i)
        want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if kept == i else "revisit", None if kept == i else kept)
    assert got == want
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    rows = warc.captures(warc.read_archives(spark, path)).collect()
    assert all(r.request.type == "request" and r.metadata.type == "metadata" for r in rows)
    assert sorted(bytes(r.payload or b"").decode() for r in rows if r.type == "response") == sorted({h or "" for _, _, h in pages})
    write_table(table.limit(0), tmp_path / "none", "pages")
    assert warc.op2_warc(spark, str(tmp_path / "none")).count() == 0


def test_parse_members_and_broken_archives():
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 3\r\n\r\na\r\n\r\n\r\n"
    data = b"".join(gzip.compress(one % i) for i in range(3))
    assert [f["warc-record-id"] for f, _ in warc.parse(data)] == [f"<urn:x:{i}>" for i in range(3)]
    assert list(warc.parse(b"")) == []
    many = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, 5000 * i, b"ab\r\n\r" * 1000 * i) for i in range(120))
    for data in (many, gzip.compress(many)):  # plain, and one member of several MB
        assert [(f["warc-record-id"], len(b)) for f, b in warc.parse(data)] == [(f"<urn:x:{i}>", 5000 * i) for i in range(120)]
    with pytest.raises(ValueError):
        list(warc.parse(one % 1 + b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab"))


def test_concurrent_records_in_either_direction(spark):
    names = [x.split()[0] for x in warc.RECORDS.split(", ")]
    row = lambda **k: tuple(k.get(n) for n in names)
    records = spark.createDataFrame(
        [row(record_id="r1", type="response", concurrent_to="q1"), row(record_id="q1", type="request"), row(record_id="m1", type="metadata", concurrent_to="q1"), row(record_id="r2", type="response"), row(record_id="q2", type="request", concurrent_to="r2"), row(record_id="lost", type="metadata", concurrent_to="none"), row(type="response")],
        warc.RECORDS,
    )
    found = {r.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.captures(records).collect()}
    assert found == {"r1": ("q1", "m1"), "r2": ("q2", None)}


def test_pipeline_against_its_stages(spark, ugly, named, tmp_path):
    """run() against plain versions of the stages, row by row: what each keeps is worked out text by text. Rows share doc_ids, or have none."""
    from collections import Counter

    import xxhash

    from tests.llm.test_duplicates import joined, slow_fingerprint, slow_lines

    docs = ugly.select("doc_id", "text", "lang", "source", "n_chars")
    other = [(3, named[30], "en"), (4, named[40], "en"), (12, named[25] + " more of it", "de"), (None, named[25], "en"), (12, named[27], "en")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, lang, None, len(t)) for i, t, lang in other], docs.schema))
    write_table(docs, tmp_path, "documents")
    write_table(spark.createDataFrame([(1, named[40])], "item_id bigint, text string"), tmp_path, "benchmark")

    def order(row):
        own = xxhash.xxh64_intdigest(row[1].encode(), seed=42)
        return row[0] is None, row[0] or 0, own - (own >> 63 << 64)

    model = langid.train(docs.where(~langid.held_out(5, 0)))
    told = {r.text or "" for r in langid.accepted(docs, model).collect()}
    left = sorted([(r.doc_id, r.text or "") for r in docs.collect() if (r.text or "") in told], key=order)
    lines = slow_lines({order(r): r[1] for r in left}, linededup.WINDOW)
    left = sorted([(r[0], lines[order(r)][0]) for r in left], key=order)
    prints = {t: slow_fingerprint(t) for _, t in left}
    names = sorted(set(prints.values()))
    groups = joined(names, [(a, b) for a in names for b in names if (a ^ b).bit_count() <= simhash.RADIUS])
    first: dict = {}
    for r in left:
        first.setdefault(groups[prints[r[1]]], r)
    left = [r for r in left if first[groups[prints[r[1]]]] == r]
    found = decontaminate.brute_force([t.encode() for _, t in left], [(1, named[40].encode())])
    left = [r for r, f in zip(left, found) if not f[4]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in left)
    assert 4 in {i for i, _ in left} and all(named[40] not in t for _, t in left) and os.path.isdir(tmp_path)

import duckdb
import pytest

from prismata.llm import linededup

SF = "/root/testdata/sf0.001"


def slow_long_lines(named, width, long_words):
    seen, out = set(), {}
    for doc in sorted(named):
        lines = named[doc].split("\n")
        full = [i for i, x in enumerate(lines) if x.encode().strip()]
        gone = set()
        for s in range(len(full)):
            for k in range(1, min(width, len(full) - s) + 1):
                at = full[s : s + k]
                w = tuple(lines[i].encode().strip() for i in at)
                if k < width and sum(len(x.split()) for x in w) < long_words:
                    continue
                if w in seen:
                    gone.update(range(at[0], at[-1] + 1))
                seen.add(w)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


@pytest.mark.parametrize("width, long_words", [(3, 50), (3, 20), (4, 24), (1, 50)])
def test_long_runs_of_few_lines(ugly, named, empty, width, long_words):
    want = slow_long_lines(named, width, long_words)
    rows = linededup.dedup_lines(ugly, width, long_words).collect()
    assert len(rows) == ugly.count()
    for r in rows:
        if r.doc_id is not None:
            assert ((r.text or ""), r.n_removed) == want[r.doc_id]
    assert linededup.dedup_lines(empty, width, long_words).count() == 0


def test_copies_of_one_or_two_lines(spark):
    one, left, right = ("%s " * 50 % tuple(range(50))).strip(), "l " * 20 + "l", "r " * 28 + "r"
    texts = [one, f"head\n  {one}\ntail", f"{left}\n\n{right}", f"{left}\n{right}", f"{left}\nother", one[:-3], one[:-3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(docs, linededup.LONG_WORDS).collect()}
    assert got == {0: texts[0], 1: "head\ntail", 2: texts[2], 3: "", 4: texts[4], 5: texts[5], 6: texts[6]}
    assert {r.doc_id: r.text for r in linededup.drop_repeated_lines(docs).collect()} == dict(enumerate(texts))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = linededup.op10_linededup_long(spark, SF)
    cur = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({linededup.LONG_SQL})")
    assert sorted(map(tuple, rows.collect())) == sorted(cur.fetchall())

import collections
import re

import numpy as np
import pytest

from prismata.llm import paragraphs, windows
from prismata.llm.common import joined_runs, keyed


def slow_windows(named):
    """doc_id: runs of bytes in windows that also start earlier, and the documents of their first places."""
    first, out = {}, {}
    for d in sorted(named):
        text = named[d].encode()
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", text)]
        w = [text[a:b].lower() for a, b in at]
        for p in range(len(w) - paragraphs.LENGTH + 1):
            stays = first.setdefault(tuple(w[p : p + paragraphs.LENGTH]), (d, p))
            if stays != (d, p):
                spans, docs = out.setdefault(d, ([], set()))
                docs.add(stays[0])
                top, bottom = at[p][0], at[p + paragraphs.LENGTH - 1][1]
                if spans and top <= spans[-1]:
                    spans[-1] = bottom
                else:
                    spans += [top, bottom]
    return {d: (a, sorted(b)) for d, (a, b) in out.items()}


@pytest.mark.parametrize("hot, sent", [(8, 1 << 19), (1, 1 << 19), (1000, 50)])
def test_every_window(ugly, named, empty, hot, sent, monkeypatch):
    monkeypatch.setattr(windows, "SENT", sent)
    found = windows.repeated_windows(keyed(ugly), hot).cache()
    runs = {r.doc_id: r.runs for r in joined_runs(found, "doc_id", "own").collect()}
    kept = collections.defaultdict(set)
    for r in found.collect():
        kept[r.doc_id].add(r.stays)
    want = slow_windows(named)
    assert len(want) > 10 and {d: (runs[d], sorted(kept[d])) for d in runs} == want
    assert windows.repeated_windows(keyed(empty)).count() == 0


def test_no_position_is_left_out(spark, tmp_path):
    """A copy of 20 words is found wherever it stands, and goes as a whole."""
    turn = np.random.default_rng(8)
    text = lambda n: " ".join("".join(turn.choice(list("abcdefghijkl"), 7)) for _ in range(n))
    rows, want = [], {}
    for i in range(150):
        passage, head = text(20 + i % 3), text(1 + i % 17)
        rows += [(i, f"{text(5 + i % 11)} {passage} {text(12)}"), (1000 + i, f"{head} {passage.upper()} {text(i % 13)}")]
        want[1000 + i] = [len(head) + 1, len(head) + 1 + len(passage)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: [r.top, r.bottom] for r in joined_runs(windows.repeated_windows(keyed(docs)), "doc_id", "own").selectExpr("doc_id", "runs[0] as top", "runs[1] as bottom").collect()} == want
    got = {r.doc_id: r for r in paragraphs.op3_paragraphs(spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r.n_removed} == set(want)
    for i, (top, bottom) in want.items():  # a paragraph that is similar but for a word at one end goes with that word
        assert len(got[i].removed) == 2 and top - 8 <= got[i].removed[0] <= top and bottom <= got[i].removed[1] <= bottom + 8 and got[i].kept_in == [i - 1000]
    left = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(docs, every=True).collect()}
    ends = {i: r.removed or [0, 0] for i, r in got.items()}
    assert all(left[i] == t[: ends[i][0]] + t[ends[i][1] :] for i, t in rows)


def test_paragraphs_cover_texts():
    turn = np.random.default_rng(4)
    for size in [*range(60), 300, 2000]:
        for words in (turn.integers(0, 9000, size), turn.integers(0, 2, size)):
            texts = [b"one two", b" ".join(b"w%d" % x for x in words), b" ".join(b"w%d" % x for x in words[::-1])]
            word, _, _, count, _ = paragraphs.hashed_words(texts)
            at = paragraphs.starts(word, count, True)
            hit = np.zeros(len(word), bool)
            for a in at:
                hit[a : a + paragraphs.LENGTH] = True
            for first, n in zip(np.cumsum(count) - count, count):
                own = at[(at >= first) & (at < first + n)]
                assert (np.diff(own) >= paragraphs.SPREAD).all() and (own + paragraphs.LENGTH <= first + n).all()
                if n >= paragraphs.LENGTH:
                    assert hit[first : first + n - paragraphs.LENGTH + 1].all()

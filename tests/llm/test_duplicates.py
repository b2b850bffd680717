import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from prismata.llm import linededup, paragraphs, simhash, suffix


def joined(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("blocks, chunk", [(7, 4096), (5, 3), (8, 2)])
def test_simhash(ugly, named, empty, blocks, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 2 if chunk < 10 else 8)
    prints = {i: slow_fingerprint(t) for i, t in named.items()}
    ids = sorted(prints)
    array = np.array([prints[i] for i in ids], np.uint64)
    want = joined(ids, [(ids[k], ids[j]) for k in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(array ^ array[k]) <= 4)])
    rows = simhash.near_duplicates(ugly, blocks=blocks, chunk=chunk).collect()
    assert len(rows) == ugly.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(ugly)
    assert kept.columns == ugly.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(want.values())


def slow_lines(named, width):
    seen, out = set(), {}
    for doc in sorted(named):
        lines = named[doc].split("\n")
        full = [i for i, x in enumerate(lines) if x.encode().strip()]
        gone = set()
        for k in range(len(full) - width + 1):
            at = full[k : k + width]
            w = tuple(lines[i].encode().strip() for i in at)
            if w in seen:
                gone.update(range(at[0], at[-1] + 1))
            seen.add(w)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


@pytest.mark.parametrize("width", [1, 2, 3])
def test_line_dedup(ugly, named, empty, width):
    want = slow_lines(named, width)
    rows = linededup.dedup_lines(ugly, width).collect()
    assert len(rows) == ugly.count()
    for r in rows:
        if r.doc_id is not None:
            assert ((r.text or ""), r.n_removed) == want[r.doc_id]
    assert linededup.dedup_lines(empty, width).count() == 0
    assert linededup.drop_repeated_lines(ugly).columns == ugly.columns


def slow_starts(words):
    """Paragraphs of a text's words, as (first word, number of words), by their definition."""
    if not words:
        return []
    word = paragraphs.hashed_words([b" ".join(words)])[0]
    h = [int(x) for x in paragraphs.shingled(word, 3)]
    r, out = paragraphs.SPREAD, []
    for p in range(len(words) - paragraphs.LENGTH + 1):
        if p == 0 or (p >= r and all(h[q] > h[p] for q in range(p - r, p)) and all(h[q] >= h[p] for q in range(p + 1, min(p + r + 1, len(h))))):
            out.append((p, paragraphs.LENGTH))
    return out


def slow_paragraphs(named):
    """doc_id: runs of bytes that go, and the documents where they stay."""
    pars = []
    for d in sorted(named):
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", named[d].encode())]
        w = [named[d].encode()[a:b].lower() for a, b in at]
        pars += [(d, at[p][0], at[p + n - 1][1], frozenset(tuple(w[k : k + 5]) for k in range(p, p + n - 4)), tuple(w[p : p + n])) for p, n in slow_starts(w)]
    where = collections.defaultdict(list)
    for k, x in enumerate(pars):
        for g in x[3]:
            where[g].append(k)
    links, first = [], {}
    for k, x in enumerate(pars):
        links.append((k, first.setdefault(x[4], k)))
        for j, n in collections.Counter(j for g in x[3] for j in where[g] if j > k).items():
            if n >= 0.8 * (len(x[3]) + len(pars[j][3]) - n):
                links.append((k, j))
    root = joined(range(len(pars)), links)
    out = {}
    for k, x in enumerate(pars):
        if root[k] != k:
            spans, docs = out.setdefault(x[0], ([], set()))
            docs.add(pars[root[k]][0])
            if spans and x[1] <= spans[-1]:
                spans[-1] = max(spans[-1], x[2])
            else:
                spans += [x[1], x[2]]
    return {d: (a, sorted(b)) for d, (a, b) in out.items()}


def test_paragraphs(ugly, named, empty):
    want = slow_paragraphs(named)
    assert len(want) > 10
    for chunk in (1024, 2):
        assert {r.doc_id: (r.removed, r.kept_in) for r in paragraphs.repeated(ugly, chunk=chunk).collect()} == want
    assert paragraphs.repeated(empty).count() == 0
    cut = paragraphs.dedup_paragraphs(ugly)
    assert cut.columns == ugly.columns and cut.count() == ugly.count()
    for r in cut.collect():
        if r.doc_id is not None:
            ends = [0, *want.get(r.doc_id, ([],))[0], len(named[r.doc_id].encode())]
            assert (r.text or "").encode() == b"".join(named[r.doc_id].encode()[a:b] for a, b in zip(ends[::2], ends[1::2]))


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words, alone, inside lines and across lines, some with a word changed: documents that hold a
    later one lose it, and documents without one are left alone."""
    turn = np.random.default_rng(5)
    word = lambda: "".join(turn.choice(list("abcdefghijklmnop"), turn.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages, rows, late, near = [text(int(turn.integers(51, 70))) for _ in range(40)], [], set(), set()
    for i in range(600):
        kind, p = i % 6, passages[i % len(passages)]
        if kind == 0:
            body = p
        elif kind == 1:
            body = f"{text(30)} {p} {text(30)}"
        elif kind == 2:
            w = p.split()
            body = f"{text(20)}\n{' '.join(w[:20])}\n{' '.join(w[20:41])}\n{' '.join(w[41:])} {text(9)}"
        elif kind == 3:
            w = p.split()
            w[43] = word()
            body = f"{text(15)} {' '.join(w)}\n{text(40)}"
        else:
            body = text(int(turn.integers(30, 200)))
        if kind < 4 and i >= 240:
            (near if kind == 3 else late).add(i)
        rows.append((i, body))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in paragraphs.op3_paragraphs(spark, str(tmp_path)).collect()}
    lost = {i for i, r in got.items() if r.n_removed}
    assert len(got) == 600 and got[0].n_bytes == len(rows[0][1])
    assert len(lost & late) >= 0.97 * len(late) and len(lost & near) >= 0.9 * len(near)
    assert not lost & {i for i in range(600) if i % 6 > 3}
    assert all(r.n_removed == sum(r.removed[1::2]) - sum(r.removed[::2]) and (len(r.kept_in) > 0) == (r.n_removed > 0) for r in got.values())


def test_bands_are_tuned():
    bands, rows = paragraphs.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL and bands * rows <= paragraphs.HASHES


@pytest.mark.parametrize("least_hot, length, large, held", [(1000, 100, 2000, 1 << 19), (3, 100, 2000, 1 << 19), (3, 40, 2, 1 << 19), (1000, 100, 1, 20), (1000, 60, 3, 5)])
def test_suffix_repeats(ugly, named, empty, least_hot, length, large, held, monkeypatch):
    monkeypatch.setattr(suffix, "LEAST_HOT", least_hot)
    monkeypatch.setattr(suffix, "LARGE", large)
    monkeypatch.setattr(suffix, "HELD", held)
    want = suffix.brute_force({k: v.encode() for k, v in named.items()}, length)
    rows = suffix.dedup_bytes(ugly, length=length).collect()
    assert len(rows) == ugly.count()
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:5] == want[r.doc_id]
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert suffix.dedup_bytes(empty).count() == 0


def test_suffix_array_is_sorted():
    turn = np.random.default_rng(0)
    for n, letters in ((1, 2), (60, 2), (400, 3), (1500, 256), (300, 1)):
        text = turn.integers(0, letters, n).astype(np.uint8)
        order, _ = suffix.suffix_array(text, 2000)
        data = text.tobytes()
        keys = [data[i:].ljust(n, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


@pytest.fixture(scope="module")
def shared(spark):
    """Rows of different texts under one doc_id, or without any."""
    turn = np.random.default_rng(12)
    words = np.array(["".join(turn.choice(list("abcdefghijklmnop"), 6)) for _ in range(900)])
    line = lambda n=30: " ".join(turn.choice(words, n))
    a, b, c, d = ("\n".join(line() for _ in range(6)) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (3, b), (3, "\n".join([line(), c, line()])), (4, c), (4, line()), (None, d), (None, c + "\n" + line()), (5, d), (None, line())]
    return spark.createDataFrame([*rows, rows[3]], "doc_id bigint, text string"), [*rows, rows[3]]


def kept_once(rows, left, unit):
    """Each unit of the texts is left exactly once."""
    before = {x for _, t in rows for x in unit(t)}
    after = collections.Counter(x for _, t in set(left) for x in unit(t))
    return set(after) == before and max(after.values()) == 1


def test_near_duplicates_lose_no_text_where_doc_ids_repeat(shared):
    docs, rows = shared
    left = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    prints = {t: slow_fingerprint(t) for _, t in rows}
    near = lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4
    assert all(any(near(t, k) for _, k in left) for _, t in rows) and set(left) <= set(rows)
    assert not any(near(x, y) for i, (_, x) in enumerate(sorted(set(left), key=str)) for _, y in sorted(set(left), key=str)[:i])
    assert {(1, rows[0][1]), (2, rows[1][1]), (5, rows[9][1])} <= set(left)


def test_lines_are_not_lost_where_doc_ids_repeat(shared):
    docs, rows = shared
    left = [tuple(r) for r in linededup.drop_repeated_lines(docs).collect()]
    assert len(left) == len(rows)
    assert kept_once(rows, left, lambda t: [x for x in t.split("\n") if x])


def test_paragraphs_are_not_lost_where_doc_ids_repeat(shared):
    docs, rows = shared
    left = [tuple(r) for r in paragraphs.dedup_paragraphs(docs).collect()]
    assert len(left) == len(rows)
    assert {w for _, t in left for w in t.split()} == {w for _, t in rows for w in t.split()}
    assert {t for i, t in rows if i is None} <= {t for i, t in left if i is None}


def test_many_runs_in_one_text(spark):
    """Cutting takes time by the length of a text, not by its length times its runs."""
    import time

    one = [f"line {i} of the first text" for i in range(9000)]
    many = "\n".join(f"{x}\nown {i}" if i % 3 == 2 else x for i, x in enumerate(one))
    docs = spark.createDataFrame([(1, "\n".join(one)), (2, many)], "doc_id bigint, text string")
    linededup.drop_repeated_lines(docs.limit(1)).collect()
    began = time.time()
    left = {r.doc_id: r.text for r in linededup.drop_repeated_lines(docs).collect()}
    assert left[2] == "\n".join(f"own {i}" for i in range(2, 9000, 3)) and time.time() - began < 60

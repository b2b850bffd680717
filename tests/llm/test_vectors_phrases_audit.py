"""Operators 11 to 13 against brute force."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from prismata.llm import embeddings, filter_audit, phrases

WIDTH = 24


def vector_rows():
    """Dense spots, vectors around the threshold, lone ones, and rows that link with nothing."""
    turn = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x)
    rows = []
    for size, noise in ((150, 0.03), (90, 0.07), (60, 0.12), (3, 0.05)):
        middle = unit(turn.normal(size=WIDTH))
        rows += [(unit(middle + noise * turn.normal(size=WIDTH)), size % 2) for _ in range(size)]
    for _ in range(60):  # pairs on both sides of the threshold
        x, y = unit(turn.normal(size=WIDTH)), turn.normal(size=WIDTH)
        y = unit(y - (x @ y) * x)
        c = turn.uniform(0.9, 0.97)
        rows += [(x, 0), (c * x + (1 - c * c) ** 0.5 * y, 0)]
    rows += [(unit(turn.normal(size=WIDTH)), int(turn.integers(3))) for _ in range(150)]
    rows = [(i, [float(z) for z in x], lab, "x", 1.0) for i, (x, lab) in enumerate(rows)]
    odd = [[1.0, 2.0], [1.0, 2.0, 0.0], [2.0, 4.0], [1e300] * WIDTH, [1.0] * WIDTH, [0.0] * WIDTH, [float("nan")] + [1.0] * (WIDTH - 1), [float("inf")] * WIDTH, [None] + [1.0] * (WIDTH - 1), [], None]
    rows += [(1000 + i, v, 5, None, None) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None, None, None), (None, [3.0, 1.0], 5, None, None), (3000, rows[5][1], rows[5][2], None, None)]
    return rows + [rows[7], rows[7], rows[-3]]


COLUMNS = "vec_id bigint, embedding array<double>, label int, id string, n double"


def brute_links(rows):
    good = [k for k, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    near = defaultdict(set)
    for p, a in enumerate(good):
        for b in good[:p]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for k, r in enumerate(rows):
        seen, front = {k}, [k]
        while front:
            for j in near[front.pop()] - seen:
                seen.add(j)
                front.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[k]), low, r[0] == low))
    return out


@pytest.mark.parametrize("how", [{}, {"chunk": 16, "visits": 8, "lists": 6}, {"chunk": 40, "visits": 1000, "lists": 40}])
def test_vectors_against_brute_force(spark, how):
    rows = vector_rows()
    order = lambda t: tuple((x is None, x or 0) for x in t)
    found = sorted(map(tuple, embeddings.near_duplicate_vectors(spark.createDataFrame(rows, COLUMNS).repartition(5), **how).collect()), key=order)
    want = sorted(brute_links(rows), key=order)
    assert [f[0] for f in found] == [w[0] for w in want]
    assert all(f[1] <= w[1] for f, w in zip(found, want))  # no link below the threshold
    assert sum(f[1] for f in found) >= 0.995 * sum(w[1] for w in want)
    assert sum(f != w for f, w in zip(found, want)) <= 0.01 * len(want)
    if not how:  # so few lists that all are probed
        assert found == want


def test_probes_find_most_neighbours_at_the_threshold(spark):
    turn = np.random.default_rng(9)
    x = turn.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = turn.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.931 * x + (1 - 0.931**2) ** 0.5 * y])
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id bigint, embedding array<double>, label int")
    linked = embeddings.near_duplicate_vectors(rows, lists=200).where("n_links > 0").count()
    assert linked >= 0.97 * len(both)


def test_no_vectors(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert embeddings.near_duplicate_vectors(none).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicate_vectors(spark.createDataFrame([(1, None, None, None, None)], COLUMNS)).collect()] == [(1, 0, 1, True)]


def test_large_classes_send_no_pairs(spark):
    """3000 near copies: what connects them grows with the copies, not with their pairs."""
    turn = np.random.default_rng(2)
    x = 1 + 0.1 * turn.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    classes, _ = embeddings.vector_classes(rows, "vec_id", "embedding", "label")
    edges, gains = embeddings.links(classes, chunk=256)
    assert edges.count() < 3 * len(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert gains.agg({"gain": "sum"}).first()[0] == (x @ x.T >= 0.93).sum() - len(x)


def brute_collocations(rows, least, top):
    import re

    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) for p in [q[i : i + m]] if 100 * b >= 80 * c[p]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard, least, top", [(16 << 20, 3, 2000), (900, 2, 40)])
def test_collocations_against_brute_force(spark, ugly, shard, least, top):
    turn = random.Random(5)
    words = ["New", "york", "ÉTÉ", "ß", "a", "of", "the", " ", "x y"]
    extra = [("".join(turn.choice(words) + turn.choice([" ", "\t", " ", "  ", ", ", ".", "\r\n"]) for _ in range(400)), turn.choice(["en", "und", None])) for _ in range(8)]
    docs = ugly.select("text", "lang", "n").unionByName(spark.createDataFrame([(t, lang, 1) for t, lang in extra], "text string, lang string, n int"))
    want = brute_collocations([(r.text, r.lang) for r in docs.collect()], least, top)
    found = phrases.collocations(docs, least=least, top=top, shard_bytes=shard)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == want and len(want) > 30


def test_no_collocations(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b a b", "en")], "text string, lang string")).count() == 0


def test_lists_round_trip():
    turn = np.random.default_rng(1)
    lists = [np.sort(turn.choice(1 << 40, n, replace=False)) for n in (1, 5, 1000, 2)] + [np.array([0]), np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 60])]
    first = np.append(0, np.cumsum([len(x) for x in lists]))
    packed = phrases.position_lists(np.concatenate(lists), first).to_pylist()
    assert (phrases.positions(packed, np.diff(first)) == np.concatenate(lists)).all()
    assert (phrases.positions(packed[1:3], np.diff(first)[1:3]) == np.concatenate(lists[1:3])).all()


def brute_audit(rows, good, toxic):
    import re

    bits, low = [], {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and low[t] < i]
        bits.append((lang or "", {c for c, f in zip("ABCDE", fails) if f}, i in good, i in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {b[0] for b in bits}:
            own = [b for b in bits if b[0] == part]
            for s, c in enumerate(order, 1):
                early = set(order[: s - 1])
                gone = [b for b in own if c in b[1] and not b[1] & early]
                kept = sum(not b[1] & (early | {c}) for b in own)
                out[part, order, s] = [kept, len(gone), sum(c in b[1] for b in own) - len(gone), sum(b[1] == {c} for b in own), sum(b[2] for b in gone), sum(b[3] for b in gone)]
    shapley = Counter()
    for (part, order, s), v in out.items():
        shapley[part, order[s - 1]] += v[1]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit_against_brute_force(spark, ugly, empty, monkeypatch):
    turn = random.Random(6)
    extra = [(500 + i, "".join(turn.choice(["Wort ", "WORD ", "a# ", "ß ", "x\n", f"n{i} ", f"q{turn.random()} "]) for _ in range(turn.choice([5, 60, 120, 300]))), turn.choice(["", "de", None])) for i in range(60)]
    docs = ugly.select("doc_id", "text", "lang", "n", "fp").unionByName(spark.createDataFrame([(*r, None, None) for r in extra], "doc_id bigint, text string, lang string, n int, fp bigint"))
    marks = [(i, turn.choice([0, 1, None]), turn.choice([0, 1])) for i in range(0, 560, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], {i for i, q, _ in marks if q and i is not None}, {i for i, _, t in marks if t and i is not None})
    found = filter_audit.filter_audit(docs, labels)
    assert sorted(map(tuple, found.collect())) == want
    assert filter_audit.filter_audit(empty, labels).count() == 0

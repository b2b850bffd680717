import hashlib
import random

import numpy as np

from prismata.llm import bpe, exact_dedup


def test_exact_dedup(ugly, named, empty):
    rows = exact_dedup.exact_dedup(ugly).collect()
    assert len(rows) == ugly.count()
    source = ugly.select("doc_id", "text").collect()
    groups = {}
    for r in source:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = sorted(
        (str(d), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for d in ids
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_hot_digests_agree_with_cold(ugly):
    few = exact_dedup.exact_dedup(ugly, share=0.02).collect()
    assert sorted(map(str, few)) == sorted(map(str, exact_dedup.exact_dedup(ugly, share=0.9).collect()))


def test_automaton_equals_the_library():
    from tokenizers import Tokenizer

    automaton = bpe.Automaton.from_file(bpe.vocabulary_path()).ready()
    library = Tokenizer.from_file(bpe.vocabulary_path())
    turn = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "<|endoftext|>", "'s", "é", "日", "12", ".", "!!", "aaaa", "http", "ing", "²", "\x1c", " ", "ſ", "\x00"]
    texts = ["".join(turn.choice(parts) for _ in range(turn.randint(0, 16))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 2000 + "x", "aA" * 900, "ÃÂ" * 500]
    texts += ["a" + chr(c) + "a " + chr(c) * 2 for c in [*range(0, 0x3000), *range(0x1F300, 0x1F350)] if not 0xD800 <= c < 0xE000]
    for t in texts:
        ids = automaton.ids(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert automaton.text(ids) == t


def test_tables_are_freed_and_need_no_package(tmp_path):
    """Workers are used again by later stages: an automaton goes with its last reference. Executors need not have the package."""
    import os
    import subprocess
    import sys
    import weakref

    from pyspark import cloudpickle

    data = cloudpickle.dumps(bpe.Automaton.from_file(bpe.vocabulary_path()))
    for _ in range(2):
        automaton = bpe.Automaton.from_file(bpe.vocabulary_path()).ready()
        want = automaton.ids("Some words, some more words").hex()
        gone = weakref.ref(automaton)
        del automaton
        assert gone() is None
    (tmp_path / "tables").write_bytes(data)
    script = "import pickle, sys; a = pickle.load(open('tables', 'rb')).ready(); print(a.ids('Some words, some more words').hex(), any(m.startswith('prismata') for m in sys.modules))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert said.stdout.split() == [want, "False"], said.stderr


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    automaton = bpe.Automaton.from_file(bpe.vocabulary_path()).ready()
    text = " ".join(f"word{i}" for i in range(2000))
    assert automaton.text(automaton.ids(text)) == text
    assert len(automaton.young) + len(automaton.old) < 60


def test_tokens_of_all_rows(ugly, named, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = bpe.round_trip(ugly).collect()
    assert len(got) == ugly.count()
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(named[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(ugly)).collect()}
    assert all(back[k] == v for k, v in named.items())
    assert bpe.round_trip(empty).count() == 0

"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token strings that BPE produces. It starts as
one state with an arc to itself for each byte. Each merge (u, v) -> w, in order of rank, adds a
gadget: w gets a state of its own, a copy of the state behind v as it is by then, and the arc v of the state behind u
is cut (after u, v can no longer follow). The state behind a token depends on that token alone, so a
state is named by its token. A cut also closes the arcs of the tokens that begin with v and are built from it later,
as they stand for the same path; so a state's row lists its cuts (token, rank), and an arc t is there unless
a token on t's left edge was cut before the next one on that edge was built. The rows are compiled once,
on the driver, into two flat tables (some 940,000 entries for a vocabulary of 50,000).

A word is encoded by table-driven transitions from left to right: each prefix of a word has one
accepted tokenization, so one state, whose arcs that match the following bytes lead to the next
prefixes. Decoding emits the bytes that label the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, pieces, prepare, quoted, received, sent, table

#: The pattern that splits text into words before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts up to U+02AF, whose letters, numbers and spaces are stated for the faster standard library.
PLAIN = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+| ?[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+"
    "| ?[^\t-\r \u0085\u00a00-9A-Za-z\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+"
    "|[\t-\r \u0085\u00a0]+(?![^\t-\r \u0085\u00a0])|[\t-\r \u0085\u00a0]+"
)
NEVER = 1 << 30
#: About how many bytes each of the two generations of words takes that a worker remembers.
CACHE_BYTES = 32 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 letters stand for themselves, the other bytes take letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """Tables of the compiled automaton; small (bounded by the vocabulary) and sent to executors once.

    first[p] to first[p + 1] are the places of state p's row in symbol (sorted) and rank; left[t] is the
    left part of token t (-1: a byte, -2: no arc) and built[t] the rank of the merge that built it.
    Nothing refers back to the tables, so a worker frees them as soon as no task of theirs is left.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        from array import array

        top = max([*vocabulary.values(), *special.values()]) + 1
        self.special = special
        self.label = [b""] * top
        for t, i in [*vocabulary.items(), *((s.encode(), i) for s, i in special.items())]:
            self.label[i] = t
        self.left, self.built = array("i", [-2]) * top, array("i", [NEVER]) * top
        rows: dict[int, dict[int, int]] = {}
        for t, i in vocabulary.items():
            if len(t) == 1:
                self.left[i], rows[i] = -1, {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if w in rows:
                raise ValueError("two merges build the same token")
            if u in rows and v in rows and self._open(rows[u], v):  # else v never follows u, and the merge never happens
                rows[w] = dict(rows[v])
                rows[u][v] = rank
                self.left[w], self.built[w] = u, rank
        self.first, self.symbol, self.rank = array("i", [0]), array("i"), array("i")
        for p in range(top):
            row = rows.get(p, {})
            for v in sorted(row):
                self.symbol.append(v)
                self.rank.append(row[v])
            self.first.append(len(self.symbol))

    def _open(self, row: dict[int, int], t: int) -> bool:
        until = NEVER
        while t >= 0:
            if row.get(t, NEVER + 1) <= until:
                return False
            until, t = self.built[t], self.left[t]
        return True

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        special = {x["content"]: x["id"] for x in given["added_tokens"]}
        vocabulary = {plain(t): i for t, i in given["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
        return cls(vocabulary, [(plain(a), plain(b)) for a, b in merges], special)

    def arc(self, p: int, t: int) -> bool:
        """Whether the state behind token p has an arc for token t."""
        low, high, symbol, left = self.first[p], self.first[p + 1], self.symbol, self.left
        until = NEVER
        while t >= 0:
            i = bisect_left(symbol, t, low, high)
            if i < high and symbol[i] == t and self.rank[i] <= until:
                return False
            until, t = self.built[t], left[t]
        return True

    def ready(self) -> Automaton:
        """Tables that are quick to build again and needn't be sent."""
        if "arcs" not in self.__dict__:
            import numpy as np
            import regex

            self.arcs = {t: i for i, t in enumerate(self.label) if self.left[i] > -2}
            self.step: dict = {}  # arcs by their bytes, one at a time; -1: an arc ends here
            for t, i in self.arcs.items():
                node = self.step
                for c in t:
                    node = node.setdefault(c, {})
                node[-1] = i
            self.plain, self.other = re.compile(PLAIN).findall, regex.compile(PATTERN).findall
            self.beyond = re.compile("[^\\x00-\u02af]").search
            self.flat = np.frombuffer(b"".join(self.label), np.uint8)
            self.length = np.fromiter(map(len, self.label), np.int64, len(self.label))
            self.start = np.cumsum(self.length) - self.length
            self.breaks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
            self.young: dict[str, bytes] = {}
            self.old: dict[str, bytes] = {}
            self.size = 0
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("label", "special", "left", "built", "first", "symbol", "rank")}

    def word(self, data: bytes) -> list[int]:
        """The tokens of one word."""
        if (whole := self.arcs.get(data)) is not None:
            return [whole]
        n, root, arc = len(data), self.step, self.arc
        # Longest arcs first. A position has one state, however it is reached, so none is tried twice.
        behind, before, tried = {0: -1}, {}, []
        i = 0
        while i < n:
            node = root
            for j in range(i, n):
                node = node.get(data[j])
                if node is None:
                    break
                if -1 in node:
                    tried.append((i, j + 1, node[-1]))
            while True:
                i, j, t = tried.pop()
                if j not in before and (not i or arc(behind[i], t)):
                    break
            behind[j], before[j] = t, i
            i = j
        out, j = [], n
        while j:
            out.append(behind[j])
            j = before[j]
        return out[::-1]

    def known(self, words: list[str]) -> bytes:
        """The tokens of words, which are remembered in two generations: when the young one is full, it becomes the old one."""
        young, out = self.young, []
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    data = word.encode()
                    ids = b"".join([i.to_bytes(4, "little") for i in self.word(data)])
                if len(word) <= 256:  # long words seldom come again
                    self.size += 5 * len(word) + 200
                    if self.size > CACHE_BYTES:
                        self.old, self.young, self.size = young, {}, 0
                        young = self.young
                    young[word] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        """The tokens of a text as little-endian unsigned 32-bit integers."""
        if self.breaks is None or not any(s in text for s in self.special):
            return self.known(self.words(text))
        parts = self.breaks.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self.known(self.words(p)) for k, p in enumerate(parts))

    def words(self, text: str) -> list[str]:
        return (self.other if self.beyond(text) else self.plain)(text)

    def text(self, ids: bytes) -> str:
        """The labels of the arcs, one after the other."""
        import numpy as np

        path = np.frombuffer(ids, "<u4")
        n = self.length[path]
        end = np.cumsum(n)
        at = np.repeat(self.start[path] - end + n, n)
        at += np.arange(len(at))
        return self.flat[at].tobytes().decode("utf-8", "replace")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mapped(docs: DataFrame, column: str, path: str | None, schema: str, rows) -> DataFrame:
    spark = prepare(docs.sparkSession)
    tables = sent(spark, Automaton.from_file(path or vocabulary_path()))

    def run(batches):
        import pyarrow as pa

        automaton = received(tables).ready()
        for batch in batches:
            for part in pieces(batch, column):
                made = [rows(automaton, x) for x in as_bytes(part, column)]
                columns = list(zip(*made)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")))
    return quoted(docs, ["doc_id", column]).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every text."""

    def rows(automaton, x):
        import numpy as np

        ids = np.frombuffer(automaton.ids(x.decode()), "<u4")
        return len(ids), ids

    return _mapped(docs, "text", path, "n_tokens long, ids array<int>", rows)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every array of ids."""
    from pyspark.sql import functions as F

    spark = prepare(encoded.sparkSession)
    tables = sent(spark, Automaton.from_file(path or vocabulary_path()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        automaton = received(tables).ready()
        for batch in batches:
            texts = [automaton.text(np.asarray(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text, decode it, and give doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text is empty and has no tokens. Repeated rows give repeated rows, in any order; an empty
    table gives none. A text of any length is encoded whole, word by word. Other columns are
    ignored. There is no shuffle; tables are broadcast and bounded by the vocabulary.
    """

    def rows(automaton, x):
        ids = automaton.ids(x.decode())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(automaton.text(ids).encode()).hexdigest()

    return _mapped(docs, "text", path, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))

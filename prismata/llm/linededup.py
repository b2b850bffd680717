"""Line deduplication by winnowing over line hashes.

Blank lines aside, each WINDOW consecutive lines of a document give their least line hash (the
rightmost of equal ones) as a fingerprint, so any run of WINDOW lines that occurs twice shares one,
at the same place in the run. Positions of fingerprints that occur more than once are joined, and
extended to the windows that chose them; a window whose lines (by a 128-bit hash) also start
earlier, in a document of smaller doc_id or higher up in the same one, is a repeat. Overlapping repeats
join to maximal runs in both directions, and all lines of such runs are deleted.

Where a number of words is given (long_words), shorter runs of so many words or more count as well: windows of
one line up to WINDOW - 1 are chosen and compared in the same way. op10_linededup and the pipeline go without, as
the SQL and the tests of both have it; op10_linededup_long goes with LONG_WORDS.

Groups are only ever reduced by aggregates that combine on the map side (the first position of
each window), and joins meet tables that are written, so that skewed keys can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fresh, joined_runs, keyed, matched_rows, pieces, prepare, quoted, row_order, table, written

#: Lines of the shortest run that counts as a repeat.
WINDOW = 3
#: Words that make a shorter run count, for callers who ask for it.
LONG_WORDS = 50


def windows(docs: DataFrame, width: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """doc_id, own, fp, at: fingerprints of each row, each with the windows that chose it (high, low: digest; top, bottom: line numbers)."""
    prepare(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        kind = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64()), ("top", pa.int32()), ("bottom", pa.int32())]))
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, prints, at = [], [], []
                for doc, text in enumerate(as_bytes(part, "text")):
                    line = [(i, x) for i, x in enumerate(map(bytes.strip, text.split(b"\n"))) if x]
                    if len(line) < (width if long_words is None else 1):
                        continue
                    h = np.array([xxhash.xxh64_intdigest(x) for _, x in line], np.uint64)
                    total = None if long_words is None else np.cumsum([0] + [len(x.split()) for _, x in line])
                    own: dict[int, list] = {}
                    for k in range(width if long_words is None else 1, min(width, len(line)) + 1):
                        view = np.lib.stride_tricks.sliding_window_view(h, k)[:, ::-1]
                        chosen = np.arange(len(view)) + k - 1 - view.argmin(axis=1)
                        starts = range(len(view)) if k == width else np.flatnonzero(total[k:] - total[:-k] >= long_words).tolist()
                        for s in starts:
                            d = xxhash.xxh3_128_digest(b"\n".join(x for _, x in line[s : s + k]))
                            own.setdefault(int(chosen[s]), []).append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), line[s][0], line[s + k - 1][0]))
                    ids += [doc] * len(own)
                    prints += h[list(own)].view(np.int64).tolist()
                    at += [[dict(zip(("high", "low", "top", "bottom"), w)) for w in x] for x in own.values()]
                ids = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(ids), part.column("own").take(ids), pa.array(prints, pa.int64()), pa.array(at, kind)], names=["doc_id", "own", "fp", "at"])

    return keyed(docs).mapInArrow(run, "doc_id bigint, own bigint, fp bigint, at array<struct<high:bigint,low:bigint,top:int,bottom:int>>")


def repeats(docs: DataFrame, width: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """doc_id, own, runs: the line numbers (first, last, first, last, ...) of the maximal repeated runs of each row that has any."""
    found = written(windows(docs, width, long_words), "line-fingerprints")
    shared = written(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "shared-lines")
    near = found.join(shared.hint("merge"), "fp").select("doc_id", "own", F.explode("at").alias("w")).select("doc_id", "own", "w.*").distinct()
    near = written(near, "line-windows")
    first = near.groupBy("high", "low").agg(F.min(row_order("top")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = near.join(written(first, "first-windows").hint("merge"), ["high", "low"]).where(row_order("top") > F.col("first"))
    return joined_runs(late, "doc_id", "own", gap=1)


def kept_lines(lines: str, runs: str) -> str:
    """SQL: the lines (an array) but for those of runs (first, last, first, last, ...), joined again."""
    start, end = f"if(j = 0, 0, {runs}[2 * j - 1] + 1)", f"if(2 * j = size({runs}), size({lines}), get({runs}, 2 * j))"
    left = f"flatten(transform(sequence(0, size({runs}) div 2), j -> slice({lines}, {start} + 1, {end} - {start})))"
    return f"array_join({left}, '\\n')"


def dedup_lines(docs: DataFrame, width: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """docs with repeated runs deleted from text, plus n_lines, n_removed, n_runs (which replace columns of these names).

    A document that loses all its lines keeps its row with an empty text; null stays null. Lines are compared
    without white space around them; blank lines never count, but go with a run that spans them. Rows of different texts that share a doc_id
    are documents of their own, in the order of their hashes, and so are rows without doc_id, which come last; rows
    that repeat a doc_id and its text count as one document and are treated alike.
    Repeats of fewer lines than `width` stay, unless they have `long_words` words (split at ASCII white space) or more.
    """
    taken = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    found = written(repeats(docs, width, long_words), "line-runs")
    runs, cut = fresh(docs, "runs_found", "cut_lines")
    # Runs grow with the corpus, so the plan is that of a large one at any size: rows meet by hash, and texts are not sorted.
    out = matched_rows(quoted(docs, taken), found.withColumnRenamed("runs", runs).hint("shuffle_hash"), "left", runs)
    # Split in a column of its own: within the lambda below it would be split for each run.
    out = out.withColumn(cut, F.expr(f"if({runs} is null, null, split(text, '\\n'))"))
    lost = F.expr(f"coalesce(aggregate(sequence(0, size({runs}) - 1), 0L, (s, i) -> s + if(i % 2 = 0, 1 - {runs}[i], {runs}[i])), 0L)")
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    return out.select(
        *[F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.expr(kept_lines(cut, runs))).alias("text") if c == "text" else F.col(f"`{c}`") for c in taken],
        lines.alias("n_lines"), lost.alias("n_removed"), F.coalesce(F.size(runs) / 2, F.lit(0)).cast("bigint").alias("n_runs"),
    )


def drop_repeated_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """docs with repeated runs deleted from text, all columns kept; n_chars follows the text where docs has it."""
    out = dedup_lines(docs, long_words=long_words).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_linededup(spark: SparkSession, sf_dir: str, long_words: int | None = None) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long_words=long_words)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_linededup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_linededup, with repeats of one or two lines deleted too where they have LONG_WORDS words or more."""
    return op10_linededup(spark, sf_dir, LONG_WORDS)


SQL = """
WITH raw AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(len(lines))) AS no, trim(unnest(lines), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw),
full_line AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM line WHERE line <> ''),
win AS (SELECT a.doc_id, a.no AS top, c.no AS bottom, a.line || chr(10) || b.line || chr(10) || c.line AS body
        FROM full_line a JOIN full_line b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN full_line c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, top) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(top, bottom + 1)) AS no FROM ranked WHERE r > 1),
kept AS (SELECT r.doc_id, string_agg(x.body, chr(10) ORDER BY x.no) AS body
         FROM raw r JOIN (SELECT doc_id, unnest(range(len(lines))) AS no, unnest(lines) AS body FROM raw) x USING (doc_id)
         LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.no = x.no WHERE g.no IS NULL GROUP BY r.doc_id),
lost AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN NOT joined THEN 1 ELSE 0 END) AS runs
         FROM (SELECT doc_id, no, coalesce(no = lag(no) OVER (PARTITION BY doc_id ORDER BY no) + 1, false) AS joined FROM gone) GROUP BY doc_id)
SELECT r.doc_id, len(r.lines) AS n_lines, coalesce(lost.n, 0) AS n_removed, coalesce(lost.runs, 0)::BIGINT AS n_runs,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM raw r LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: SQL, with the shorter runs among the windows.
LONG_SQL = SQL.replace(
    "win AS (",
    f"""counted AS (SELECT *, len(list_filter(string_split_regex(line, '[ ' || chr(9) || chr(11) || chr(12) || chr(13) || ']+'), lambda x: x <> '')) AS words FROM full_line),
win AS (SELECT doc_id, no AS top, no AS bottom, line AS body FROM counted WHERE words >= {LONG_WORDS}
        UNION ALL SELECT a.doc_id, a.no, b.no, a.line || chr(10) || b.line
        FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.words + b.words >= {LONG_WORDS}
        UNION ALL """,
)

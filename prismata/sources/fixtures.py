"""Views over the driver's tables that stand in for the engine's inputs.

Each view is one SELECT that Spark and DuckDB both read; what differs between them is filled in
by `dialect`. Views may use tables and views that stand before them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SPARK = {"codes": "array_join(array_sort(collect_list(ec_full)), ';')", "letters": "regexp_replace(text, '[^A-Za-z]', '')", "text": "string"}
DUCKDB = {"codes": "string_agg(ec_full, ';' ORDER BY ec_full)", "letters": "regexp_replace(text, '[^A-Za-z]', '', 'g')", "text": "varchar"}

VIEWS: dict[str, str] = {
    # long label table: accession, code and its four levels
    "labels_long": """
        SELECT DISTINCT concat('C', c_custkey) AS accession,
               concat(n_regionkey + 1, '.', n_nationkey, '.',
                      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END,
                      '.', substr(o_orderpriority, 1, 1)) AS ec_full
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""",
    # joined entity table with partial, blank and missing codes and two sources
    "entries": """
        SELECT accession, CASE WHEN key % 17 = 0 THEN '' WHEN key % 19 = 0 THEN '  ' WHEN key % 23 = 0 THEN NULL
                               WHEN key % 11 = 0 THEN concat(substr(codes, 1, length(codes) - 1), '-') ELSE codes END AS ec,
               CASE WHEN key % 3 = 0 THEN 'TrEMBL' ELSE 'SwissProt' END AS source, key
        FROM (SELECT accession, {codes} AS codes, cast(substr(accession, 2) AS bigint) AS key FROM labels_long GROUP BY accession) g""",
    "sequences": """SELECT concat('D', doc_id) AS accession, upper({letters}) AS sequence, lang, source, doc_id FROM documents""",
    "vectors": """SELECT concat('V', vec_id) AS accession, embedding AS vec, label, vec_id,
                         CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM embeddings""",
    "vec_labels": """SELECT accession, concat('L', label) AS ec, split FROM vectors
                     UNION ALL SELECT accession, concat('L', (label + 3) % 10) AS ec, split FROM vectors WHERE vec_id % 7 = 0""",
    # per (cutoff, fold) metrics
    "fold_metrics": """
        SELECT l_linenumber * 10 AS cutoff, cast(l_suppkey % 3 AS int) AS fold, 'acc' AS metric, round(avg(l_discount) * 10, 6) AS value FROM lineitem GROUP BY 1, 2
        UNION ALL
        SELECT l_linenumber * 10 AS cutoff, cast(l_suppkey % 3 AS int) AS fold, 'f1' AS metric, round(avg(l_tax) * 10, 6) AS value FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2""",
    # a status log: alternating start and finish lines per user
    "status_lines": """
        SELECT concat(cast(event_id AS {text}), ' phase=', event_type, ' cutoff=', user_id % 4, ' event=',
                      CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END) AS line, event_id AS line_no, ts, user_id, event_type
        FROM events""",
}


def needed(names: list[str]) -> list[str]:
    """The views, and those that they use, in order."""
    order = list(VIEWS)
    found = set(names)
    for v in reversed(order):
        if v in found:
            found |= {u for u in order if f" {u} " in f"{VIEWS[v]} ".replace("\n", " ")}
    return [v for v in order if v in found]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = [t for t in TABLES if any(f" {t} " in f"{VIEWS[v]} ".replace("\n", " ") or VIEWS[v].rstrip().endswith(f" {t}") for v in needed([name]))]
    # Spark fills in {table} with the DataFrame itself, so that no view of the caller's is touched; view names are common table expressions.
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**SPARK)})" for v in needed([name]))
    ctes = re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", ctes)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def sql(body: str, *views: str, **ctes: str) -> str:
    """DuckDB SQL: the views, further common table expressions, and the body."""
    parts = [f"{v} AS ({VIEWS[v].format(**DUCKDB)})" for v in needed(list(views))] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body

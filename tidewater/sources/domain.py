"""The engine's domain tables, derived from the star-schema and text tables.

Each derivation is one SELECT that Spark and an ANSI engine both run; {STR} and {SHA} are the two
dialects' names.  Queries get the tables as DataFrames, oracles as leading common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: .NET ticks of 2026-01-01, and ticks a second.
EPOCH_2026, SECOND = 639028224000000000, 10_000_000

_PATH = "'/src/' || source || '/' || lang || '/' || CAST(doc_id AS {STR}) || CASE WHEN doc_id % 5 = 0 THEN '.tmp' WHEN doc_id % 5 = 1 THEN '.bak' ELSE '.txt' END"
_MTIME = f"{EPOCH_2026} + doc_id * {SECOND}"

TABLES = {
    "inventory": f"SELECT doc_id, {_PATH} AS path, n_chars AS size, {_MTIME} AS mtime, doc_id % 64 AS attrs, {{SHA}}(text) AS hash, CAST(doc_id % 97 AS {{STR}}) || '-' || CAST(doc_id AS {{STR}}) AS file_id FROM documents",
    "previous": f"""SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, {_MTIME} + CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 0 END AS mtime, {{SHA}}(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 3
        UNION ALL SELECT doc_id, '/src/stale/' || CAST(doc_id AS {{STR}}) || '.txt', n_chars, {_MTIME}, {{SHA}}(text) FROM documents WHERE doc_id % 11 = 0""",
    "state": f"""SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 9 = 0 THEN n_chars + 2 ELSE n_chars END AS size, {_MTIME} AS mtime, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 97 AS {{STR}}) || '-' || CAST(doc_id AS {{STR}}) END AS file_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS ctime, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE {{SHA}}(text) END AS hash FROM documents WHERE doc_id % 8 <> 5
        UNION ALL SELECT doc_id, '/src/old/' || CAST(doc_id AS {{STR}}) || '.dat', n_chars, {_MTIME}, CAST(doc_id % 97 AS {{STR}}) || '-' || CAST(doc_id AS {{STR}}), 0, {{SHA}}(text) FROM documents WHERE doc_id % 8 = 5 AND doc_id % 3 = 0""",
    "dest": f"""SELECT '/dst/' || source || '/' || lang || '/' || CAST(doc_id AS {{STR}}) || CASE WHEN doc_id % 5 = 0 THEN '.tmp' WHEN doc_id % 5 = 1 THEN '.bak' ELSE '.txt' END AS path, source || '/' || lang || '/' || CAST(doc_id AS {{STR}}) || CASE WHEN doc_id % 5 = 0 THEN '.TMP' WHEN doc_id % 5 = 1 THEN '.bak' ELSE '.txt' END AS rel, n_chars AS size, {_MTIME} AS mtime, {{SHA}}(CASE WHEN doc_id % 12 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 6 <> 1
        UNION ALL SELECT '/dst/gone/' || CAST(doc_id AS {{STR}}) || '.txt', 'gone/' || CAST(doc_id AS {{STR}}) || '.txt', n_chars, {_MTIME}, {{SHA}}(text) FROM documents WHERE doc_id % 17 = 0
        UNION ALL SELECT '/dst/.versions/' || CAST(doc_id AS {{STR}}), '.versions/' || CAST(doc_id AS {{STR}}), n_chars, {_MTIME}, {{SHA}}(text) FROM documents WHERE doc_id % 50 = 0""",
    "changes": "SELECT event_id, ts, CAST(user_id AS {STR}) AS path, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'purchase' THEN 'Renamed' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS change_type, CAST(round(value * 100) AS BIGINT) AS bytes FROM events",
    "versions": "SELECT o_orderkey AS id, o_custkey AS grp, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderdate END AS stamp, o_orderpriority = '1-URGENT' AS pinned FROM orders",
    "entries": "SELECT l_orderkey AS generation, CAST(l_linenumber AS BIGINT) AS idx, min(l_partkey) AS digest, CAST(min(l_quantity) AS BIGINT) AS size, min(l_partkey) % 9 = 0 AS is_hole, CASE WHEN min(l_partkey) % 14 = 0 THEN min(l_partkey) + 1 ELSE NULL END AS base FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "chunk_index": "SELECT p_partkey AS digest, p_brand AS pack, CAST(p_size AS BIGINT) AS stored, p_partkey * 64 AS pack_offset, CAST(floor(p_retailprice) AS BIGINT) AS size_bytes FROM part WHERE p_partkey % 23 <> 0",
    "manifests": "SELECT o_orderkey AS generation, o_custkey AS part_key, o_orderdate AS created, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderkey % 3 AS grid FROM orders",
    "turns": "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent, conv_id, turn, text AS name FROM conversations WHERE conv_id % 7 <> 0 OR turn <> 1",
    "tree": """SELECT CAST(r_regionkey AS BIGINT) + 1 AS ref, CAST(0 AS BIGINT) AS parent, r_name AS name, TRUE AS is_dir FROM region
        UNION ALL SELECT 100 + CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) + 1, n_name, TRUE FROM nation
        UNION ALL SELECT 1000 + c_custkey, 100 + CAST(c_nationkey AS BIGINT), c_name, FALSE FROM customer""",
    "extents": "SELECT l_orderkey % 50 AS vol, l_orderkey * 10 + l_linenumber AS id, min(l_partkey) % 400 AS lo, CAST(min(l_quantity) AS BIGINT) AS cnt FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey, l_linenumber",
    "holds": f"SELECT c_custkey AS batch_id, {EPOCH_2026} + c_custkey * 36000000000 AS blocked_at, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE {EPOCH_2026} + c_custkey * 18000000000 END AS last_warning_at FROM customer WHERE c_custkey % 3 = 0",
    "pending": "SELECT DISTINCT o_orderkey AS path_key, o_custkey AS batch_id, o_orderpriority = '1-URGENT' AS claimed FROM orders WHERE o_custkey % 3 = 0",
}


def _render(sql: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


_ANSI = {"STR": "VARCHAR", "SHA": "sha256"}
_SPARK = {"STR": "STRING"}


def _spark_sql(name: str) -> str:
    sql = _render(TABLES[name], _SPARK)
    # sha2 takes the width as a second argument
    while "{SHA}(" in sql:
        at = sql.index("{SHA}(") + 6
        depth, end = 1, at
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: at - 6] + "sha2(" + sql[at : end - 1] + ", 256)" + sql[end:]
    return sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a domain table over the base tables it names."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\bFROM {t}\b", TABLES[name])}
    sql = _spark_sql(name)
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_tables(sql: str) -> str:
    """The oracle's SQL with the domain tables it names in front."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{t} AS ({_render(TABLES[t], _ANSI)})" for t in used)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"

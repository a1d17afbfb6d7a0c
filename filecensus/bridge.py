"""Views that read the test tables as file estates.

The texts are plain SQL that Spark and DuckDB both run; `{name}` stands for a table or another view,
`{sha}`/`{sha_end}` and `{len}` for the two functions whose names differ. Modulo terms only spread
scenario attributes (names, dates, states) over the rows; every row takes part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    # A catalog with one file per document.
    "catalog": """
SELECT doc_id AS ordinal, CAST(doc_id AS STRING) AS file_id, name,
       concat(source, '/', CASE WHEN lang = 'en' THEN '' ELSE concat(lang, '/') END,
              CAST(doc_id AS STRING), '/', name) AS rel_path,
       concat(source, '/', lang, '/', name) AS listed_path,
       CASE k % 10 WHEN 5 THEN 'image/jpeg' WHEN 6 THEN 'application/vnd.google-apps.document'
                   ELSE 'text/plain' END AS mime_type,
       CAST({len}(body) AS BIGINT) AS size, source AS drive_id,
       CASE WHEN doc_id % 29 = 0 THEN '' ELSE source END AS drive_name, lang AS owner,
       CASE WHEN doc_id % 41 = 0 THEN ''
            ELSE concat(CAST(2015 + k % 9 AS STRING), '-05-01T00:00:00Z') END AS modified_time,
       CASE WHEN doc_id % 71 = 0 THEN '' ELSE {sha}body{sha_end} END AS sha256,
       '' AS exported_as,
       CASE WHEN doc_id % 97 = 0 THEN 'error' WHEN doc_id % 89 = 0 THEN 'restricted' ELSE 'done' END AS status,
       CASE WHEN doc_id % 97 = 0 THEN 'timeout' ELSE '' END AS error
FROM (SELECT *, CASE WHEN doc_id % 53 = 0 THEN '' ELSE text END AS body,
             CASE WHEN doc_id % 3 = 0 THEN upper(n) ELSE n END AS name
      FROM (SELECT *, CASE WHEN k % 17 = 0 THEN 'Thumbs.db' WHEN k % 13 = 0 THEN concat('~$doc_', CAST(k AS STRING), '.doc')
                  ELSE concat('doc_', CAST(k % 4 AS STRING),
                   CASE k % 10 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' WHEN 3 THEN '.json'
                               WHEN 4 THEN '.html' WHEN 5 THEN '.jpg' WHEN 6 THEN '.pdf' WHEN 7 THEN '.xyz'
                               WHEN 8 THEN '.tmp' ELSE '' END) END AS n
            FROM (SELECT *, CAST(floor(doc_id / 20) AS BIGINT) AS k FROM {documents}) a) b) c
""",
    # The same catalog once every failed file was fetched after all.
    "settled": """
SELECT ordinal, file_id, name, rel_path, mime_type, size, drive_id, drive_name, owner, modified_time, sha256,
       exported_as, CASE WHEN status = 'error' THEN 'done' ELSE status END AS status, '' AS error
FROM {catalog}
""",
    # The snapshot before: Spanish files are new since, as many others vanished.
    "previous": """
SELECT file_id, CASE WHEN status = 'restricted' THEN 'error' ELSE status END AS status,
       CASE WHEN ordinal % 15 = 0 THEN '2014-01-01T00:00:00Z' ELSE modified_time END AS modified_time,
       CASE WHEN ordinal % 44 = 0 THEN size + 1 ELSE size END AS size,
       concat('old/', rel_path) AS rel_path, sha256
FROM {catalog} WHERE owner <> 'es'
UNION ALL
SELECT concat('ghost', file_id), CASE WHEN size > 2000 THEN 'error' ELSE 'done' END, modified_time, size,
       concat('old/', rel_path), sha256
FROM {catalog} WHERE owner = 'es'
""",
    # The previous snapshot's files on disk; some were cut, changed or lost.
    "previous_tree": """
SELECT rel_path, CASE WHEN file_id LIKE '%7' AND size > 3000 THEN size - 1 ELSE size END AS size,
       CASE WHEN file_id LIKE '%3' THEN reverse(sha256) ELSE sha256 END AS sha256,
       NOT (file_id LIKE '%99') AS readable
FROM {previous} WHERE file_id NOT LIKE '%58'
""",
    # The primary's own files, all in order.
    "primary_tree": """
SELECT rel_path, size, sha256, TRUE AS readable FROM {settled} WHERE status = 'done'
""",
    # A mirror that holds all of them, and files of its own besides.
    "intact_mirror": """
SELECT rel_path, size, sha256, TRUE AS readable FROM {settled} WHERE status = 'done'
UNION ALL
SELECT concat('own/', rel_path), size + 1, sha256, owner <> 'de' FROM {settled} WHERE status = 'done'
""",
    # A mirror with lost, cut and damaged files.
    "mirror": """
SELECT rel_path, CASE WHEN ordinal % 37 = 0 THEN size + 1 ELSE size END AS size,
       CASE WHEN ordinal % 43 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256,
       ordinal % 59 <> 0 AS readable
FROM {catalog} WHERE status = 'done' AND NOT (owner = 'de' AND drive_id = 'src3')
""",
    # What lies on two mirrors: (dest, rel_path, size).
    "mirror_trees": """
SELECT 'ext' AS dest, rel_path, size FROM {mirror}
UNION ALL
SELECT 'primary' AS dest, rel_path, CASE WHEN ordinal % 47 = 0 THEN 0 ELSE size END AS size
FROM {catalog} WHERE status = 'done' AND NOT (owner = 'fr' AND drive_id = 'src3')
                 AND NOT (owner = 'de' AND drive_id = 'src3' AND size > 3000)
""",
    # Snapshots: one per order, its entries are the order's lines.
    "snapshots": """
SELECT CAST(o_custkey AS STRING) AS account,
       concat(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '_' ELSE '' END,
              lpad(CAST(o_orderkey AS STRING), 12, '0')) AS snapshot, o_orderkey,
       CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 3 ELSE 5 END AS BIGINT) AS expected_total
FROM {orders}
""",
    "snapshot_entries": """
SELECT l_orderkey AS o_orderkey, CAST(l_quantity AS BIGINT) AS size,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 30 THEN 'error'
            WHEN l_returnflag = 'A' THEN 'restricted' ELSE 'done' END AS status
FROM {lineitem}
""",
    # A log of entry updates: each user is a file, each event a new state of it.
    "entry_log": """
SELECT event_id AS ordinal, CAST(user_id AS STRING) AS file_id, event_type AS status,
       CAST(round(value * 100) AS BIGINT) AS size
FROM {events}
""",
    # A drive listing: region folders hold nations, these customers, these orders.
    "items": """
SELECT CASE WHEN r_regionkey <= 2 THEN 0 ELSE 1 END AS source_ordinal,
       CASE WHEN r_regionkey <= 2 THEN '' ELSE 'team' END AS drive_id,
       CASE WHEN r_regionkey <= 2 THEN 'My Drive' ELSE 'Team: east' END AS drive_name,
       FALSE AS shared_with_me, t.*
FROM {region} r JOIN (
  SELECT r_regionkey AS rk, CAST(r_regionkey AS BIGINT) * 4 AS position, concat('r', CAST(r_regionkey AS STRING)) AS id,
         r_name AS name, 'application/vnd.google-apps.folder' AS mime_type, CAST(NULL AS STRING) AS parent,
         CAST(NULL AS STRING) AS size, '2020-01-01T00:00:00Z' AS modified_time, CAST(NULL AS STRING) AS shortcut_target
  FROM {region}
  UNION ALL
  SELECT n_regionkey, CAST(n_nationkey AS BIGINT) * 4 + 1, concat('n', CAST(n_nationkey AS STRING)), n_name,
         CASE WHEN n_regionkey = 4 THEN 'text/plain' ELSE 'application/vnd.google-apps.folder' END,
         concat('r', CAST(n_regionkey AS STRING)), '7', '2020-01-01T00:00:00Z', NULL
  FROM {nation}
  UNION ALL
  SELECT n_regionkey, c_custkey * 4 + 2, concat('c', CAST(c_custkey AS STRING)), c_name,
         'application/vnd.google-apps.folder', concat('n', CAST(c_nationkey AS STRING)), NULL, '2020-01-01T00:00:00Z', NULL
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL
  SELECT n_regionkey, o_orderkey * 4 + 3, concat('o', CAST(o_orderkey AS STRING)),
         concat('ord:', CAST(o_orderkey AS STRING), '?.pdf'),
         CASE o_orderpriority WHEN '1-URGENT' THEN 'application/vnd.google-apps.document'
                              WHEN '2-HIGH' THEN 'application/vnd.google-apps.form'
                              WHEN '3-MEDIUM' THEN 'application/vnd.google-apps.spreadsheet' ELSE 'application/pdf' END,
         concat('c', CAST(o_custkey AS STRING)), CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '2021-01-01T00:00:00Z',
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'elsewhere' ELSE NULL END
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
) t ON r_regionkey = rk
UNION ALL
SELECT 2, '', 'Shared with me', TRUE, CAST(NULL AS INT), o_orderkey * 4 + 3, concat('o', CAST(o_orderkey AS STRING)),
       concat('ord:', CAST(o_orderkey AS STRING), '?.pdf'), 'application/pdf', NULL,
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '2021-01-01T00:00:00Z', NULL
FROM {orders} WHERE o_totalprice > 400000 OR o_orderpriority = '2-HIGH'
""",
    # The files of the catalog with their texts.
    "texts": """
SELECT c.ordinal, c.rel_path, c.listed_path, coalesce(d.text, '') AS text
FROM {catalog} c JOIN {documents} d ON d.doc_id = c.ordinal
""",
    # Folders of another account that are shared with this one: their roots, and some files that are listed besides.
    "shared_listing": """
SELECT * FROM {items} WHERE source_ordinal = 0
UNION ALL
SELECT 2 AS source_ordinal, '' AS drive_id, 'Shared with me' AS drive_name, TRUE AS shared_with_me, rk, position, id, name,
       mime_type, CAST(NULL AS STRING) AS parent, size, modified_time, shortcut_target
FROM {items} WHERE source_ordinal = 1 AND (id LIKE 'n%' OR (id LIKE 'o%' AND CAST(size AS BIGINT) > 250000))
""",
    "shared_children": """
SELECT parent AS folder_id, position, id, name, mime_type, parent, size, modified_time, shortcut_target
FROM {items} WHERE source_ordinal = 1 AND parent IS NOT NULL
""",
    # Heartbeats and transfers: each user is an account.
    "heartbeats": """
SELECT CAST(user_id AS STRING) AS account, ts, CAST(floor(event_id / 20) AS BIGINT) AS done,
       CAST(400 + user_id AS BIGINT) AS expected,
       CAST(CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS BIGINT) AS errors,
       event_id * 1000 + CAST(round(value * 100) AS BIGINT) AS bytes_written,
       CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1000000000 END AS BIGINT) AS expected_bytes,
       CAST(CASE WHEN event_type = 'view' THEN 5000 ELSE 0 END AS BIGINT) AS bytes_inflight,
       CAST(event_id % 1000 AS DOUBLE) AS elapsed_s,
       CASE WHEN event_type = 'click' THEN CAST(NULL AS DOUBLE) WHEN event_type = 'signup' THEN 0.0
            ELSE value * 1000 END AS rate_bps
FROM {events}
""",
    "headers": """
SELECT CAST(c_custkey AS STRING) AS account, CAST(100 + c_custkey % 50 AS BIGINT) AS count,
       CAST(c_custkey % 120 AS BIGINT) AS done,
       CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 130 END AS BIGINT) AS expected_total,
       CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS total_bytes,
       CAST(CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 1000000 END AS BIGINT) AS expected_bytes
FROM {customer}
""",
    "attempts": """
SELECT event_id AS ordinal, CAST(user_id AS STRING) AS account, ts, concat('f', CAST(event_id AS STRING)) AS file_id,
       CASE event_type WHEN 'click' THEN CASE WHEN user_id % 5 = 0 AND value > 20 THEN 'import' ELSE 'success' END
                       WHEN 'signup' THEN CASE WHEN value > 60 THEN 'skip' ELSE 'restricted' END
                       WHEN 'view' THEN CASE WHEN value > 80 THEN 'repair' ELSE 'error' END ELSE 'error' END AS outcome,
       CAST(round(value * 100) AS BIGINT) AS size, props AS error,
       CASE event_type WHEN 'error' THEN 403 WHEN 'view' THEN 500 WHEN 'signup' THEN 404 END AS http_status,
       CASE WHEN value > 15 THEN 'userRateLimitExceeded' ELSE 'cannotDownloadAbusiveFile' END AS reason,
       CASE WHEN event_type = 'purchase' THEN CAST(user_id % 30 AS INT) END AS errno,
       CASE WHEN event_type = 'click' AND value > 30 THEN 'ConnectionResetError'
            WHEN event_type = 'click' AND value > 25 THEN 'ResponseNotReady'
            WHEN event_type = 'click' AND value > 20 THEN 'SSLEOFError'
            WHEN event_type = 'purchase' AND value > 50 THEN 'gaierror'
            WHEN event_type = 'view' AND value > 90 THEN 'gaierror' END AS exc_type
FROM {events}
""",
    "vectors": """
SELECT vec_id AS ordinal, concat('notes/', CAST(label AS STRING), '/', CAST(vec_id AS STRING), '.txt') AS rel_path,
       CAST(1000 + vec_id * 7 AS BIGINT) AS size, CAST(embedding AS {doubles}) AS embedding
FROM {embeddings}
""",
}

_DIALECTS = {
    "spark": {"sha": "sha2(", "sha_end": ", 256)", "len": "octet_length", "doubles": "ARRAY<DOUBLE>"},
    "duckdb": {"sha": "sha256(", "sha_end": ")", "len": "strlen", "doubles": "DOUBLE[]"},
}


def render(text: str, dialect: str, tables: dict[str, str]) -> str:
    """SQL with views inlined; names this module does not know are left for the caller."""
    words = _DIALECTS[dialect]

    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name in words:
            return words[name]
        if name in tables:
            return tables[name]
        if name in VIEWS:
            return f"({render(VIEWS[name], dialect, tables)})"
        return match.group(0)

    return re.sub(r"\{(\w+)\}", fill, text)


def spark_view(spark: SparkSession, folder: str, text: str, **frames: DataFrame) -> DataFrame:
    """A view by name, or any text over views, as a DataFrame; `frames` are tables of the caller's."""
    tables = {name: f"parquet.`{folder}/{name}.parquet`" for name in TABLES}
    tables.update({name: "{" + name + "}" for name in frames})
    return spark.sql(render(VIEWS.get(text, text), "spark", tables), **frames)


def duckdb_sql(text: str) -> str:
    """The same text for DuckDB, where the tables are views of their own name."""
    return render(text, "duckdb", {name: name for name in TABLES}).strip()

"""The queries in DuckDB SQL, written apart from the operators."""

from __future__ import annotations

from filecensus.bridge import duckdb_sql
from filecensus.queries import (
    ANSWER_CATEGORIES, AS_OF, DESTINATIONS, DRAFT_PLAN, EDITED_PLAN, LETTERS, LIVE_SECONDS, MARGIN_GB, MIRRORS, NEAR_THRESHOLD,
    RUN_LIMIT, TEXT_THRESHOLD)


# Fixed values, stated apart from the rules: what the names in the tables come under, and the texts of reasons.
_CATEGORIES = {
    "Images": [".jpg"], "Documents": [".txt", ".md", ".pdf", ".doc"], "Spreadsheets": [".csv"], "Code": [".json", ".html"],
    "Data": [".db"],
}
_JUNK_NAMES, _JUNK_SUFFIXES = ["thumbs.db", "desktop.ini", ".ds_store"], [".tmp"]
_REASONS = {"system": "fichier système", "temporary": "fichier temporaire", "empty": "fichier vide (0 octet)",
            "duplicate": "doublon exact"}
_TEXT_SUFFIXES = [".txt", ".md", ".csv", ".json", ".html"]
_OFFICE = [("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
           ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx")]


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


_NAME = "regexp_extract({p}, '[^/]*$')"
_SUFFIX = r"regexp_extract({n}, '^.+(\.[^.]+)$', 1)"


def _name(path: str) -> str:
    return _NAME.format(p=path)


def _suffix(name: str) -> str:
    return _SUFFIX.format(n=name)


def _category(path: str) -> str:
    ext = f"lower({_suffix(_name(path))})"
    cases = " ".join(f"WHEN {ext} IN ({_quoted(exts)}) THEN '{cat}'" for cat, exts in _CATEGORIES.items())
    return f"CASE {cases} ELSE 'Other' END"


def _junk(path: str, size: str) -> str:
    n = _name(path)
    names = _JUNK_NAMES
    return (
        f"CASE WHEN lower({n}) IN ({_quoted(names)}) THEN 'system' "
        f"WHEN {n} LIKE '~$%' OR {n} LIKE '.~%' THEN 'temporary' "
        f"WHEN lower({_suffix(n)}) IN ({_quoted(_JUNK_SUFFIXES)}) THEN 'temporary' "
        f"WHEN {size} = 0 THEN 'empty' END")


def _year(missing: str) -> str:
    return f"left(CASE WHEN modified_time = '' THEN '{missing}' ELSE modified_time END, 4)"


def _tidy(path: str) -> str:
    return f"concat({_category(path)}, '/', {_year('0000')}, '/', {_name(path)})"


def _label(code: str) -> str:
    cases = " ".join(f"WHEN '{key}' THEN '{label}'" for key, label in _REASONS.items())
    return f"CASE {code} {cases} ELSE '' END"


def _classified(view: str = "catalog") -> str:
    return f"""
SELECT *, CASE WHEN junk IS NOT NULL THEN 'junk' WHEN place > 1 THEN 'duplicate' ELSE 'clean' END AS verdict
FROM (SELECT *, {_junk('rel_path', 'size')} AS junk,
             CASE WHEN sha256 = '' THEN 1 ELSE row_number() OVER (PARTITION BY sha256
                  ORDER BY length(rel_path) - length(replace(rel_path, '/', '')), length(rel_path), rel_path, ordinal) END AS place,
             CASE WHEN sha256 = '' THEN 1 ELSE count(*) OVER (PARTITION BY sha256) END AS copies
      FROM {{{view}}} WHERE status = 'done')"""


def _groups(view: str = "catalog") -> str:
    return f"""
SELECT 'exact' AS kind, sha256 AS key, max(CASE WHEN place = 1 THEN rel_path END) AS "primary",
       count(*) - 1 AS n_duplicates, CAST(sum(CASE WHEN place > 1 THEN size ELSE 0 END) AS BIGINT) AS reclaimable_bytes
FROM ({_classified(view)}) WHERE copies > 1 GROUP BY sha256"""


def _default_plan(view: str = "catalog") -> str:
    return f"""
SELECT ordinal, CASE WHEN verdict = 'clean' THEN 'keep' ELSE 'quarantine' END AS action, rel_path AS src_rel,
       CASE verdict WHEN 'junk' THEN concat('_quarantine/junk/', {_name('rel_path')})
                    WHEN 'duplicate' THEN concat('_quarantine/duplicates/', {_name('rel_path')})
                    ELSE {_tidy('rel_path')} END AS dest_rel,
       {_label("CASE WHEN verdict = 'duplicate' THEN 'duplicate' ELSE junk END")} AS reason
FROM ({_classified(view)})"""


def _unique(rows: str, path: str, tag: str, out: str, taken: str | None = None) -> str:
    """Names without clashes between different candidate lists: plain ranks decide them."""
    used = f"lower({path}) IN (SELECT lower(path) FROM ({taken}))" if taken else "FALSE"
    name, folder = _name(path), f"left({path}, length({path}) - length({_name(path)}))"
    suffix = _suffix(name)
    stem = f"left({name}, length({name}) - length({suffix}))"
    return f"""
SELECT *, CASE WHEN place = 0 THEN {path}
               ELSE concat({folder}, {stem}, '__', {tag}, CASE WHEN place = 1 THEN '' ELSE concat('_', place - 1) END, {suffix})
          END AS {out}
FROM (SELECT *, nth + CASE WHEN grp = lead_ordinal AND NOT taken THEN 0 ELSE 1 END AS place
      FROM (SELECT *, {used} AS taken,
                   row_number() OVER (PARTITION BY lower({path}), lower({tag}) ORDER BY ordinal) - 1 AS nth,
                   min(ordinal) OVER (PARTITION BY lower({path}), lower({tag})) AS grp,
                   min(ordinal) OVER (PARTITION BY lower({path})) AS lead_ordinal
            FROM ({rows})))"""


_TAG = "CASE WHEN sha256 = '' THEN 'dup' ELSE left(sha256, 8) END"


def _routing(view: str = "catalog", taken: str | None = None) -> str:
    rows = f"""
SELECT ordinal, rel_path AS src_rel, size, {_TAG} AS tag, CASE WHEN verdict = 'clean' THEN 'copied' ELSE verdict END AS kind,
       CASE verdict WHEN 'junk' THEN concat('_quarantine/junk/', {_name('rel_path')})
                    WHEN 'duplicate' THEN concat('_quarantine/duplicates/', {_name('rel_path')})
                    ELSE {_tidy('rel_path')} END AS wanted
FROM ({_classified(view)})"""
    return f"SELECT ordinal, src_rel, dest_rel, kind, size FROM ({_unique(rows, 'wanted', 'tag', 'dest_rel', taken)})"


_EDITED = EDITED_PLAN.replace("{plan}", f"({_default_plan()})")
_DRAFT = DRAFT_PLAN.replace("{edited}", f"({_EDITED})")
_ACTION = "lower(trim(CASE WHEN action = '' THEN 'keep' ELSE action END))"
_APPLIED = f"""
SELECT ordinal, src_rel, sha256, size, action,
       CASE action WHEN 'quarantine' THEN CASE WHEN asked LIKE '\\_quarantine/%' ESCAPE '\\' THEN asked ELSE concat('_quarantine/', asked) END
                   WHEN 'keep' THEN CASE WHEN asked LIKE '\\_quarantine/%' ESCAPE '\\' THEN concat('Kept/', {_name('src_rel')}) ELSE asked END
       END AS wanted
FROM (SELECT c.ordinal, p.src_rel, sha256, size, {_ACTION} AS action,
             regexp_replace(CASE WHEN dest_rel = '' THEN {_tidy('rel_path')} ELSE dest_rel END, '(/+\\./+|/+)', '/', 'g') AS asked
      FROM {{catalog}} c JOIN (
        SELECT src_rel, arg_max(action, plan_ordinal) AS action, arg_max(dest_rel, plan_ordinal) AS dest_rel
        FROM ({_EDITED}) GROUP BY src_rel) p ON c.rel_path = p.src_rel
      WHERE status = 'done')"""
_PLAN_ROWS = f"""
SELECT ordinal, src_rel, size, {_TAG} AS tag, wanted,
       CASE WHEN action = 'keep' THEN 'copied' WHEN contains(wanted, '_quarantine/junk') THEN 'junk' ELSE 'duplicate' END AS kind
FROM ({_APPLIED}) WHERE action <> 'skip'"""

_COMPLETE = """
SELECT o_orderkey, NOT (reason IN ('failed', 'missing')) AS complete, reason, accounted, expected, n_failed, n_restricted
FROM (SELECT *, CASE WHEN n_failed > 0 THEN 'failed' WHEN expected <> 0 AND accounted < expected THEN 'missing'
                     WHEN n_restricted > 0 THEN 'restricted' WHEN expected = 0 THEN 'unproven' ELSE 'complete' END AS reason
      FROM (SELECT s.o_orderkey, expected_total AS expected, count(*) FILTER (status IN ('done', 'restricted')) AS accounted,
                   count(*) FILTER (status NOT IN ('done', 'restricted')) AS n_failed,
                   count(*) FILTER (status = 'restricted') AS n_restricted
            FROM {snapshots} s LEFT JOIN {snapshot_entries} e ON s.o_orderkey = e.o_orderkey
            GROUP BY s.o_orderkey, expected_total))"""

_VERIFIED = """
SELECT c.ordinal, c.rel_path, c.size, c.status, c.sha256,
       CASE WHEN m.rel_path IS NULL THEN 'missing' WHEN m.size <> c.size THEN 'size_mismatch'
            WHEN c.sha256 <> '' AND (NOT m.readable OR m.sha256 <> c.sha256) THEN 'hash_mismatch' ELSE 'ok' END AS outcome
FROM {%s} c LEFT JOIN {%s} m ON c.rel_path = m.rel_path"""

_LISTING_TOTALS = """
SELECT *, native_pending * 10485760 AS native_reserve, remaining_known + native_pending * 10485760 AS required_bytes
FROM (SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS known_bytes,
             count(*) FILTER (mime_type LIKE 'application/vnd.google-apps%') AS native_files,
             count(*) FILTER (mime_type LIKE 'application/vnd.google-apps%' AND status <> 'done') AS native_pending,
             CAST(coalesce(sum(CASE WHEN status <> 'done' THEN size END), 0) AS BIGINT) AS remaining_known FROM {catalog})"""

_SAFE_CLEAN = r"""regexp_replace(regexp_replace(name, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'),
       '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s.\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"""

_TREE = """
WITH RECURSIVE named AS (
  SELECT *, regexp_replace(name, '[<>:"/\\\\|?*]', '_', 'g') AS safe FROM {items}),
paths AS (
  SELECT source_ordinal, id, concat(replace(drive_name, ':', '_'), '/', safe) AS rel_path
  FROM named WHERE parent IS NULL
  UNION ALL
  SELECT n.source_ordinal, n.id, concat(p.rel_path, '/', n.safe)
  FROM named n JOIN paths p ON n.source_ordinal = p.source_ordinal AND n.parent = p.id)"""

_NEAR = """
WITH RECURSIVE v AS ({rows}),
pairs AS (SELECT a.ordinal AS i, b.ordinal AS j, list_cosine_similarity(a.embedding, b.embedding) AS sim
          FROM v a JOIN v b ON a.ordinal < b.ordinal AND list_cosine_similarity(a.embedding, b.embedding) >= {threshold}),
nodes AS (SELECT row_number() OVER (ORDER BY id) AS step, id, smaller
          FROM (SELECT n.id, coalesce((SELECT list(i) FROM pairs WHERE j = n.id), []) AS smaller
                FROM (SELECT i AS id FROM pairs UNION SELECT j FROM pairs) n)),
greedy AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS anchors
           UNION ALL
           SELECT n.step, CASE WHEN list_has_any(g.anchors, n.smaller) THEN g.anchors ELSE list_append(g.anchors, n.id) END
           FROM greedy g JOIN nodes n ON n.step = g.step + 1),
chosen AS (SELECT unnest(anchors) AS id FROM (SELECT anchors FROM greedy ORDER BY step DESC LIMIT 1)),
members AS (SELECT j AS ordinal, min(i) AS anchor, arg_min(sim, i) AS similarity FROM pairs
            WHERE i IN (SELECT id FROM chosen) AND j NOT IN (SELECT id FROM chosen) GROUP BY j)"""
_NEAR_GROUPS = """
SELECT 'near' AS kind, a.rel_path AS key, a.rel_path AS "primary", count(*) AS n_duplicates,
       CAST(sum(m.size) AS BIGINT) AS reclaimable_bytes
FROM members JOIN v a ON a.ordinal = anchor JOIN v m ON m.ordinal = members.ordinal GROUP BY a.rel_path"""


def _near(rows: str, threshold: float = NEAR_THRESHOLD) -> str:
    return _NEAR.replace("{rows}", rows).replace("{threshold}", str(threshold))


_TEXT_ROWS = f"""
SELECT c.ordinal, c.rel_path, c.size, e.embedding FROM {{catalog}} c JOIN {{vectors}} e ON c.ordinal = e.ordinal
WHERE status = 'done' AND lower({_suffix(_name('c.rel_path'))}) IN ({_quoted(_TEXT_SUFFIXES)})"""


_LETTER_ROWS = f"""
SELECT ordinal, rel_path, size, embedding FROM (
  SELECT c.ordinal, c.rel_path, c.size,
         list_transform(string_split({_quoted([" ".join(LETTERS)])}, ' '),
                        lambda x: CAST(length(lower(t.text)) - length(replace(lower(t.text), x, '')) AS DOUBLE)) AS embedding
  FROM {{catalog}} c JOIN {{texts}} t ON t.ordinal = c.ordinal
  WHERE status = 'done' AND lower({_suffix(_name('c.rel_path'))}) IN ({_quoted(_TEXT_SUFFIXES)}))
WHERE list_sum(embedding) > 0"""


def _described(states: str) -> str:
    return f"""
SELECT account, done, expected, errors, bytes_written, expected_bytes, bytes_inflight,
       round_even((rate_bps) * 1e3, 0) / 1e3 + 0.0 AS rate_bps, source, effective_bytes, round_even((pct) * 1e2, 0) / 1e2 + 0.0 AS pct,
       round_even((CASE WHEN expected_bytes <> 0 THEN 100.0::DOUBLE * effective_bytes / expected_bytes ELSE pct END) * 1e2, 0) / 1e2 + 0.0 AS pct_bytes,
       round_even((remaining) * 1e3, 0) / 1e3 + 0.0 AS remaining_bytes,
       CASE WHEN rate_bps <= 0 THEN '?' WHEN secs >= 3600 THEN printf('%dh%02dm', secs // 3600, secs % 3600 // 60)
            WHEN secs >= 60 THEN printf('%dm%02ds', secs // 60, secs % 60) ELSE printf('%ds', secs) END AS eta,
       expected > 0 AND done + errors >= expected AS finished
FROM (SELECT *, CASE WHEN rate_bps > 0 THEN CAST(floor(remaining / rate_bps) AS BIGINT) ELSE 0 END AS secs
      FROM (SELECT *, bytes_written + bytes_inflight AS effective_bytes,
                   CASE WHEN expected <> 0 THEN 100.0::DOUBLE * done / expected ELSE 0 END AS pct,
                   CASE WHEN expected_bytes <> 0 THEN CAST(greatest(0, expected_bytes - bytes_written - bytes_inflight) AS DOUBLE)
                        ELSE greatest(0, expected - done) * CASE WHEN done <> 0 THEN bytes_written::DOUBLE / done ELSE 0 END END AS remaining
            FROM ({states})))"""


_LATEST = """
SELECT account, done, expected, errors, bytes_written, expected_bytes, bytes_inflight,
       coalesce(rate_bps, CASE WHEN elapsed_s > 0 THEN bytes_written / elapsed_s ELSE 0 END) AS rate_bps, 'heartbeat' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, bytes_written DESC, done DESC, expected DESC, errors DESC) AS rn FROM {heartbeats}) WHERE rn = 1"""
_SNAPSHOT = f"""
SELECT * FROM ({_LATEST})
UNION ALL
SELECT account, done, expected_total, greatest(0, count - done), total_bytes, expected_bytes, 0, 0.0, 'manifest'
FROM {{headers}} WHERE account NOT IN (SELECT account FROM {{heartbeats}})"""
_RATES = """
SELECT account, ts, bytes_written, (bytes_written - lag(bytes_written) OVER w) / (epoch_us(ts) - epoch_us(lag(ts) OVER w)) * 1e6 AS rate_bps
FROM {heartbeats} WINDOW w AS (PARTITION BY account ORDER BY ts, bytes_written)"""
_RUNNING = f"""
SELECT account, max(ts) AS last_ts,
       CASE WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts)) < {LIVE_SECONDS * 1_000_000} THEN 'live' ELSE 'idle' END AS state
FROM {{heartbeats}} GROUP BY account"""
_RUNS = """
SELECT account, count(*) AS run_length, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal
FROM (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY ordinal) AS island
      FROM {attempts}) WHERE outcome = 'error' GROUP BY account, island HAVING count(*) >= %d""" % RUN_LIMIT
_THROUGHPUT = """
SELECT account, time_bucket(INTERVAL '10 minutes', ts) AS window_start, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files
FROM {attempts} GROUP BY ALL"""
_UPSERT = """
SELECT min(ordinal) AS ordinal, file_id, arg_max(status, ordinal) AS status, arg_max(size, ordinal) AS size
FROM {entry_log} GROUP BY file_id"""

_DIFF = """
SELECT l.ordinal, l.file_id, l.listed_path,
       CASE WHEN l.status = 'done' AND l.drive_id = 'src1' THEN 'done'
            WHEN p.status = 'done' AND p.modified_time = l.modified_time
                 AND (l.mime_type LIKE 'application/vnd.google-apps%' OR p.size = l.size) THEN 'import' ELSE 'fetch' END AS outcome,
       p.rel_path AS prev_path, p.size AS prev_size, p.sha256 AS prev_sha
FROM {catalog} l LEFT JOIN {previous} p ON l.file_id = p.file_id"""


def _contains_answer(name: str) -> str:
    return f"WHEN contains(lower(text), lower('{name}')) THEN '{name}'"


_SUMMARY = f"""
SELECT *, round_even((CASE WHEN total_bytes <> 0 THEN 100.0::DOUBLE * clean_bytes / total_bytes ELSE 0 END) * 1e4, 0) / 1e4 + 0.0 AS kept_pct,
       round_even((total_bytes::DOUBLE / 1073741824) * 1e2, 0) / 1e2 + 0.0 AS total_gb, round_even((clean_bytes::DOUBLE / 1073741824) * 1e2, 0) / 1e2 + 0.0 AS clean_gb,
       round_even((dupe_reclaim::DOUBLE / 1073741824) * 1e2, 0) / 1e2 + 0.0 AS dupe_reclaim_gb, round_even((junk_bytes::DOUBLE / 1048576) * 1e1, 0) / 1e1 + 0.0 AS junk_mb
FROM (SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes,
             count(*) FILTER (verdict = 'clean') AS clean_files, CAST(coalesce(sum(size) FILTER (verdict = 'clean'), 0) AS BIGINT) AS clean_bytes,
             count(*) FILTER (verdict = 'duplicate') AS dupe_files, CAST(coalesce(sum(size) FILTER (verdict = 'duplicate'), 0) AS BIGINT) AS dupe_reclaim,
             count(*) FILTER (verdict = 'junk') AS junk_files, CAST(coalesce(sum(size) FILTER (verdict = 'junk'), 0) AS BIGINT) AS junk_bytes
      FROM ({_classified()}))"""
_ROLLUP = f"""
WITH clean AS (SELECT *, {_category('rel_path')} AS category, CASE WHEN drive_name = '' THEN '?' ELSE drive_name END AS source,
                      {_year('????')} AS year FROM ({_classified()}) WHERE verdict = 'clean')
SELECT 'category' AS dimension, category AS key, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM clean GROUP BY category
UNION ALL SELECT 'source', source, count(*), CAST(sum(size) AS BIGINT) FROM clean GROUP BY source
UNION ALL SELECT 'year', year, count(*), CAST(sum(size) AS BIGINT) FROM clean GROUP BY year"""
_ROUTING_SUMMARY = f"""
SELECT *, round_even((bytes_copied::DOUBLE / 1073741824) * 1e3, 0) / 1e3 + 0.0 AS gb FROM (
SELECT count(*) FILTER (kind = 'copied') AS copied, count(*) FILTER (kind = 'duplicate') AS quarantined_dup,
       count(*) FILTER (kind = 'junk') AS quarantined_junk,
       CAST(coalesce(sum(size) FILTER (kind = 'copied'), 0) AS BIGINT) AS bytes_copied,
       CAST(coalesce(sum(size) FILTER (kind <> 'copied'), 0) AS BIGINT) AS bytes_quarantined FROM ({_routing()}))"""
_PURGE = f"SELECT dest_rel AS rel_path, size FROM ({_routing('settled')}) WHERE starts_with(dest_rel, '_quarantine/')"
_NATIVE = "WHEN 'application/vnd.google-apps.document' THEN '{0}' WHEN 'application/vnd.google-apps.spreadsheet' THEN '{1}'"
_EXPORT_MIME = "CASE mime_type " + _NATIVE.format(_OFFICE[0][0], _OFFICE[1][0]) + " ELSE '' END"
_EXPORT_EXT = "CASE mime_type " + _NATIVE.format(_OFFICE[0][1], _OFFICE[1][1]) + " ELSE '' END"

_TEXTS = {
    "status_counts": """
SELECT count(*) AS count, count(*) FILTER (status = 'done') AS done,
       CAST(sum(CASE WHEN status = 'done' THEN size ELSE 0 END) AS BIGINT) AS total_bytes,
       count(*) FILTER (status NOT IN ('done', 'restricted')) AS failed,
       count(*) FILTER (status = 'restricted') AS restricted FROM {catalog}""",
    "completeness": _COMPLETE,
    "latest_snapshot": """
SELECT account, max(snapshot) AS snapshot FROM {snapshots} WHERE NOT starts_with(snapshot, '_') GROUP BY account""",
    "resume_target": f"""
WITH s AS (SELECT account, snapshot, complete FROM {{snapshots}} JOIN ({_COMPLETE}) USING (o_orderkey)
           WHERE NOT starts_with(snapshot, '_')),
newest AS (SELECT account, snapshot, complete FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY snapshot DESC) AS rn
           FROM s) WHERE rn = 1)
SELECT n.account, CASE WHEN NOT n.complete THEN n.snapshot END AS target,
       (SELECT max(snapshot) FROM s WHERE s.account = n.account AND s.complete) AS previous_complete FROM newest n""",
    "upsert_entries": _UPSERT,
    "prune_stale": """
SELECT file_id, status FROM {previous} WHERE status = 'done' OR file_id IN (SELECT file_id FROM {catalog})""",
    "listed_missing": """
SELECT ordinal, file_id, rel_path FROM {catalog}
WHERE file_id NOT IN (SELECT file_id FROM {previous} WHERE status IN ('done', 'restricted'))""",
    "listing_totals": _LISTING_TOTALS,
    "by_category": f"""
SELECT {_category('rel_path')} AS category, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
FROM {{catalog}} WHERE status = 'done' GROUP BY 1""",
    "junk_files": f"""
SELECT rel_path, size, reason, {_label('reason')} AS label
FROM (SELECT *, {_junk('rel_path', 'size')} AS reason FROM {{catalog}} WHERE status = 'done') WHERE reason IS NOT NULL""",
    "text_candidates": f"""
SELECT ordinal, rel_path, size FROM {{catalog}} WHERE status = 'done' 
AND lower({_suffix(_name('rel_path'))}) IN ({_quoted(_TEXT_SUFFIXES)})""",
    "safe_names": rf"""
SELECT origin, id, CASE WHEN safe = '' THEN 'unnamed' ELSE safe END AS safe
FROM (SELECT origin, id, CASE WHEN length(clean) <= 180 THEN clean
             ELSE concat(regexp_replace(left(CASE WHEN stem <> '' THEN stem ELSE clean END, 180 - length(ext)), '[\s.]+$', ''), ext) END AS safe
      FROM (SELECT *, CASE WHEN contains(clean, '.') AND length(tail) <= 20 THEN concat('.', tail) ELSE '' END AS ext,
                   CASE WHEN contains(clean, '.') THEN left(clean, length(clean) - length(tail) - 1) ELSE '' END AS stem
            FROM (SELECT *, regexp_extract(clean, '[^.]*$') AS tail
                  FROM (SELECT origin, id, {_SAFE_CLEAN} AS clean
                        FROM (SELECT 'page' AS origin, page_id AS id, url AS name FROM {{pages}}
                              UNION ALL SELECT 'document', doc_id, text FROM {{documents}})))))""",
    "clean_accounts": """
SELECT page_id, CASE WHEN kept = '' THEN 'default' ELSE kept END AS account
FROM (SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), 64) AS kept FROM {pages})""",
    "answer_category": f"""
SELECT conv_id, turn, CASE {' '.join(_contains_answer(c) for c in ANSWER_CATEGORIES)} END AS category FROM {{conversations}}""",
    "native_exports": f"""
SELECT id, mime_type, {_EXPORT_MIME} AS export_mime, {_EXPORT_EXT} AS extension FROM {{items}}
WHERE mime_type IN ('application/vnd.google-apps.document', 'application/vnd.google-apps.spreadsheet')""",
    "build_paths": _TREE + " SELECT source_ordinal, id, rel_path FROM paths",
    "expand_folders": """
WITH RECURSIVE reached AS (
  SELECT id, mime_type, 0 AS depth, CAST(NULL AS STRING) AS folder_id FROM {items} WHERE parent IS NULL AND NOT shared_with_me
  UNION ALL
  SELECT i.id, i.mime_type, r.depth + 1, i.parent FROM {items} i JOIN reached r ON i.parent = r.id
  WHERE r.mime_type = 'application/vnd.google-apps.folder')
SELECT id, folder_id, depth FROM reached WHERE depth > 0""",
    "walk": _TREE + f""",
files AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_ordinal, position) AS rn FROM {{items}}
          WHERE mime_type NOT IN ('application/vnd.google-apps.folder', 'application/vnd.google-apps.form')
            AND shortcut_target IS NULL)
SELECT f.id AS file_id, concat(p.rel_path, {_EXPORT_EXT}) AS rel_path, drive_name, CAST(coalesce(f.size, '0') AS BIGINT) AS size,
       starts_with(mime_type, 'application/vnd.google-apps') AS is_native, {_EXPORT_MIME} AS exported_as
FROM files f JOIN paths p ON f.source_ordinal = p.source_ordinal AND f.id = p.id WHERE rn = 1""",
    "walk_shared": f"""
WITH RECURSIVE listing AS (SELECT * FROM {{shared_listing}}), kids AS (SELECT * FROM {{shared_children}}),
opened AS (
  SELECT id FROM listing WHERE shared_with_me AND mime_type = 'application/vnd.google-apps.folder'
  UNION SELECT k.id FROM opened o JOIN kids k ON k.folder_id = o.id WHERE k.mime_type = 'application/vnd.google-apps.folder'),
every AS (
  SELECT source_ordinal, drive_name, position, id, name, mime_type, parent, size, shortcut_target FROM listing
  UNION ALL
  SELECT 2, 'Shared with me', 1000000000 + k.position, k.id, k.name, k.mime_type, k.folder_id, k.size, k.shortcut_target
  FROM kids k JOIN opened o ON k.folder_id = o.id WHERE k.id NOT IN (SELECT id FROM listing WHERE shared_with_me)),
named AS (SELECT *, regexp_replace(name, '[<>:"/\\\\|?*]', '_', 'g') AS safe FROM every),
paths AS (
  SELECT source_ordinal, id, concat(replace(drive_name, ':', '_'), '/', safe) AS rel_path FROM named WHERE parent IS NULL
  UNION ALL
  SELECT n.source_ordinal, n.id, concat(p.rel_path, '/', n.safe)
  FROM named n JOIN paths p ON n.source_ordinal = p.source_ordinal AND n.parent = p.id),
files AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_ordinal, position) AS rn FROM every
          WHERE mime_type NOT IN ('application/vnd.google-apps.folder', 'application/vnd.google-apps.form')
            AND shortcut_target IS NULL)
SELECT f.id AS file_id, concat(p.rel_path, {_EXPORT_EXT}) AS rel_path, drive_name, CAST(coalesce(f.size, '0') AS BIGINT) AS size,
       starts_with(mime_type, 'application/vnd.google-apps') AS is_native, {_EXPORT_MIME} AS exported_as
FROM files f JOIN paths p ON f.source_ordinal = p.source_ordinal AND f.id = p.id WHERE rn = 1""",
    "tree_roundtrip": "SELECT rel_path, CAST({len}(text) AS BIGINT) AS size FROM {texts}",
    "hash_roundtrip": """
SELECT rel_path, CAST({len}(text) AS BIGINT) AS size, {sha}text{sha_end} AS sha256, TRUE AS readable FROM {texts}""",
    "copy_roundtrip": """
SELECT ordinal, concat('copy/', rel_path) AS dest_rel, {sha}text{sha_end} AS sha256, {sha}text{sha_end} AS on_disk, FALSE AS failed
FROM {texts} WHERE ordinal % 3 <> 0 UNION ALL
SELECT -1 - ordinal, concat('lost/', rel_path), NULL, NULL, TRUE FROM {texts} WHERE ordinal % 3 = 0""",
    "listing_roundtrip": """
SELECT source_ordinal, drive_id, drive_name, shared_with_me, id, name, mime_type, parent, size, modified_time, shortcut_target
FROM {items}""",
    "report_roundtrip": f"""
SELECT count(*) AS n_groups, CAST(sum(n_duplicates) AS BIGINT) AS duplicate_files, CAST(sum(reclaimable_bytes) AS BIGINT) AS reclaimable_bytes
FROM ({_groups()})""",
    "exact_duplicates": _groups(),
    "duplicate_members": f"""
SELECT 'exact' AS kind, sha256 AS key, "primary", ordinal, rel_path AS duplicate, size
FROM (SELECT *, first_value(rel_path) OVER (PARTITION BY sha256 ORDER BY place) AS "primary" FROM ({_classified()}) WHERE copies > 1)
WHERE place > 1""",
    "dedup_summary": f"""
SELECT count(*) AS n_groups, CAST(sum(n_duplicates) AS BIGINT) AS duplicate_files, CAST(sum(reclaimable_bytes) AS BIGINT) AS reclaimable_bytes
FROM ({_groups()})""",
    "orphaned_by_junk": f"""
SELECT sha256, max(CASE WHEN place = 1 THEN rel_path END) AS "primary", count(*) FILTER (junk IS NULL) AS n_clean
FROM ({_classified()}) WHERE copies > 1 GROUP BY sha256
HAVING count(*) FILTER (place = 1 AND junk IS NOT NULL) > 0 AND count(*) FILTER (junk IS NULL) > 0""",
    "near_members": _near("SELECT * FROM {vectors}") + """
SELECT ordinal, anchor, round(similarity, 6) AS similarity FROM members""",
    "near_duplicates": _near("SELECT * FROM {vectors}") + _NEAR_GROUPS,
    "near_similarity": _near("SELECT * FROM {vectors}") + """
SELECT ordinal, anchor, round(similarity, 6) AS similarity FROM members""",
    "near_texts": _near(_LETTER_ROWS, TEXT_THRESHOLD) + _NEAR_GROUPS,
    "all_duplicate_groups": _near(_TEXT_ROWS) + _NEAR_GROUPS + " UNION ALL " + _groups(),
    "proposal_summary": _SUMMARY,
    "proposal_rollup": _ROLLUP,
    "rollup_by_year": f"SELECT * FROM ({_ROLLUP}) WHERE dimension = 'year' ORDER BY key",
    "rollup_bars": f"""
SELECT *, greatest(1, CAST(floor(100 * bytes / CASE WHEN max(bytes) OVER (PARTITION BY dimension) = 0 THEN 1
       ELSE max(bytes) OVER (PARTITION BY dimension) END) AS BIGINT)) AS width FROM ({_ROLLUP})""",
    "default_plan": _default_plan(),
    "unique_paths": "SELECT ordinal, unique_path FROM (" + _unique(
        "SELECT ordinal, listed_path, left(file_id, 8) AS tag FROM {catalog}", "listed_path", "tag", "unique_path") + ")",
    "route_default": _routing(),
    "route_into_existing": _routing(
        taken=f"SELECT DISTINCT lower(dest_rel) AS path FROM ({_default_plan()}) WHERE dest_rel LIKE 'Documents/%'"),
    "route_with_plan": f"SELECT ordinal, src_rel, dest_rel, kind, size FROM ({_unique(_PLAN_ROWS, 'wanted', 'tag', 'dest_rel')})",
    "apply_plan": f"SELECT ordinal, src_rel, action, wanted FROM ({_APPLIED})",
    "plan_validation": f"""
WITH p AS ({_DRAFT}),
r AS (SELECT plan_ordinal, src_rel, dest_rel, {_ACTION} AS action, plan_ordinal = max(plan_ordinal) OVER (PARTITION BY src_rel) AS counts,
             src_rel IN (SELECT rel_path FROM {{catalog}} WHERE status = 'done') AS matched FROM p)
SELECT plan_ordinal, src_rel, action,
       CASE WHEN action NOT IN ('keep', 'quarantine', 'skip') THEN 'unknown_action'
            WHEN counts AND matched AND action <> 'skip' AND dest_rel <> ''
                 AND (starts_with(dest_rel, '/') OR list_contains(string_split(dest_rel, '/'), '..') OR trim(dest_rel) = '')
            THEN 'bad_destination' END AS problem,
       starts_with(lower(dest_rel), '_quarantine/') AND NOT starts_with(dest_rel, '_quarantine/') AND action = 'keep' AS warn_case,
       src_rel = '' AS empty_source, NOT counts AS superseded, NOT matched AS no_file
FROM r""",
    "unplanned_files": f"""
SELECT ordinal, rel_path, size FROM {{catalog}} WHERE status = 'done' AND rel_path NOT IN (SELECT src_rel FROM ({_EDITED}))""",
    "routing_summary": _ROUTING_SUMMARY,
    "mapping_sample": f"SELECT ordinal, src_rel, dest_rel FROM ({_routing()}) ORDER BY ordinal LIMIT 50",
    "incremental_diff": f"""
SELECT ordinal, file_id, outcome, CASE WHEN outcome = 'import' THEN prev_path END AS previous_path FROM ({_DIFF})""",
    "import_plan": f"""
SELECT ordinal, file_id, prev_path AS previous_path, CASE WHEN fallback IS NULL THEN 'import' ELSE 'fetch' END AS outcome, fallback
FROM (SELECT d.*, CASE WHEN t.rel_path IS NULL THEN 'missing' WHEN t.size <> prev_size THEN 'size_mismatch' WHEN NOT t.readable THEN 'unreadable'
                  WHEN prev_sha <> '' AND t.sha256 <> prev_sha THEN 'hash_mismatch' END AS fallback
      FROM ({_DIFF}) d LEFT JOIN {{previous_tree}} t ON t.rel_path = prev_path WHERE outcome = 'import')""",
    "assign_paths": "SELECT ordinal, outcome, local_path FROM (" + _unique(
        f"SELECT ordinal, outcome, listed_path, left(file_id, 8) AS tag FROM ({_DIFF}) WHERE outcome <> 'done'",
        "listed_path", "tag", "local_path",
        "SELECT listed_path AS path FROM {catalog} WHERE drive_id = 'src1' AND status = 'done'") + ")",
    "verify_detail": f"""
SELECT ordinal, rel_path, size, outcome, outcome = 'ok' AND sha256 = '' AS hash_unchecked
FROM ({_VERIFIED % ('catalog', 'mirror')}) WHERE status = 'done'""",
    "verify_summary": f"""
SELECT *, total > 0 AND complete AND ok = total AS clean
FROM (SELECT total, ok, missing, size_mismatch, hash_mismatch, hash_unchecked, restricted,
             failed = 0 AND total + restricted >= listed AS complete,
             CASE WHEN failed > 0 THEN 'failed' WHEN total + restricted < listed THEN 'missing'
                  WHEN restricted > 0 THEN 'restricted' ELSE 'complete' END AS complete_reason
      FROM (SELECT count(*) AS listed, count(*) FILTER (status = 'done') AS total,
                   {', '.join(f"count(*) FILTER (status = 'done' AND outcome = '{o}') AS {o}" for o in ('ok', 'missing', 'size_mismatch', 'hash_mismatch'))},
                   count(*) FILTER (status = 'done' AND outcome = 'ok' AND sha256 = '') AS hash_unchecked,
                   count(*) FILTER (status = 'restricted') AS restricted,
                   count(*) FILTER (status NOT IN ('done', 'restricted')) AS failed
            FROM ({_VERIFIED % ('catalog', 'mirror')})))""",
    "safety_gate": f"""
SELECT p AND e AS safe, CASE WHEN NOT p THEN 'primary_not_verified' WHEN NOT e THEN 'external_not_verified' ELSE 'verified' END AS reason
FROM (SELECT (SELECT bool_and(outcome = 'ok') FROM ({_VERIFIED % ('settled', 'primary_tree')}) WHERE status = 'done') AS p,
             (SELECT bool_and(outcome = 'ok') FROM ({_VERIFIED % ('settled', 'mirror')}) WHERE status = 'done') AS e)""",
    "mirror_repair_plan": f"""
WITH pairs AS (SELECT ordinal, rel_path, size, dest, place FROM {{catalog}}
               CROSS JOIN (SELECT unnest([{_quoted(MIRRORS)}]) AS dest, unnest(range({len(MIRRORS)})) AS place) WHERE status = 'done'),
health AS (SELECT p.*, t.rel_path IS NOT NULL AS healthy FROM pairs p LEFT JOIN {{mirror_trees}} t
           ON t.dest = p.dest AND t.rel_path = p.rel_path AND t.size = p.size)
SELECT ordinal, rel_path, size, donor, dest FROM (
  SELECT *, min(CASE WHEN healthy THEN [place::VARCHAR, dest] END) OVER (PARTITION BY ordinal)[2] AS donor FROM health) WHERE NOT healthy""",
    "capacity_check": f"""
SELECT destination, free_bytes, required_bytes, margin_bytes, free_bytes >= required_bytes + margin_bytes AS ok,
       greatest(0, required_bytes + margin_bytes - free_bytes) AS shortfall_bytes
FROM (SELECT required_bytes, CAST({int(MARGIN_GB * 1024 ** 3)} AS BIGINT) AS margin_bytes, d.*
      FROM ({_LISTING_TOTALS}) CROSS JOIN (VALUES {', '.join(f"('{d}', CAST({f} AS BIGINT))" for d, f in DESTINATIONS)}) d(destination, free_bytes))""",
    "purge_plan": _PURGE,
    "purge_summary": f"SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed_bytes FROM ({_PURGE})",
    "snapshot_roundtrip": "SELECT ordinal, file_id, name, rel_path, mime_type, size, drive_id, drive_name, owner, modified_time, sha256, exported_as, status, error FROM {catalog}",
    "header_roundtrip": """
SELECT 'main' AS account, '20240101' AS snapshot, CAST(5 AS BIGINT) AS expected_total, CAST(7 AS BIGINT) AS expected_bytes,
       count(*) AS count, count(*) FILTER (status = 'done') AS done,
       CAST(coalesce(sum(size) FILTER (status = 'done'), 0) AS BIGINT) AS total_bytes FROM {catalog}""",
    "document_roundtrip": "SELECT 'main' AS account, '20240101' AS snapshot, file_id, name, rel_path, mime_type, size, drive_id, drive_name, owner, modified_time, sha256, exported_as, status, error FROM {catalog}",
    "plan_roundtrip": f"""
SELECT action, src_rel, dest_rel, reason, row_number() OVER (ORDER BY ordinal) - 1 AS plan_ordinal
FROM ({_default_plan()})""",
    "heartbeat_roundtrip": """
SELECT account, ts, done, expected, errors, bytes_written, expected_bytes, bytes_inflight, elapsed_s, rate_bps
FROM {heartbeats}""",
    "failure_classes": f"""
SELECT ordinal, file_id,
       CASE WHEN exc_type IN ('ConnectionResetError', 'ResponseNotReady', 'SSLEOFError') THEN 'transient'
            WHEN exc_type = 'gaierror' AND errno IS NULL THEN 'transient'
            WHEN errno IS NOT NULL THEN CASE WHEN errno IN (2, 13, 28, 30, 122) THEN 'permanent' ELSE 'transient' END
            WHEN http_status = 403 THEN CASE WHEN lower(reason) LIKE '%ratelimitexceeded%' THEN 'transient' ELSE 'restricted' END
            WHEN http_status IN (429, 500, 502, 503, 504) THEN 'transient' ELSE 'permanent' END AS failure_class
FROM {{attempts}}""",
    "run_summary": """
SELECT account, count(*) FILTER (outcome = 'success') AS downloaded, count(*) FILTER (outcome = 'import') AS imported,
       count(*) FILTER (outcome = 'skip') AS skipped, count(*) FILTER (outcome = 'error') AS errors,
       count(*) FILTER (outcome = 'restricted') AS restricted, count(*) FILTER (outcome = 'repair') AS repaired,
       CAST(coalesce(sum(size) FILTER (outcome IN ('success', 'import')), 0) AS BIGINT) AS bytes_written
FROM {attempts} GROUP BY account""",
    "error_samples": "SELECT ordinal, file_id, error FROM {attempts} WHERE outcome = 'error' ORDER BY ordinal LIMIT 10",
    "failure_runs": _RUNS,
    "progress_snapshot": _described(_SNAPSHOT),
    "progress_rate": f"SELECT account, ts, round_even((rate_bps) * 1e3, 0) / 1e3 + 0.0 AS rate_bps FROM ({_RATES})",
    "rate_history": f"""
SELECT account, ts, round_even((mb) * 1e6, 0) / 1e6 + 0.0 AS mb_s, round_even((greatest(max(mb) OVER (PARTITION BY account ORDER BY ts, bytes_written
       ROWS BETWEEN 79 PRECEDING AND CURRENT ROW), 0.1)) * 1e6, 0) / 1e6 + 0.0 AS scale
FROM (SELECT account, ts, bytes_written, coalesce(rate_bps, 0) / 1e6 AS mb FROM ({_RATES}))""",
    "running_state": _RUNNING,
    "throughput_windows": _THROUGHPUT,
    "funnel_status": f"""
WITH facts AS (
  SELECT s.account, done, expected, errors, coalesce(r.state = 'live', FALSE) AS running, c_custkey IS NOT NULL AS has_manifest,
         coalesce(c_acctbal > 0, FALSE) AS verified, coalesce(c_acctbal > 2000, FALSE) AS proposed,
         coalesce(c_acctbal > 6000, FALSE) AS reorganized
  FROM ({_SNAPSHOT}) s LEFT JOIN ({_RUNNING}) r ON s.account = r.account
       LEFT JOIN {{customer}} c ON s.account = CAST(c.c_custkey AS STRING))
SELECT account, 'backup' AS stage, CASE WHEN expected > 0 AND done >= expected AND errors = 0 THEN 'done' WHEN running THEN 'active'
       WHEN has_manifest THEN 'partial' ELSE 'todo' END AS status FROM facts
UNION ALL SELECT account, 'verify', CASE WHEN verified THEN 'done' WHEN has_manifest THEN 'todo' ELSE 'blocked' END FROM facts
UNION ALL SELECT account, 'propose', CASE WHEN proposed THEN 'done' WHEN has_manifest THEN 'todo' ELSE 'blocked' END FROM facts
UNION ALL SELECT account, 'reorganize', CASE WHEN reorganized THEN 'done' WHEN verified THEN 'todo' ELSE 'blocked' END FROM facts""",
    "live_status": _described(_LATEST),
    "live_throughput": _THROUGHPUT,
    "breaker_alerts": f"SELECT account, first_ordinal FROM ({_RUNS})",
    "live_catalog": _UPSERT,
    "live_activity": """
WITH beats AS (
  SELECT account, ts FROM {heartbeats} UNION ALL
  SELECT CAST(user_id AS VARCHAR), ts + INTERVAL 30 DAY FROM (SELECT * FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 1)),
spells AS (SELECT account, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS behind FROM beats
           WINDOW w AS (PARTITION BY account ORDER BY ts))
SELECT account, 'live' AS state, ts FROM spells WHERE before IS NULL OR ts - before > INTERVAL 60 SECOND
UNION ALL
SELECT account, 'idle', ts FROM spells
WHERE behind - ts > INTERVAL 60 SECOND OR (behind IS NULL AND ts < (SELECT max(ts) FROM beats))""",
}

ORACLES = {name: duckdb_sql(text) for name, text in _TEXTS.items()}

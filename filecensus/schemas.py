"""Schemas of the tables the operators read."""

from __future__ import annotations

# One row per file of a snapshot. `ordinal` is the row's place in listing order: it decides who
# keeps a contested name and who anchors a near-duplicate group.
ENTRY_FIELDS = (
    "file_id string, name string, rel_path string, mime_type string, size {size}, drive_id string, "
    "drive_name string, owner string, modified_time string, sha256 string, exported_as string, "
    "status string, error string"
)
ENTRY = "ordinal bigint, " + ENTRY_FIELDS.format(size="bigint")
ENTRY_COLUMNS = [field.split()[0] for field in ENTRY.split(", ")]

# A snapshot's interchange document. Sizes are read as text: edited documents hold strings.
SNAPSHOT_DOCUMENT = (
    "account string, expected_total string, expected_bytes string, count string, done string, "
    "total_bytes string, part string, first_ordinal string, entries array<struct<" + ENTRY_FIELDS.format(size="string").replace(" string", ": string")
    + ">>"
)

LISTING_ITEM = (
    "struct<id: string, name: string, mimeType: string, parents: array<string>, size: string, "
    "modifiedTime: string, owners: array<struct<emailAddress: string>>, driveId: string, "
    "trashed: boolean, shortcutDetails: struct<targetId: string>>"
)
LISTING_PAGE = f"nextPageToken string, files array<{LISTING_ITEM}>"
DRIVES_PAGE = "nextPageToken string, drives array<struct<id: string, name: string>>"

PLAN_COLUMNS = ["action", "src_rel", "dest_rel", "reason"]

HEARTBEAT = (
    "account string, ts timestamp, done bigint, expected bigint, errors bigint, bytes_written bigint, "
    "expected_bytes bigint, bytes_inflight bigint, elapsed_s double, rate_bps double"
)

"""Classification rules over catalog columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from filecensus.functions import text

# File categories and their extensions.
CATEGORIES = {
    "Images": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic", ".svg"],
    "Videos": [".mp4", ".mov", ".avi", ".mkv", ".webm", ".flv", ".wmv", ".m4v"],
    "Audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a"],
    "Documents": [".pdf", ".doc", ".docx", ".odt", ".rtf", ".txt", ".md", ".pages"],
    "Spreadsheets": [".xls", ".xlsx", ".ods", ".csv", ".numbers"],
    "Presentations": [".ppt", ".pptx", ".odp", ".key"],
    "Archives": [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"],
    "Code": [".py", ".js", ".ts", ".java", ".c", ".cpp", ".go", ".rs", ".sh", ".html", ".css",
             ".json", ".yaml", ".yml"],
    "Data": [".db", ".sqlite", ".parquet", ".xml"],
}
# Clutter names, prefixes and extensions.
JUNK_NAMES = [".ds_store", "thumbs.db", "desktop.ini", ".localized", "icon\r"]
JUNK_PREFIXES = ["~$", ".~"]
JUNK_SUFFIXES = [".tmp", ".temp", ".crdownload", ".part", ".partial", ".~lock"]
# Texts a plan shows for each reason code.
REASON_LABELS = {
    "system": "fichier système",
    "temporary": "fichier temporaire",
    "empty": "fichier vide (0 octet)",
    "duplicate": "doublon exact",
}
# What counts as text for near-duplicate search.
TEXT_SUFFIXES = [".txt", ".md", ".csv", ".json", ".html", ".xml", ".log", ".rtf"]
# Native document types and what they are exported as.
NATIVE_PREFIX = "application/vnd.google-apps"
FOLDER_TYPE = "application/vnd.google-apps.folder"
NATIVE_EXPORTS = {
    "office": {
        "application/vnd.google-apps.document":
            ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
        "application/vnd.google-apps.spreadsheet":
            ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"),
        "application/vnd.google-apps.presentation":
            ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptx"),
        "application/vnd.google-apps.drawing": ("image/png", ".png"),
    },
    "pdf": {
        "application/vnd.google-apps.document": ("application/pdf", ".pdf"),
        "application/vnd.google-apps.spreadsheet": ("application/pdf", ".pdf"),
        "application/vnd.google-apps.presentation": ("application/pdf", ".pdf"),
        "application/vnd.google-apps.drawing": ("image/png", ".png"),
    },
}
# Quota words that make a 403 retryable, statuses always retried, OS errors that
# retrying cannot mend, exception types of a lost connection.
QUOTA_WORDS = ["ratelimitexceeded", "userratelimitexceeded", "quotaexceeded", "dailylimitexceeded",
               "sharinglimitexceeded"]
RETRIED_STATUSES = [429, 500, 502, 503, 504]
FATAL_ERRNOS = {"ENOENT": 2, "EACCES": 13, "ENOSPC": 28, "EROFS": 30, "EDQUOT": 122}
CONNECTION_ERRORS = [
    "ConnectionError", "BrokenPipeError", "ConnectionAbortedError", "ConnectionRefusedError",
    "ConnectionResetError", "TimeoutError", "SSLError", "SSLCertVerificationError", "SSLEOFError",
    "SSLSyscallError", "SSLWantReadError", "SSLWantWriteError", "SSLZeroReturnError", "CertificateError",
    "HTTPException", "BadStatusLine", "CannotSendHeader", "CannotSendRequest", "ImproperConnectionState",
    "IncompleteRead", "InvalidURL", "LineTooLong", "NotConnected", "RemoteDisconnected", "ResponseNotReady",
    "UnimplementedFileMode", "UnknownProtocol", "UnknownTransferEncoding",
]
# Every class below OSError of the standard library that is not listed above.
OS_ERRORS = [
    "OSError", "IOError", "EnvironmentError", "BlockingIOError", "ChildProcessError", "FileExistsError",
    "FileNotFoundError", "InterruptedError", "IsADirectoryError", "NotADirectoryError", "PermissionError",
    "ProcessLookupError", "UnsupportedOperation", "gaierror", "herror", "HTTPError", "URLError", "ContentTooShortError",
    "Error", "SameFileError", "SpecialFileError", "ExecError", "ReadError",
]

DONE = "done"
RESTRICTED = "restricted"


def is_done(status: Column) -> Column:
    return status == DONE


def is_restricted(status: Column) -> Column:
    return status == RESTRICTED


def is_failed(status: Column) -> Column:
    """Any status that is neither done nor restricted, known or not."""
    return ~status.isin(DONE, RESTRICTED)


def category(rel_path: Column) -> Column:
    extension = F.lower(text.suffix(text.base_name(rel_path)))
    pairs = [F.lit(v) for name, extensions in CATEGORIES.items() for e in extensions for v in (e, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit("Other"))


def junk_reason(rel_path: Column, size: Column) -> Column:
    """Reason code of clutter, null for a file worth keeping; the first rule that holds wins."""
    name = text.base_name(rel_path)
    prefixed = reduce(lambda a, b: a | b, [F.startswith(name, F.lit(p)) for p in JUNK_PREFIXES])
    return (
        F.when(F.lower(name).isin(JUNK_NAMES), "system")
        .when(prefixed, "temporary")
        .when(F.lower(text.suffix(name)).isin(JUNK_SUFFIXES), "temporary")
        .when(size == 0, "empty")
    )


def reason_label(code: Column) -> Column:
    cases = F.when(F.lit(False), "")
    for key, label in REASON_LABELS.items():
        cases = cases.when(code == key, label)
    return cases.otherwise("")


def year(modified_time: Column, missing: str) -> Column:
    """First four characters of the timestamp text; paths and roll-ups use different defaults."""
    return F.left(text.or_default(modified_time, missing), F.lit(4))


def tidy_path(rel_path: Column, modified_time: Column, by_year: bool = True) -> Column:
    """Where a kept file goes: Category/Year/name or Category/name."""
    name = text.base_name(rel_path)
    if by_year:
        return F.concat_ws("/", category(rel_path), year(modified_time, "0000"), name)
    return F.concat_ws("/", category(rel_path), name)


def is_text_candidate(rel_path: Column, size: Column, max_bytes: int | None = None) -> Column:
    """Textual by its name; with `max_bytes`, larger files are left out."""
    textual = F.lower(text.suffix(text.base_name(rel_path))).isin(TEXT_SUFFIXES)
    return textual if max_bytes is None else textual & (size <= max_bytes)


def is_native(mime_type: Column) -> Column:
    return F.startswith(mime_type, F.lit(NATIVE_PREFIX))


def native_export(mime_type: Column, export_format: str = "office") -> Column:
    """struct(mime, extension) a native document is exported as; null when it has no export."""
    mapping = NATIVE_EXPORTS.get(export_format, NATIVE_EXPORTS["office"])
    cases = None
    for native, (mime, extension) in mapping.items():
        value = F.struct(F.lit(mime).alias("mime"), F.lit(extension).alias("extension"))
        cases = F.when(mime_type == native, value) if cases is None else cases.when(mime_type == native, value)
    return cases


def failure_class(http_status: Column, reason: Column, errno: Column, exc_type: Column) -> Column:
    """transient (retry), restricted (never served) or permanent (retrying cannot help)."""
    words = F.lower(F.coalesce(reason, F.lit("")))
    quota = reduce(lambda a, b: a | b, [F.contains(words, F.lit(w)) for w in QUOTA_WORDS])
    return (
        F.when(exc_type.isin(CONNECTION_ERRORS), "transient")
        .when(exc_type.isin(OS_ERRORS) & errno.isNull(), "transient")
        .when(errno.isNotNull(), F.when(errno.isin(list(FATAL_ERRNOS.values())), "permanent").otherwise("transient"))
        .when((http_status == 403) & ~quota, "restricted")
        .when((http_status == 403) | http_status.isin(RETRIED_STATUSES), "transient")
        .otherwise("permanent")
    )

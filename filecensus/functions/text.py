"""String expressions with Python string semantics, built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points Python's str.isspace() accepts, as a regex class body.
WHITESPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Characters no portable file system accepts, and the longest component kept.
UNSAFE = r'[<>:"/\\|?*\x00-\x1F]'
MAX_COMPONENT = 180
MAX_EXTENSION = 20
MAX_ACCOUNT = 64


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides (SQL trim only knows the plain space)."""
    return F.regexp_replace(text, rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def _trim_tail(text: Column) -> Column:
    return F.regexp_replace(text, r"[ .]+\z", "")


def _shorten(name: Column) -> Column:
    """At most MAX_COMPONENT characters, keeping a short extension."""
    tail = F.substring_index(name, ".", -1)
    has_dot = F.contains(name, F.lit("."))
    extension = F.when(has_dot & (F.length(tail) <= MAX_EXTENSION), F.concat(F.lit("."), tail)).otherwise("")
    before = F.left(name, F.length(name) - F.length(tail) - F.lit(1))
    body = F.when(has_dot & (F.length(before) > 0), before).otherwise(name)
    cut = _trim_tail(strip(F.left(body, F.lit(MAX_COMPONENT) - F.length(extension))))
    return F.when(F.length(name) > MAX_COMPONENT, F.concat(cut, extension)).otherwise(name)


def safe_component(name: Column) -> Column:
    """One path component every target file system accepts."""
    # Most names need no more than other characters; only those that are too long or whose ends are cut are
    # rewritten. The one-element arrays give a rewritten name a variable, so that each step is computed once.
    ends = F.rlike(F.concat(F.left(name, F.lit(1)), F.right(name, F.lit(1))),
                   F.lit(rf"\A[{WHITESPACE}]|[{WHITESPACE}.]\z|\A\z"))
    replaced = F.regexp_replace(name, UNSAFE, "_")
    cleaned = F.array(_trim_tail(strip(replaced)))
    rewritten = F.get(F.transform(F.transform(cleaned, _shorten), lambda n: _or(n, "unnamed")), F.lit(0))
    return F.when(ends | (F.length(name) > MAX_COMPONENT), rewritten).otherwise(replaced)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Extension with its dot; a leading or trailing dot starts none."""
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def parent(path: Column) -> Column:
    """Everything before the last component, with its closing slash, or the empty string."""
    return F.regexp_replace(path, r"[^/]*\z", "")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def fold_case(text: Column) -> Column:
    """Key under which two names are equal on a case-insensitive file system (full case folding).

    Upper-casing first expands letters such as the sharp s; the replacements in between cover the
    letters on which upper/lower and folding differ, and keep Catalyst from reducing
    lower(upper(x)) to lower(x).
    """
    dotless = F.replace(text, F.lit("\u0131"), F.lit("\ue000"))
    expanded = F.replace(F.upper(dotless), F.lit("\u1e9e"), F.lit("SS"))
    return F.replace(F.lower(expanded), F.lit("\u03c2"), F.lit("\u03c3"))


def candidate_path(path: Column, tag: Column, index: Column) -> Column:
    """The index-th name to try: the path itself, then `stem__tag.ext`, then `stem__tag_n.ext`."""
    name = base_name(path)
    counter = F.when(index > 1, F.concat(F.lit("_"), (index - 1).cast("string"))).otherwise("")
    tagged = F.concat(parent(path), stem(name), F.lit("__"), tag, counter, suffix(name))
    return F.when(index == 0, path).otherwise(tagged)


def id_tag(file_id: Column) -> Column:
    return F.left(F.replace(_or(file_id, "dup"), F.lit("/"), F.lit("_")), F.lit(8))


def hash_tag(sha256: Column) -> Column:
    return F.left(_or(sha256, "dup"), F.lit(8))


def _or(text: Column, default: str) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(default)


or_default = _or


def clean_account(label: Column) -> Column:
    kept = F.left(F.regexp_replace(F.coalesce(label, F.lit("")), "[^A-Za-z0-9_-]", ""), F.lit(MAX_ACCOUNT))
    return _or(kept, "default")


def normal_path(path: Column) -> Column:
    """Collapse `//`, `./` and a closing slash; a path of nothing else becomes `.`."""
    parts = F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(".")


def answer_category(answer: Column, categories: list[str]) -> Column:
    """First category, in list order, that the answer mentions in any case; null when none is."""
    text = F.lower(answer)
    hits = [F.when(F.contains(text, F.lit(name.lower())), F.lit(name)) for name in categories]
    return F.coalesce(*hits, F.lit(None).cast("string"))

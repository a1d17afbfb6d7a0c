"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item, or all words of a shorter item. Of the k-grams inside
a window the smallest hash is its fingerprint. Equal windows have equal fingerprints, so a document that holds a
window anywhere has its fingerprint: the join of the fingerprints of documents and items misses nothing. Hits are
extended to the whole window by comparing its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filecensus.llm.joins import fresh, row_key, small_side
from filecensus.operators.scale import cut_lineage

WINDOW = 13
GRAM = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case A-Z, then runs of letters, digits and characters beyond ASCII; null has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lower, _BETWEEN_WORDS), "")


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body looks at it."""
    return F.transform(F.array(value), body)[0]


def fingerprints(word_list: Column, length: int, gram: int = GRAM) -> Column:
    """The fingerprint of each run of `length` words, in order: least hash of its grams, mixed with the length."""
    size = min(gram, length)
    places = length - size + 1

    def grams(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - size)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))

    def least(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (places - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.array_min(F.slice(found, i, places)), F.lit(length)))

    hashed = F.transform(word_list, lambda word: F.xxhash64(word))
    return F.when(F.size(word_list) >= length, _let(hashed, lambda x: _let(grams(x), least))).otherwise(
        F.array().cast("array<bigint>"))


def _runs(word_list: Column, lengths: list[int], wanted: Column | None = None, gram: int = GRAM) -> Column:
    """(print, length, start, words) of the runs of these lengths, of all or of those with a wanted fingerprint."""
    def of(length: int) -> Column:
        def run(print_: Column, start: Column) -> Column:
            return F.struct(print_.alias("print"), F.lit(length).alias("length"), start.alias("start"))

        found = F.transform(fingerprints(word_list, length, gram), run)
        return found if wanted is None else F.filter(found, lambda x: F.array_contains(wanted, x["print"]))

    placed = F.concat(*[of(length) for length in lengths])
    return F.transform(placed, lambda x: F.struct(
        x["print"].alias("print"), x["length"].alias("length"), x["start"].alias("start"),
        F.array_join(F.slice(word_list, x["start"] + 1, x["length"]), " ").alias("words")))


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """print, length, words of each different window, with the sorted ids of its items and a hash of these."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("list"))
    items = items.select("item", "list", F.least(F.size("list"), F.lit(window)).alias("n")).filter("n > 0")
    # An item has one length, so only one of the arrays of runs is worked out.
    runs = F.coalesce(*[F.when(F.col("n") == n, _runs(F.col("list"), [n], gram=gram)) for n in range(1, window + 1)])
    exploded = items.select("item", F.inline(runs))
    found = exploded.groupBy("print", "length", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.withColumn("set", F.md5(F.array_join("items", ",").cast("binary")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  share: int = 20) -> DataFrame:
    """What each document shares with the benchmark.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), n_items and items_sha256 (the items
    with occurring windows), contaminated (n_hit > 0 and share * n_hit >= n_words) and row_key, which stands for
    the row's doc_id and text. Null texts, and texts and items without words, have no windows and are clean; a
    null item_id reads "null", items of equal id are one item; rows alike get the same result each; other columns
    are not looked at; empty tables give no hits.

    Documents are read twice: once for their fingerprints, and again, joined to the matched fingerprints, for the
    windows themselves. Items' windows are unique in every join, so a passage that all documents share gives one
    row for each document and place, however many items have it.
    """
    windows = cut_lineage(item_windows(benchmark, window, gram))
    lengths = sorted(row[0] for row in windows.select("length").distinct().collect())  # at most `window` numbers
    source = docs.select("doc_id", F.col("text").cast("string"))
    listed = source.select("doc_id", row_key().alias("row_key"), words(F.col("text")).alias("list"))
    prints = F.array_distinct(F.concat(
        F.array().cast("array<bigint>"), *[fingerprints(F.col("list"), n, gram) for n in lengths]))
    table = cut_lineage(listed.select(
        "doc_id", "row_key", F.size("list").cast("bigint").alias("n_words"), prints.alias("prints")))

    known = cut_lineage(windows.select("print").distinct())
    matched = cut_lineage(
        table.select("row_key", F.explode("prints").alias("print")).join(known, "print", "left_semi")
        .groupBy("row_key").agg(F.collect_set("print").alias("matched")))
    # Texts are cut into words after the join: words would be twice as much to move.
    again = source.select(row_key().alias("row_key"), "text").join(
        small_side(matched, 64, "matched", 8), "row_key").select(
        "row_key", words(F.col("text")).alias("list"), "matched")
    runs = again.select("row_key", F.inline(_runs(F.col("list"), lengths or [window], F.col("matched"), gram)))
    hits = cut_lineage(runs.join(windows, ["print", "length", "words"]).select("row_key", "start", "length", "set"))

    before = Window.partitionBy("row_key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    covered = hits.distinct().select("row_key", F.greatest(end - F.greatest(seen, "start"), F.lit(0)).alias("n")).groupBy(
        "row_key").agg(F.sum("n").alias("n_hit"))
    sets = windows.select("set", "items").dropDuplicates(["set"])
    named = hits.select("row_key", "set").distinct().join(sets, "set").select(
        "row_key", F.explode("items").alias("item")).groupBy("row_key").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    joined = table.select("doc_id", "row_key", "n_words").join(covered.join(named, "row_key"), "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "row_key")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not contaminated."""
    name = fresh(docs, "_row_key")
    bad = contamination(docs, benchmark, **settings).filter("contaminated").select(
        F.col("row_key").alias(name)).distinct()
    return docs.withColumn(name, row_key()).join(
        small_side(cut_lineage(bad), 64), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

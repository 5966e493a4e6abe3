"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters and digits; a benchmark item's windows are its runs of ``WINDOW`` = 10
words (an item of fewer words is one window). Of each 10 words the smallest of the six hashes of 5
consecutive words is kept as fingerprint, so a shared run of 10 words always shares its fingerprint, in
documents and benchmark alike. Each document keeps one row per stretch of windows with the same fingerprint,
which is joined with the benchmark's fingerprints; a hit is extended to the complete windows of its stretch,
and those are compared word by word (by their 64-bit word hashes) with the benchmark's windows. Only
DataFrame functions are used, each text is split once, and documents are never joined with each other.
Windows of items of fewer than 10 words cannot be winnowed at that length: for each of their lengths that
occurs, all runs of so many words are looked up instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import ascii_lower, row_key, small, stored

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
# windows after which a stretch is cut, so that the words carried with it are few in any text
STRETCH = 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# explode_outer throughout: for a plain explode the optimizer adds a test for empty arrays before it, and copies
# the array's whole computation into that test
def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(ascii_lower(text), NOT_WORD), ""), lambda word: F.xxhash64(word))


def _starts(first: int, count: Column) -> Column:
    """first .. first + count - 1, empty where there is nothing to count."""
    return F.when(count > 0, F.sequence(F.lit(first), count + F.lit(first - 1))).otherwise(F.array().cast("array<int>"))


def with_fingerprints(rows: DataFrame, words: str = "words") -> DataFrame:
    """Add ``smallest``: for each run of ten words the fingerprint, in order."""
    n = F.size(words)
    grams = rows.withColumn("grams", F.transform(
        _starts(1, n - (GRAM - 1)),
        lambda i: F.xxhash64(*[F.element_at(F.col(words), i + F.lit(j)) for j in range(GRAM)])))
    return grams.withColumn("smallest", F.transform(
        _starts(1, n - (WINDOW - 1)),
        lambda i: F.least(*[F.element_at(F.col("grams"), i + F.lit(j)) for j in range(SPAN)]))).drop("grams")


def _begins() -> Column:
    """First windows of the stretches: runs of windows with one fingerprint, cut after STRETCH windows."""
    return F.filter(_starts(1, F.size("smallest")), lambda i: (i % STRETCH == 1) | (
        F.element_at(F.col("smallest"), i) != F.element_at(F.col("smallest"), F.greatest(i - 1, F.lit(1)))))


def benchmark_windows(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``item``, ``window`` (hashes of its words), ``fingerprint`` (null for items of fewer than ten words)."""
    items = benchmark.select(F.col(id_column).alias("item"), word_hashes(F.col(text_column)).alias("words"))
    items = with_fingerprints(items.filter(F.size("words") > 0))
    long = items.select("item", "words", F.posexplode_outer("smallest").alias("at", "fingerprint")).filter(F.col("at").isNotNull())
    return (long.select("item", F.slice("words", F.col("at") + 1, WINDOW).alias("window"), "fingerprint")
            .union(items.filter(F.size("words") < WINDOW)
                   .select("item", F.col("words").alias("window"), F.lit(None).cast("long"))).distinct())


def find_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of words, occurrences of benchmark windows, and the windows themselves.

    The first table has ``id``, ``key_id``, ``key_text`` and ``n_words``, a row per input row; the second ``key_id``,
    ``key_text``, ``start`` (word, from 1), ``length`` and ``window``, a row per occurrence; the third ``item`` and
    ``window``.
    """
    windows = stored(benchmark_windows(benchmark, item_id, item_text))
    prints = small(stored(windows.filter(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()))
    targets = small(stored(windows.select("window").distinct()))
    short = sorted(row[0] for row in windows.filter(F.size("window") < WINDOW).select(F.size("window")).distinct().collect())

    rows = docs.select(F.col(doc_id).alias("id"), *row_key(doc_id, doc_text), word_hashes(F.col(doc_text)).alias("words"))
    rows = with_fingerprints(rows).withColumn("begins", _begins())
    none = F.array().cast("array<bigint>")
    stretch = F.transform("begins", lambda i, j: F.struct(
        F.element_at(F.col("smallest"), i).alias("fingerprint"), i.alias("start"), F.size("words").alias("n_words"),
        F.slice("words", i, F.when(j + 1 < F.size("begins"), F.get(F.col("begins"), j + 1))
                .otherwise(F.size("smallest") + 1) - i + (WINDOW - 1)).alias("below")))
    whole = F.array(F.struct(F.col("key_text").alias("fingerprint"), F.lit(0).alias("start"),
                             F.size("words").alias("n_words"), none.alias("below")))
    seeds = (rows.select("id", "key_id", "key_text", F.explode_outer(F.concat(whole, stretch)).alias("s"))
             .select("id", "key_id", "key_text", "s.*")
             .join(prints.withColumn("known", F.lit(True)), "fingerprint", "left")
             .filter(F.col("known") | (F.col("start") == 0)))
    seeds = stored(seeds.select("id", "key_id", "key_text", "start", "n_words", "below"))
    counts = seeds.filter(F.col("start") == 0).select("id", "key_id", "key_text", F.col("n_words").cast("long"))
    candidates = (seeds.filter(F.col("start") > 0)
                  .select("key_id", "key_text", "start", "below",
                          F.explode(F.sequence(F.lit(0), F.size("below") - WINDOW)).alias("shift"))
                  .select("key_id", "key_text", (F.col("start") + F.col("shift")).alias("start"),
                          F.slice("below", F.col("shift") + 1, WINDOW).alias("window")))
    for length in short:
        runs = docs.select(*row_key(doc_id, doc_text), word_hashes(F.col(doc_text)).alias("words"))
        candidates = candidates.union(
            runs.select("key_id", "key_text", F.explode_outer(F.transform(
                _starts(1, F.size("words") - (length - 1)),
                lambda i: F.struct(i.alias("start"), F.slice("words", i, length).alias("window")))).alias("s"))
            .filter(F.col("s").isNotNull()).select("key_id", "key_text", "s.*"))
    hits = candidates.join(targets, "window").select(
        "key_id", "key_text", "start", F.size("window").alias("length"), "window").distinct()
    return counts, stored(hits), windows.select("item", "window")


def _covered(spans: Column) -> Column:
    """Words below the sorted (start, length) spans, each counted once."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda total, span: F.struct(
            F.greatest(total["end"], span["start"] + span["length"]).alias("end"),
            (total["n"] + F.greatest(F.lit(0), span["start"] + span["length"] - F.greatest(total["end"], span["start"]))).alias("n")))
    return step["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: its id, ``n_words``, ``n_hit``, ``n_items`` (longs), ``items`` (ids as sorted strings)
    and ``contaminated``.

    A word inside any occurrence of a window is hit; ``items`` are the items with occurring windows. Null and
    empty texts have no words and no hits, null items no windows; an item id that is null counts under the
    empty string. Equal rows give equal rows, other columns are left out, empty tables give no rows or no hits.
    """
    counts, hits, windows = find_windows(docs, benchmark, doc_id, doc_text, item_id, item_text)
    key = ["key_id", "key_text"]
    words = hits.groupBy(*key).agg(_covered(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("n_hit"))
    items = (hits.select(*key, "window").distinct()
             .join(small(windows), "window").select(*key, F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"))
             .groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items")))
    return (counts.join(words.join(items, key), key, "left")
            .select(F.col("id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))

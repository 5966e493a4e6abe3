"""Line dedup by a tree of line templates.

Lines are parsed to a fixed depth: first by their number of tokens, then by their leading ``DEPTH`` tokens, with
every token that holds a digit generalised to ``<*>``. In a leaf, a token that most of its different lines
have at a position is constant there and any other is generalised to ``<*>``; lines whose tokens agree with
``SIMILAR`` of the leaf's positions belong to its template. A line's own text, digits generalised, is a
template too. Templates that recur across documents are boilerplate and all their lines are dropped.

Copies must not count as recurrence, or each copied text would go entirely. So a template recurs across
*families*, which are groups of copies and near copies: each line gives two hashes, of its leaf and of its last
tokens, each document ``BANDS`` keys of the smallest hashes in ``BAND_ROWS`` random orders, and documents that
share a key are connected. One shared line is seldom the smallest in all orders of a key, whatever its hash, so
it connects few documents; documents of which five in six hashes agree share a key but for 3 in 100,000. A
template is dropped if it occurs in ``MIN_FAMILIES`` families or more, however often it stands in each and
however many copies a family has; one or two tokens of fewer than ``SHORT_BYTES`` bytes need ``SHORT_FAMILIES``. Documents most of whose lines are shared are copies by this measure.

Only DataFrame functions are used. Counts are hash aggregates with partial sums; lines of the same text or
leaf are never gathered in one task.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.components import connected_components
from ticklane.llm.shared import row_key, small, stored

DEPTH = 3
MIN_FAMILIES = 5
# short lines: of fewer tokens than DEPTH and fewer bytes than this
SHORT_BYTES = 16
SHORT_FAMILIES = 20
BANDS = 16
BAND_ROWS = 4
SEED = 42
CONSTANT = 0.6
SIMILAR = 0.7
KEY = ["key_id", "key_text"]


def masked(line: Column) -> Column:
    """The line with each token that holds a digit generalised; one or two tokens that all hold one stay as they are."""
    return F.when(line.rlike("[0-9]") & ~line.rlike(r"^[^\s0-9]*+[0-9]\S*+( [^\s0-9]*+[0-9]\S*+)?$"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(line)


def _tokens_of(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(line: Column) -> Column:
    return F.xxhash64(_tokens_of(line), F.substring_index(line, " ", DEPTH))


def _bands(lines: Column) -> Column:
    """The document's keys; xor with a random number gives the hashes another order."""
    rng = random.Random(SEED)
    orders = F.array(*[F.array(*[F.lit(rng.getrandbits(64) - (1 << 63)) for _ in range(BAND_ROWS)]) for _ in range(BANDS)])
    units = F.flatten(F.transform(F.filter(lines, lambda line: F.trim(line) != ""), lambda line: F.array(
        _leaf(line), F.xxhash64(F.substring_index(line, " ", -DEPTH), F.lit(DEPTH)))))
    # as the variable of a lambda the hashes are computed once a document
    return F.transform(F.array(units), lambda hashes: F.transform(orders, lambda order: F.xxhash64(
        F.transform(order, lambda number: F.array_min(F.transform(hashes, lambda value: value.bitwiseXOR(number)))))))[0]


def parsed_documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A row per document: its masked lines, its keys, and ``node``, which documents with the same keys share."""
    rows = docs.select(*row_key(id_column, text_column), F.split(F.coalesce(F.col(text_column), F.lit("")), "\n").alias("lines"))
    rows = stored(rows.select(*KEY, F.transform("lines", masked).alias("lines")).withColumn("bands", _bands(F.col("lines"))))
    return rows.withColumn("node", F.xxhash64("bands"))


def parsed_lines(parsed: DataFrame) -> DataFrame:
    """A row per line that is not blank: its place, leaf, masked text and the document's node."""
    lines = parsed.select(*KEY, "node", F.posexplode("lines").alias("line_no", "masked")).filter(F.col("masked").rlike(r"\S"))
    return lines.withColumn("leaf", _leaf(F.col("masked")))


def document_families(parsed: DataFrame) -> DataFrame:
    """``node``, ``root`` of the nodes connected with others by shared keys; any other node is a family alone."""
    nodes = stored(parsed.groupBy("node").agg(F.first("bands").alias("bands")))
    entries = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = stored(entries.groupBy("band", "key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
                  .filter(F.col("hub") < F.col("last")).drop("last"))
    return connected_components(entries.join(hubs, ["band", "key"]).select("node", "hub"), "node", "hub")


def _recurring(places: DataFrame, families: DataFrame, *keys: str) -> DataFrame:
    """Keys that recur across families; ``places`` has a row per key and node."""
    return (places.join(families, "node", "left").select(*keys, F.coalesce("root", "node").alias("family")).distinct()
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("families")).filter(F.col("families") >= MIN_FAMILIES))


def recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key_id``, ``key_text``, ``line_no`` (from 0) of the lines whose template recurs across documents."""
    parsed = parsed_documents(docs, id_column, text_column)
    families = small(document_families(parsed))
    lines = parsed_lines(parsed).withColumn("own", F.xxhash64("masked"))
    short = (_tokens_of(F.col("masked")) < DEPTH) & (F.octet_length("masked") < SHORT_BYTES)
    counts = stored(lines.select("leaf", "own", "node", short.alias("short")).distinct())
    # a family has one node at least, so this is no more than what the joins need not look at
    leaves = stored(counts.select("leaf", "node").distinct().groupBy("leaf").count().filter(F.col("count") >= MIN_FAMILIES).select("leaf"))
    # a leaf of fewer tokens than DEPTH has one text only, so what is asked of short lines is asked here
    leaves = stored(_recurring(counts.select("leaf", "short", "node").distinct().join(small(leaves), "leaf", "left_semi"), families, "leaf", "short")
                    .filter(~F.col("short") | (F.col("families") >= SHORT_FAMILIES)).select("leaf"))
    # the lines of leaves in which a template can recur: a small part of all lines
    lines = stored(lines.join(small(leaves), "leaf", "left_semi"))
    counts = stored(counts.join(small(leaves), "leaf", "left_semi").join(families, "node", "left")
                    .select("leaf", "own", F.coalesce("root", "node").alias("family")).distinct())
    whole = (counts.groupBy("leaf", "own").agg(F.count(F.lit(1)).alias("families")).filter(F.col("families") >= MIN_FAMILIES)
             .select("leaf", "own", F.lit(True).alias("whole")))

    texts = lines.groupBy("leaf", "own").agg(F.min("masked").alias("masked")).join(
        counts.groupBy("leaf", "own").agg(F.count(F.lit(1)).alias("weight")), ["leaf", "own"])
    tokens = texts.select("leaf", "weight", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    positions = tokens.groupBy("leaf", "at", "token").agg(F.sum("weight").alias("n")).groupBy("leaf", "at").agg(
        F.max_by("token", F.col("n")).alias("token"), (F.max("n") / F.sum("n")).alias("share"))
    templates = positions.groupBy("leaf").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("share") >= CONSTANT, F.col("token")).alias("token")))),
        lambda place: place["token"]).alias("template"))
    templates = stored(templates)
    same = F.size(F.filter(F.zip_with(F.split("masked", " "), "template", lambda token, fixed: token == fixed), lambda equal: equal))
    lines = (lines.join(small(templates), "leaf")
             .withColumn("fits", same >= SIMILAR * F.size("template"))
             .select(*KEY, "line_no", "node", "leaf", "own", "fits"))
    lines = stored(lines)
    general = _recurring(lines.filter("fits").select("leaf", "node").distinct(), families, "leaf").select("leaf", F.lit(True).alias("general"))
    return (lines.join(small(stored(whole)), ["leaf", "own"], "left").join(small(stored(general)), "leaf", "left")
            .filter(F.col("whole") | (F.col("fits") & F.col("general"))).select(*KEY, "line_no"))


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                         count_column: str = "n_dropped") -> DataFrame:
    """The documents, all columns, with the lines of recurring templates taken out of the text.

    ``count_column`` (long) is added: lines dropped. Lines are what ``\\n`` separates; blank lines
    are never dropped. Null and empty texts stay as they are; a text whose lines are all dropped becomes empty.
    Equal rows give equal rows; an empty table gives no rows.
    """
    dropped = recurring_lines(docs, id_column, text_column).groupBy(*KEY).agg(F.array_sort(F.collect_set("line_no")).alias("gone_lines"))
    keys = [column.alias(name) for column, name in zip(row_key(id_column, text_column), ("gone_id", "gone_text"))]
    rows = docs.select(F.struct("*").alias("doc"), *keys).join(
        dropped, (F.col("gone_id") == F.col("key_id")) & (F.col("gone_text") == F.col("key_text")), "left")
    rows = rows.withColumn("lines", F.when(F.col("gone_lines").isNotNull(), F.split(F.col("doc")[text_column], "\n")))
    # the stretches between dropped lines
    before = F.concat(F.array(F.lit(-1)), F.col("gone_lines"))
    kept = F.flatten(F.transform(before, lambda place, i: F.slice(
        "lines", place + 2, F.coalesce(F.get(F.col("gone_lines"), i), F.size("lines")) - place - 1)))
    text = F.when(F.col("gone_lines").isNull(), F.col("doc")[text_column]).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(name) if name == text_column else F.col("doc")[name].alias(name) for name in docs.columns]
    return rows.select(*columns, F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias(count_column))

"""Substring dedup by sliding sentence spans.

A text is cut into sentence units: a unit ends with a sentence (a stop before white space, a full stop of a script
without spaces) or with a line; a sentence of fewer than ``SHORTEST`` words is joined with the next one on its line. A
sentence of more than ``LONGEST`` words is cut after each word whose hash, taken with the word before it, is the smallest
among ``REACH`` words to either side, so the cuts of a passage meet again after a few words wherever it begins.
In scripts without spaces a character is a word, and three of them count as one for these lengths.
Every run of ``RUN`` consecutive units is hashed and all runs are joined globally. Of
equal runs the one with the smallest document id, then position, is the first; the units that any other one
covers are removed. Units follow the content, so a passage is cut alike wherever it stands.

Hashes that occur once are found by an aggregate with partial counts. Only the runs of repeated hashes are
carried on; the join that finds them has one row per hash on one side, so a run that a third of all documents
share can be split.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import row_key, stored

RUN = 3
SHORTEST = 4
LONGEST = 12
KEY = ["key_id", "key_text"]
# kana, Han, Thai, Lao, Tibetan, Burmese and Khmer letters
SPACELESS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
STOPS = ".!?\u2026\u061f\u06d4\u0964\u3002\uff01\uff1f\uff61"
WORD = re.compile(rf"[{SPACELESS}][{STOPS}]*|[^\s{SPACELESS}]+")
SINGLE = re.compile(f"[{SPACELESS}]")
REACH = 4
# line number, first and last character (exclusive) in the line, words
Unit = tuple[int, int, int, list[str]]


def content_cuts(words: list[str], reach: int) -> list[int]:
    """Where a long sentence is cut, its end included; periodic content, which has no smallest hash, is cut evenly."""
    hashes = [zlib.crc32(f"{before} {word}".encode("utf-8", "surrogatepass")) for before, word in zip(["", *words], words)]
    cuts, last = [], 0
    for i in range(reach, len(words) - reach):
        own = hashes[i]
        if own < min(hashes[i - reach:i]) and own <= min(hashes[i + 1:i + 1 + reach]) or i + 1 - last >= 16 * reach:
            last = i + 1
            cuts.append(last)
    return [*cuts, len(words)]


def units_of(text: str | None) -> list[Unit]:
    """The units in order; those of a line cover it from its first word on."""
    units: list[Unit] = []
    for number, line in enumerate((text or "").split("\n")):
        found = [(match.group(), match.start()) for match in WORD.finditer(line)]
        words = [word for word, _ in found]
        ends, begin = [], 0
        for end, word in enumerate(words, 1):
            if word[-1] not in STOPS and end < len(words):
                continue
            size = end - begin
            scale = 1 if size <= LONGEST or 2 * sum(bool(SINGLE.match(w)) for w in words[begin:end]) <= size else 3
            if size > LONGEST * scale:
                ends += [begin + cut for cut in content_cuts(words[begin:end], REACH * scale)]
            elif size >= SHORTEST or end == len(words):
                ends.append(end)
            else:
                continue
            begin = end
        begin = 0
        for end in ends:
            stop = found[end][1] if end < len(words) else len(line)
            units.append((number, found[begin][1], stop, words[begin:end]))
            begin = end
    return units


def run_hashes(units: list[Unit]) -> np.ndarray:
    """A signed 64-bit hash for each run of ``RUN`` units."""
    texts = [" ".join(words) for *_, words in units]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest("\n".join(texts[i:i + RUN])) for i in range(len(texts) - RUN + 1)),
                       dtype="<u8", count=max(0, len(texts) - RUN + 1)).view("<i8")


def without_units(text: str, gone: set[int]) -> str:
    """The text without these units; lines that lose all of theirs go too."""
    lines = text.split("\n")
    kept: dict[int, list[str]] = {}
    changed = set()
    for place, (number, start, stop, _) in enumerate(units_of(text)):
        if place in gone:
            changed.add(number)
        else:
            kept.setdefault(number, []).append(lines[number][start:stop])
    return "\n".join("".join(kept[i]).strip() if i in changed else line
                     for i, line in enumerate(lines) if i not in changed or i in kept)


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key_id``, ``key_text``, ``place`` (unit, from 0), ``hash`` and ``first`` (boolean) of each run that occurs again."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                hashes = [run_hashes(units_of(text)) for text in part["text"]]
                sizes = [len(h) for h in hashes]
                yield pd.DataFrame({
                    "key_id": np.repeat(part["key_id"].to_numpy(), sizes), "key_text": np.repeat(part["key_text"].to_numpy(), sizes),
                    "place": np.concatenate([np.arange(n, dtype="int32") for n in sizes]), "hash": np.concatenate(hashes)})

    rows = docs.select(*row_key(id_column, text_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    spans = stored(rows.mapInPandas(runs, "key_id long, key_text long, place int, hash long"))
    repeated = stored(spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key_id").alias("first_id"))
                      .filter("n > 1").select("hash", "first_id"))
    again = stored(spans.join(repeated, "hash"))
    firsts = stored(again.filter(F.col("key_id") == F.col("first_id")).groupBy("hash")
                    .agg(F.min(F.struct("key_text", "place")).alias("first")))
    return again.join(firsts, "hash").select(
        *KEY, "place", "hash", ((F.col("key_id") == F.col("first_id")) & (F.col("key_text") == F.col("first.key_text"))
                                & (F.col("place") == F.col("first.place"))).alias("first"))


def drop_repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        count_column: str = "n_removed", words_column: str = "n_removed_words") -> DataFrame:
    """The documents, all columns, without the sentence units that a non-first repeated run covers.

    Two longs are added: units and words removed. Texts of fewer than ``RUN`` units have no runs and stay; null and
    empty texts stay as they are; a text of which nothing is left becomes empty. A run repeated within one text is
    removed there too. Equal rows are one document and are treated alike; an empty table gives no rows.
    """
    runs = repeated_runs(docs, id_column, text_column).filter(~F.col("first"))
    covered = runs.groupBy(*KEY).agg(F.collect_set("place").alias("gone_places"))
    keys = [column.alias(name) for column, name in zip(row_key(id_column, text_column), ("gone_id", "gone_text"))]
    rows = docs.select(F.struct("*").alias("doc"), *keys).join(
        covered, (F.col("gone_id") == F.col("key_id")) & (F.col("gone_text") == F.col("key_text")), "left")

    @F.pandas_udf("text string, units long, words long")
    def clean(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        result = []
        for text, starts in zip(texts, places):
            if text is None or starts is None:
                result.append((text, 0, 0))
                continue
            gone = {int(start) + i for start in starts for i in range(RUN)}
            units = units_of(text)
            result.append((without_units(text, gone), len(gone), sum(len(units[i][3]) for i in gone)))
        return pd.DataFrame(result, columns=["text", "units", "words"])

    rows = rows.withColumn("cleaned", clean(F.col("doc")[text_column], F.col("gone_places")))
    columns = [F.col("cleaned.text").alias(name) if name == text_column else F.col("doc")[name].alias(name) for name in docs.columns]
    return rows.select(*columns, F.col("cleaned.units").alias(count_column), F.col("cleaned.words").alias(words_column))

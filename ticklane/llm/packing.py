"""Best-fit packing of tokenised documents by length patterns.

Documents longer than a sequence are cut; the pieces of each length are counted. The counts, at most one per
length, are all that planning needs. Patterns of a few lengths that fill a sequence exactly are enumerated: a
length, another from a few representative ones, and the rest. Non-negative least squares fits how often each
pattern repeats to the histogram, the repeats are rounded within what is left, and the residual lengths are
packed best-fit decreasing, again by counts. So the plan's size depends on the sequence length alone.

Pieces are numbered within their length by counting in buckets and adding the buckets before, so a length that
very many pieces share is spread over tasks. The plan then says for each range of numbers the sequences and the
place in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.shared import stored

REPRESENTATIVES = 16
ITERATIONS = 200
BUCKET_ROWS = 200_000
# tokens gathered, and words encoded, at once in a task
BLOCK = 2_000_000
WORDS_AT_ONCE = 10_000
# how special tokens begin; they are found before letters are lower-cased
SPECIAL = "<|"


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def encode_words(words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and how many each has.

    Many words are encoded as one text, which saves an object per word; tokens are given to words by where they begin.
    A full stop or comma after a plain letter is a token of its own, so words are encoded without it.
    """
    bare = [word[:-1] if word[-1:] in (".", ",") and word[-2:-1].isascii() and word[-2:-1].isalpha() and "'" not in word else word
            for word in words]
    place = {word: number for number, word in enumerate(dict.fromkeys([*bare, ".", ","]))}
    different = list(place)
    ids, owners = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype="int64")]
    for i in range(0, len(different), WORDS_AT_ONCE):
        part = different[i:i + WORDS_AT_ONCE]
        begins = np.cumsum([0] + [len(word) + 1 for word in part[:-1]])
        found = tokenizer.encode(" ".join(part), add_special_tokens=False)
        at = np.fromiter((begin for begin, _ in found.offsets), dtype="int64", count=len(found.ids))
        ids.append(np.array(found.ids, dtype="<u4"))
        owners.append(i + np.searchsorted(begins, at, side="right") - 1)
    pool = np.concatenate(ids)
    counts = np.bincount(np.concatenate(owners), minlength=len(different))
    starts = np.cumsum(counts) - counts
    word = np.fromiter((place[word] for word in bare), dtype="int64", count=len(bare))
    ends = np.fromiter((place[w[-1]] if len(w) != len(b) else -1 for w, b in zip(words, bare)), dtype="int64", count=len(bare))
    sizes = counts[word] + (ends >= 0)
    flat = np.zeros(int(sizes.sum()), dtype="<u4")
    own = np.ones(len(flat), dtype=bool)
    tails = np.cumsum(sizes)[ends >= 0] - 1
    own[tails] = False
    flat[own] = pool[_ranges(starts[word], counts[word])]
    flat[tails] = pool[starts[ends[ends >= 0]]]
    return flat, sizes


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: ``doc_id``, ``piece`` (from 0), ``start`` (tokens before it), ``length`` and ``ids`` (little-endian
    unsigned 32-bit token ids).

    A document is its token ids, then ``end_id``; null and empty texts are ``end_id`` alone. The tokenizer must lower
    letters, drop white space and split words from signs, so that the different words of a batch are encoded once
    each. The file at ``tokenizer_path`` must be there on the executors.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            if not pc.any(pc.match_substring(texts, SPECIAL)).as_py():
                texts = pc.ascii_lower(texts)
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            codes, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy()
            pool, sizes = encode_words(coded.dictionary.to_pylist(), tokenizer)
            begins = np.cumsum(sizes) - sizes
            before = np.r_[0, np.cumsum(sizes[codes])]
            ends = before[offsets[1:]]
            ids = batch.column(0)
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(ends, before[offsets[first]] + BLOCK)))
                part = codes[offsets[first]:offsets[last]]
                n = sizes[part]
                flat = pool[_ranges(begins[part], n)]
                stops = ends[first:last] - before[offsets[first]]
                flat = np.insert(flat, stops, end_id)
                stops = stops + np.arange(1, last - first + 1)
                total = np.diff(np.r_[0, stops])
                pieces = -(-total // length)
                row = np.repeat(np.arange(last - first), pieces)
                piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                size = np.minimum(total[row] - start, length)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + first)), pa.array(piece.astype("int32")), pa.array(start), pa.array(size),
                     pa.LargeBinaryArray.from_buffers(
                         pa.large_binary(), len(size), [None, pa.py_buffer(4 * np.r_[0, np.cumsum(size)]),
                                                        pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])
                first = last

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def exact_patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """Triples of lengths that fill a sequence exactly (a length may be 0), one per row, descending; ``counts[l]`` pieces
    have length ``l``."""
    lengths = np.nonzero(counts[:size])[0]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, 3), dtype="int64")
    share = np.cumsum(counts[lengths]) / counts[lengths].sum()
    middle = np.unique(np.r_[0, lengths[np.searchsorted(share, (np.arange(REPRESENTATIVES) + 0.5) / REPRESENTATIVES)]])
    one, two = (grid.ravel() for grid in np.meshgrid(lengths, middle, indexing="ij"))
    three = size - one - two
    good = (three >= 0) & ((three == 0) | (counts[np.clip(three, 0, size)] > 0))
    return np.unique(-np.sort(-np.stack([one, two, three], axis=1)[good], axis=1), axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the repeats to the histogram, by multiplicative updates."""
    if not len(patterns):
        return np.zeros(0)
    some, target = patterns > 0, counts.astype("float64")

    def lengths_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (some * x[:, None]).ravel(), len(counts))

    pull = (target[patterns] * some).sum(axis=1)
    x = np.full(len(patterns), target.sum() / len(patterns) / 3)
    for _ in range(ITERATIONS):
        x *= pull / np.maximum((lengths_of(x)[patterns] * some).sum(axis=1), 1e-12)
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing by counts: contents (length, times) of each kind of sequence, and how many there are."""
    open_kinds: dict[int, list[tuple[list[tuple[int, int]], int]]] = {size: []}
    for length in np.nonzero(counts)[0][::-1].tolist():
        left = int(counts[length])
        while left:
            rooms = [room for room, kinds in open_kinds.items() if room >= length and kinds]
            room = min(rooms, default=size)
            if rooms:
                contents, number = open_kinds[room].pop()
            else:
                contents, number = [], -(-left // (size // length))
            times = room // length
            full = min(number, left // times)
            rest = min(left - full * times, times) if full < number else 0
            for filled, n in ((times, full), (rest, 1 if rest else 0), (0, number - full - (1 if rest else 0))):
                if n and (filled or contents):
                    open_kinds.setdefault(room - filled * length, []).append((contents + [(length, filled)] if filled else contents, n))
            left -= full * times + rest
    return [kind for kinds in open_kinds.values() for kind in kinds]


def plan_sequences(counts: np.ndarray, size: int) -> pd.DataFrame:
    """Ranges of piece numbers within a length and where they go: ``length``, ``first`` number, ``sequence`` of it (the next
    number goes to the next sequence), ``offset``. ``counts`` has ``size`` + 1 entries."""
    left = counts.astype("int64").copy()
    kinds: list[tuple[list[tuple[int, int]], int]] = []
    patterns = exact_patterns(left, size)
    repeats = fit_repeats(patterns, left)
    for at in np.argsort(-repeats, kind="stable").tolist():
        wanted = int(repeats[at] + 0.5)
        if wanted == 0:
            break
        lengths, times = np.unique(patterns[at][patterns[at] > 0], return_counts=True)
        wanted = min(wanted, int((left[lengths] // times).min()))
        if wanted:
            left[lengths] -= wanted * times
            kinds.append((list(zip(lengths.tolist(), times.tolist())), wanted))
    kinds += best_fit(left, size)
    rows, used, sequence = [], np.zeros(size + 1, dtype="int64"), 0
    for contents, number in kinds:
        offset = 0
        for length, times in contents:
            for _ in range(times):
                rows.append((length, int(used[length]), sequence, offset))
                used[length] += number
                offset += length
        sequence += number
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, size: int = 2048, length_column: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces, all columns, with ``sequence_id`` and ``offset`` (longs): where each goes.

    Lengths must lie between 1 and ``size``. Within a sequence offsets are gapless from 0. ``order`` names columns
    that tell pieces of one length apart; equal rows are pieces of their own. An empty table gives no rows.
    """
    pieces = stored(pieces)
    histogram = pieces.groupBy(length_column).count().collect()  # at most one row per length
    counts = np.zeros(size + 1, dtype="int64")
    for length, count in histogram:
        if length is None or not 1 <= length <= size:
            raise ValueError(f"a piece has {length} tokens; lengths go from 1 to {size}")
        counts[length] = count
    plan = plan_sequences(counts, size)
    starts = pieces.sparkSession.sparkContext.broadcast(
        (np.int64(1 << 48) * plan["length"].to_numpy("int64") + plan["first"].to_numpy("int64"), plan["first"].to_numpy("int64"),
         plan["sequence"].to_numpy("int64"), plan["offset"].to_numpy("int64")))

    buckets = max(1, -(-int(counts.sum()) // BUCKET_ROWS))
    place = [F.col(length_column), F.col("pack_bucket")]
    rows = pieces.withColumn("pack_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = rows.groupBy(F.col(length_column).alias("pack_length"), F.col("pack_bucket").alias("pack_of")).agg(F.count(F.lit(1)).alias("pack_n"))
    ahead = Window.partitionBy("pack_length").orderBy("pack_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pack_length", "pack_of", F.coalesce(F.sum("pack_n").over(ahead), F.lit(0)).alias("pack_before"))
    rows = rows.withColumn("pack_row", F.row_number().over(Window.partitionBy(*place).orderBy(*order)))
    rows = rows.join(stored(sums), (F.col(length_column) == F.col("pack_length")) & (F.col("pack_bucket") == F.col("pack_of")))
    number = (F.col("pack_before") + F.col("pack_row") - 1).alias("pack_number")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        keys, firsts, sequences, offsets = starts.value
        at = np.searchsorted(keys, np.int64(1 << 48) * lengths.to_numpy("int64") + numbers.to_numpy("int64"), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + numbers.to_numpy("int64") - firsts[at], "offset": offsets[at]})

    rows = rows.select(*pieces.columns, number).withColumn("pack_place", placed(F.col(length_column), F.col("pack_number")))
    return rows.select(*pieces.columns, "pack_place.sequence_id", "pack_place.offset")

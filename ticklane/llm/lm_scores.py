"""Language-model scores by cross-entropy difference.

A target model (documents one wants more of) and a background model (all documents) are word bigram models over one
vocabulary, the distinct words of all documents. Words are runs of ASCII letters and digits and of characters below
U+0800, A-Z in lower case; any other sign, and each character from U+0800 on, is a word of its own; control characters
and spaces separate. Both models are counted over all of their documents, whole, and smoothed alike: a bigram falls
back on the word with ``KAPPA`` pseudo-counts, the word on the uniform distribution. A document is scored by what the
*other* documents hold: its own counts are taken out of both models first, or it would vouch for itself. Its score
is the mean over its words of target loss minus background loss, in nats; lower is more like the target.

The counts grow with the corpus and are never gathered in one place. A task packs documents into blocks of about
``BLOCK`` bytes and sends each distinct word and bigram of a block, with its counts there, to the part of its hash;
a part adds them up and answers each block with the totals; blocks and answers meet and the block's documents
are scored. The number of parts follows the size of the corpus, and a frequent word is sent once a block. Words and
bigrams are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import small, stored

KAPPA = 1.0
# bytes of documents in a block, and bytes of documents for each part of the counts
BLOCK = 4 * 1024 * 1024
PART = 16 * 1024 * 1024
# bytes hashed at once
WINDOW = 1 << 20
BEGIN = np.uint64(1)
SPACE, LETTER, CONTINUED, SINGLE = range(4)
FACTOR = 0x9E3779B97F4A7C15
ASKED = "kind int, block long, part long, keys binary, target binary, background binary"
TOTALS = "block long, kind int, part long, target binary, background binary, n_distinct long, n_target long, n_background long"


def byte_classes() -> np.ndarray:
    table = np.full(256, SINGLE, dtype="uint8")
    table[:33] = table[127] = SPACE
    for first, last in ("09", "AZ", "az"):
        table[ord(first):ord(last) + 1] = LETTER
    table[0x80:0xC0] = CONTINUED
    table[0xC0:0xE0] = LETTER
    return table


CLASSES = byte_classes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of a 64-bit number decides each bit of the result."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A number for each byte, the same for both cases of a letter."""
    values = mixed(np.arange(1, 257, dtype="uint64") * np.uint64(FACTOR))
    values[65:91] = values[97:123]
    return values


VALUES = byte_values()


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype="uint64")
    out[:1] = 1
    return np.cumprod(out, dtype="uint64")


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and its hash: a polynomial from differences of prefix sums."""
    classes = CLASSES[raw]
    chars = np.flatnonzero(classes != CONTINUED)
    kinds = classes[chars]
    letter = kinds == LETTER
    inside = letter & np.r_[False, letter[:-1]]
    edges = np.flatnonzero(~inside)
    first = kinds[edges] != SPACE
    starts = chars[edges][first]
    ends = np.r_[chars[edges][1:], len(raw)][first]
    hashes = np.empty(len(starts), dtype="uint64")
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
        base, size = starts[at], int(ends[stop - 1] - starts[at])
        sums = np.r_[np.uint64(0), np.cumsum(VALUES[raw[base:base + size]] * powers(size, FACTOR), dtype="uint64")]
        back = powers(size, pow(FACTOR, -1, 1 << 64))
        hashes[at:stop] = (sums[ends[at:stop] - base] - sums[starts[at:stop] - base]) * back[starts[at:stop] - base]
        at = stop
    # 0 and 1 are no word's hash
    return starts, np.maximum(mixed(hashes), np.uint64(2))


class Block:
    """Words and bigrams of some documents: distinct hashes in ascending order, and each occurrence's place there."""

    def __init__(self, texts: list[bytes]):
        offsets = np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), "int64", len(texts)))]
        starts, hashes = words(np.frombuffer(b"\n".join(texts), dtype="uint8"))
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        opens = np.r_[True, self.doc[1:] != self.doc[:-1]][:len(starts)]
        before = np.where(opens, BEGIN, np.r_[BEGIN, hashes[:-1]][:len(starts)])
        # a begin mark per document that has words is counted among the words, as a context
        begun = np.unique(self.doc)
        self.words, places = np.unique(np.r_[hashes, np.full(len(begun), BEGIN)], return_inverse=True)
        self.word, self.word_doc, self.all_places = places[:len(hashes)], np.r_[self.doc, begun], places
        self.before = np.searchsorted(self.words, before)
        self.pairs, self.pair = np.unique(mixed(before * np.uint64(FACTOR) + hashes), return_inverse=True)

    def requests(self, parts: int, wanted: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        """Kind (1 words, 2 bigrams), part, hashes, and their counts in target and all documents."""
        for kind, keys, places, doc in ((1, self.words, self.all_places, self.word_doc), (2, self.pairs, self.pair, self.doc)):
            every = np.bincount(places, minlength=len(keys))
            of_target = np.bincount(places[wanted[doc]], minlength=len(keys))
            part = part_of(keys, parts)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][:len(part)])
            for start, stop in zip(cuts, np.r_[cuts[1:], len(part)]):
                steps = np.diff(keys[start:stop], prepend=np.uint64(0))
                yield kind, int(part[start]), packed(steps), packed(of_target[start:stop]), packed(every[start:stop])

    def own(self, places: np.ndarray, doc: np.ndarray, *asked: np.ndarray) -> list[np.ndarray]:
        """How often the document of each word holds the entries ``asked`` itself."""
        size = max(len(self.words), len(self.pairs), 1)
        found, number = np.unique(doc * size + places, return_counts=True)
        return [number[np.searchsorted(found, self.doc * size + entries)] for entries in asked]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so sorted hashes lie in the order of the parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers with like bytes side by side, compressed: most counts and the high bytes of steps are small."""
    return zstandard.compress(np.ascontiguousarray(numbers).view("uint8").reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes, kind: str = "int64") -> np.ndarray:
    columns = np.frombuffer(zstandard.decompress(raw), dtype="uint8").reshape(8, -1)
    return np.ascontiguousarray(columns.T).view(kind).ravel()


def packed_documents(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def document_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The documents of each block, packed into one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0

        def row() -> pa.RecordBatch:
            ids, texts, flags = (list(column) for column in zip(*waiting))
            held = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(flags, pa.bool_())], ["id", "text", "wanted"])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed_documents(held)], pa.binary())], ["block", "texts"])

        for batch in batches:
            for i, text, flag in zip(*batch.columns):
                waiting.append((i.as_py(), text.as_py().encode("utf-8", "surrogatepass"), flag.as_py()))
                size += len(waiting[-1][1]) + 16
                if size >= block_bytes:
                    yield row()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield row()

    return docs.select("id", "text", "is_target").mapInArrow(pack, "block long, texts binary")


def unpacked_block(texts: bytes) -> tuple[pa.Table, Block, np.ndarray]:
    docs = pa.ipc.open_stream(texts).read_all()
    return docs, Block(docs.column("text").to_pylist()), docs.column("wanted").to_numpy().astype(bool)


def block_requests(blocks: DataFrame, parts: int) -> DataFrame:
    """What each block asks of each part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 3
        names = [field.split()[0] for field in ASKED.split(", ")]
        for batch in batches:
            for number, texts in zip(*batch.columns):
                _, block, wanted = unpacked_block(texts.as_py())
                out = [(kind, number.as_py(), part, *sent) for kind, part, *sent in block.requests(parts, wanted)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), types)], names)

    return blocks.select("block", "texts").mapInArrow(ask, ASKED)


def total_counts(requests: DataFrame) -> DataFrame:
    """For each request the totals over all blocks; the first row of a part and kind also has the sums for the vocabulary."""

    def add_up(table: pa.Table) -> pa.Table:
        out, every = [], table.to_pylist()
        for kind in (1, 2):
            rows = [row for row in every if row["kind"] == kind]
            if not rows:
                continue
            keys = [np.cumsum(unpacked(row["keys"], "uint64"), dtype="uint64") for row in rows]
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = []
            for name in ("target", "background"):
                # sums of doubles are exact here: counts stay below 2**53
                sums.append(np.bincount(place, np.concatenate([unpacked(row[name]) for row in rows]), len(found)).astype("int64"))
            real = found != BEGIN
            extra = [int(real.sum()), *(int(totals[real].sum()) for totals in sums)] if kind == 1 else [0, 0, 0]
            ends = np.cumsum([len(k) for k in keys])
            for row, own, stop in zip(rows, keys, ends):
                at = place[stop - len(own):stop]
                out.append((row["block"], kind, row["part"], packed(sums[0][at]), packed(sums[1][at]), *extra))
                extra = [0, 0, 0]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), types)],
                                    names=[field.split()[0] for field in TOTALS.split(", ")])

    return requests.groupBy("part").applyInArrow(add_up, TOTALS)


def scored_blocks(blocks: DataFrame, totals: DataFrame, vocabulary: int, sizes: tuple[int, int], kappa: float) -> DataFrame:
    """Mean losses of the documents of each block."""

    def score(held: pa.Table, answers: pa.Table) -> pa.Table:
        docs, block, wanted = unpacked_block(held.column("texts")[0].as_py())
        n = block.n_words
        counts = {}
        for row in sorted(answers.to_pylist(), key=lambda row: (row["kind"], row["part"])):
            for name in ("target", "background"):
                counts.setdefault((row["kind"], name), []).append(unpacked(row[name]))
        own_word, own_before = block.own(block.all_places, block.word_doc, block.word, block.before)
        own_pair, = block.own(block.pair, block.doc, block.pair)
        means = []
        for name, size, mine in (("target", sizes[0], wanted), ("background", sizes[1], np.ones(len(n), dtype=bool))):
            if len(block.doc):
                word, pair = (np.concatenate(counts[kind, name]) for kind in (1, 2))
                own = mine[block.doc]
                single = (word[block.word] - own * own_word + kappa / vocabulary) / (size - own * n[block.doc] + kappa)
                double = (pair[block.pair] - own * own_pair + kappa * single) / (word[block.before] - own * own_before + kappa)
                loss = np.bincount(block.doc, -np.log(double), len(n))
            else:
                loss = np.zeros(len(n))
            means.append(pa.array(loss / np.maximum(n, 1), mask=n == 0))
        return pa.Table.from_arrays([docs.column("id"), pa.array(n.astype("int64")), *means],
                                    names=["id", "n_tokens", "target_loss", "background_loss"])

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        score, "id long, n_tokens long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                             target_column: str = "doc_id", kappa: float = KAPPA, block_bytes: int = BLOCK,
                             part_bytes: int = PART) -> DataFrame:
    """One row per input row: its id, ``n_tokens`` (words of the text), ``target_loss``, ``background_loss`` (mean nats a word)
    and ``score`` (their difference).

    ``targets`` names the documents of the target model by id; ids that are null or have no document count for
    nothing, and without any target the target model is uniform. Null texts, and texts without words, have no tokens
    and null losses. Equal rows give equal rows and each counts for the others; other columns are left out; an
    empty table gives no rows. Block and part sizes don't change the result. A document is held whole by its task.
    """
    names = small(stored(targets.select(F.col(target_column).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
                         .withColumn("is_target", F.lit(True))))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    marked = rows.join(names, "id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    blocks = stored(document_blocks(marked, block_bytes))
    totals = stored(total_counts(block_requests(blocks, max(1, math.ceil(size / part_bytes)))))
    vocabulary, *sizes = totals.agg(*(F.coalesce(F.sum(name), F.lit(0)) for name in ("n_distinct", "n_target", "n_background"))).first()
    scored = scored_blocks(blocks, totals.select("block", "kind", "part", "target", "background"),
                           max(vocabulary, 1), tuple(sizes), kappa)
    return scored.select(F.col("id").alias(id_column), "n_tokens", "target_loss", "background_loss",
                         (F.col("target_loss") - F.col("background_loss")).alias("score"))

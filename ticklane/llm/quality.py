"""Quality classifier by co-training.

Two questions are answered for each document: is it junk, and is it toxic. Each has two views. The text view
scores words and word beginnings by their log odds between classes and looks at how words are decorated and
repeated; the metadata view, a linear discriminant, sees language, source, size and the make-up of lines and
characters, but no words. Both are fitted on labelled documents. In each round each view labels all documents
that it is sure of, and the other view learns from them: the number of documents with each word, and sums and
products of the metadata, are added up on the executors by class, and only these sums reach the driver. At last
the views are calibrated and combined on labelled documents that neither has seen, and every document is scored.

Only labelled documents are sampled, with the bound ``MAX_LABELLED`` (smallest hashes of the ids); all other
documents take part in every round, and all are scored, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.shared import stored

MAX_LABELLED = 12_000
ROUNDS = 3
SURE = 0.97
FEATURES = 1 << 18
PREFIX = 5
STRONG = 1.5
LEVELS = 64
# bytes of text looked at together in a task
BLOCK = 4 * 1024 * 1024
HEADS = ("junk", "toxic")
# numbers of a page, with its two levels, and shape rates
NUMBERS, RATES = 11, 5
# sums by class are sent in parts of so many features, gathered by shards of tasks first
PART, SHARDS = 1 << 13, 64
# documents looked at together when their features are read
BATCH = 1000
UPPER = bytes(range(65, 91))
PLAIN = bytes([*range(48, 58), *range(65, 91), *range(97, 123), 9, 10, 13, 32, *range(128, 256)])


@dataclass
class Words:
    """The words of a batch: per document offsets into codes of the different words, and what is known of each word.

    ``counts`` says how often each of a document's words occurs where repeats are left out, the flags where a document has
    a feature for the first time.
    """

    offsets: np.ndarray
    codes: np.ndarray
    word: np.ndarray
    prefix: np.ndarray
    shapes: np.ndarray
    counts: np.ndarray | None = None
    first_word: np.ndarray | None = None
    first_prefix: np.ndarray | None = None


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    word, prefix, shapes = [], [], []
    for token in coded.dictionary.to_pylist():
        core = token.strip("!%&$#*|.,;:?\"'()[]{}<>-_=+/\\~^@`")
        lower = core.lower()
        word.append(zlib.crc32(lower.encode("utf-8", "surrogatepass")) % FEATURES)
        prefix.append(zlib.crc32(b"^" + lower[:PREFIX].encode("utf-8", "surrogatepass")) % FEATURES)
        tail = len(token) - len(core)
        shapes.append((tail > 1, not core, len(core) > 1 and core.isupper(), core.isdigit()))
    offsets = lists.offsets.to_numpy()
    return Words(offsets - offsets[0], coded.indices.to_numpy().astype("int64"), np.array(word, dtype="int64"),
                 np.array(prefix, dtype="int64"), np.array(shapes, dtype="float64").reshape(-1, 4))


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes."""
    block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64")) // BLOCK
    cuts = [0, *(np.nonzero(block[1:] != block[:-1])[0] + 1).tolist(), len(texts)]
    return [(start, stop) for start, stop in zip(cuts, cuts[1:]) if stop > start]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]


def shape_rates(words: Words) -> np.ndarray:
    """Per document the share of words with decorations, without letters, in capitals, of digits, and repeated ones."""
    n = np.maximum(np.diff(words.offsets), 1)
    again = np.r_[False, words.codes[1:] == words.codes[:-1]].astype("float64") if len(words.codes) else np.zeros(0)
    # the first word of a document repeats nothing, whatever document lies before it
    again[words.offsets[:-1][np.diff(words.offsets) > 0]] = 0
    rates = [_sums(words.shapes[words.codes, i], words.offsets) / n for i in range(4)]
    return np.stack([*rates, _sums(again, words.offsets) / n], axis=1)


def word_stats(words: Words, weights: np.ndarray) -> np.ndarray:
    """Per document: largest weight, logarithm of the number and share of strong words, mean weight."""
    each = np.maximum(weights[words.word], weights[words.prefix])[words.codes]
    some = np.diff(words.offsets) > 0
    largest = np.zeros(len(some))
    if len(each):
        largest[some] = np.maximum.reduceat(each, words.offsets[:-1][some])
    counts = np.ones(len(each)) if words.counts is None else words.counts
    strong = _sums((each >= STRONG) * counts, words.offsets)
    n = np.maximum(_sums(counts, words.offsets), 1)
    return np.stack([largest, np.log1p(strong), strong / n, _sums(each * counts, words.offsets) / n], axis=1)


def page_numbers(batch: pd.DataFrame) -> np.ndarray:
    """Numbers about a page that need no word of it, then the numbers of the levels of its language and source."""
    rows = []
    for text, lang, source, chars in zip(batch["text"], batch["lang"], batch["source"], batch["n_chars"]):
        raw = (text or "").encode("utf-8", "surrogatepass")
        size = max(len(raw), 1)
        lines = raw.split(b"\n")
        symbols = len(raw.translate(None, PLAIN)) / size
        capitals = (len(raw) - len(raw.translate(None, UPPER))) / size
        levels = [zlib.crc32(str(lang).encode()) % LEVELS, zlib.crc32(str(source).encode()) % LEVELS]
        chars = len(text or "") if chars is None or chars != chars else chars
        rows.append(np.r_[np.log1p(max(float(chars), 0.0)), np.log1p(len(lines)), np.log1p(size / len(lines)), len(set(lines)) / len(lines),
                          symbols, np.sqrt(symbols), capitals, np.sqrt(capitals), raw.count(b" ") / size, levels])
    return np.array(rows).reshape(-1, NUMBERS)


def metadata(numbers: np.ndarray) -> np.ndarray:
    """The page numbers with one-hot levels."""
    rows = np.zeros((len(numbers), NUMBERS - 2 + 2 * LEVELS))
    rows[:, :NUMBERS - 2] = numbers[:, :NUMBERS - 2]
    for i, column in enumerate((NUMBERS - 2, NUMBERS - 1)):
        rows[np.arange(len(rows)), NUMBERS - 2 + i * LEVELS + numbers[:, column].astype("int64")] = 1
    return rows


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (mean, scale, then coefficients and intercept) by Newton steps; columns are standardised."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-3])
    beta = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.stack([np.r_[mean, 0], np.r_[scale, 1], beta])


def logit(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    mean, scale, beta = model
    return np.clip((x - mean[:-1]) / scale[:-1], -20, 20) @ beta[:-1] + beta[-1]


def log_odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weight of each feature that tells the classes apart beyond chance, zero for the others.

    ``seen`` has the documents of class 0 and 1 with each feature, ``n`` the documents of the classes.
    """
    n0, n1 = np.maximum(n, 1)
    p1, p0, p = seen[1] / n1, seen[0] / n0, (seen[0] + seen[1]) / (n0 + n1)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    weight = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    return np.where((np.abs(z) >= 4) & (seen[0] + seen[1] >= 3), weight, 0.0).astype("float32")


def discriminant(n: np.ndarray, total: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Direction in which the class means of the metadata differ most against the spread within classes.

    ``n``, ``total`` and ``products`` are rows, sums and sums of products of class 0 and 1.
    """
    mean = total / np.maximum(n, 1)[:, None]
    within = sum(products[k] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)) / max(n.sum() - 2, 1)
    # columns that are the same everywhere hold rounding errors only
    between = (mean[1] - mean[0]) ** 2 * n[0] * n[1] / max(n.sum(), 1) ** 2
    varies = np.diag(within) + between > 1e-9
    scale = np.sqrt(np.maximum(np.diag(within), 0)[varies]) + 1e-3
    ridge = within[np.ix_(varies, varies)] / np.outer(scale, scale) + np.eye(len(scale)) * 0.05
    direction = np.zeros(len(varies))
    direction[varies] = np.linalg.solve(ridge, (mean[1] - mean[0])[varies] / scale) / scale
    return direction


@dataclass
class TextView:
    weights: np.ndarray
    model: np.ndarray

    def scores(self, words: Words, rates: np.ndarray) -> np.ndarray:
        return logit(self.model, np.c_[word_stats(words, self.weights), rates])


@dataclass
class MetaView:
    direction: np.ndarray
    model: np.ndarray

    def scores(self, meta: np.ndarray) -> np.ndarray:
        return logit(self.model, (meta @ self.direction)[:, None])


def chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Head:
    """One question: both views and how they are combined; or a constant where the labels have one class only."""

    text: TextView | None
    meta: MetaView | None
    combined: np.ndarray | None
    constant: float

    def probability(self, words: Words, rates: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(meta), self.constant)
        return chance(logit(self.combined, np.stack([self.text.scores(words, rates), self.meta.scores(meta)], axis=1)))


class Sums:
    """What is added up over documents, by question and class: documents with each feature, by halves, and metadata."""

    def __init__(self):
        width = NUMBERS - 2 + 2 * LEVELS
        self.docs = np.zeros((len(HEADS), 2, 2))
        self.seen = np.zeros((len(HEADS), 2, 2, FEATURES), dtype="int64")
        self.pages = np.zeros((len(HEADS), 2))
        self.total = np.zeros((len(HEADS), 2, width))
        self.products = np.zeros((len(HEADS), 2, width, width))

    def add_words(self, head: int, kind: int, half: np.ndarray, rows: np.ndarray, words: Words) -> None:
        """The features of some documents of a batch; ``half`` of each document."""
        sizes = np.diff(words.offsets)
        for side in (0, 1):
            chosen = np.zeros(len(sizes), dtype=bool)
            chosen[rows[half[rows] == side]] = True
            self.docs[head, kind, side] += chosen.sum()
            own = np.repeat(chosen, sizes)
            for features, first in ((words.word, words.first_word), (words.prefix, words.first_prefix)):
                self.seen[head, kind, side] += np.bincount(features[own & first], minlength=FEATURES)

    def add_pages(self, head: int, kind: int, meta: np.ndarray) -> None:
        self.pages[head, kind] += len(meta)
        self.total[head, kind] += meta.sum(axis=0)
        self.products[head, kind] += meta.T @ meta

    def parts(self) -> list[tuple[int, bytes]]:
        """Numbered arrays, compressed: the features in parts, then all else in one."""
        flat = self.seen.reshape(-1, PART)
        found = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(flat) if part.any()]
        rest = np.concatenate([x.ravel() for x in (self.docs, self.pages, self.total, self.products)])
        return [*found, (len(flat), zlib.compress(rest.tobytes(), 1))]

    @classmethod
    def of(cls, parts: list[tuple[int, bytes]]) -> Sums:
        sums = cls()
        flat = sums.seen.reshape(-1, PART)
        for number, packed in parts:
            if number < len(flat):
                flat[number] += np.frombuffer(zlib.decompress(packed), dtype="int64")
            else:
                rest, at = np.frombuffer(zlib.decompress(packed), dtype="float64"), 0
                for x in (sums.docs, sums.pages, sums.total, sums.products):
                    x += rest[at:at + x.size].reshape(x.shape)
                    at += x.size
        return sums


def unpacked(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, shape rates and page numbers of stored features."""
    pairs, counts = batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()
    sizes = [len(raw) // 8 for raw in pairs]
    codes = np.frombuffer(b"".join(pairs), dtype="<i8")
    offsets = np.r_[0, np.cumsum(sizes)].astype("int64")
    # stored as steps from the document's last pair
    starts = offsets[:-1][np.array(sizes, dtype="int64") > 0]
    run = np.cumsum(codes)
    before = np.repeat(np.r_[0, run][starts], np.array([n for n in sizes if n], dtype="int64")) if len(starts) else np.zeros(0, "int64")
    codes = run - before
    dense = np.frombuffer(b"".join(batch.column("dense").to_pylist()), dtype="<f8").reshape(-1, NUMBERS + RATES)
    counts = np.frombuffer(b"".join(counts), dtype="<i4")
    words = Words(offsets, np.arange(len(codes)), codes // FEATURES, codes % FEATURES, np.zeros((0, 4)), counts >> 2, counts & 1 > 0, counts & 2 > 0)
    return words, dense[:, NUMBERS:], dense[:, :NUMBERS]


FEATURE_SCHEMA = "doc_id long, row_key long, pairs binary, counts binary, dense binary"


def features_of(docs: DataFrame) -> DataFrame:
    """The features of all documents: different pairs of word and beginning with their numbers, page numbers and rates."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(start, stop - start) for whole in batches for start, stop in slices(whole.column(1))):
            words = words_of(batch.column(1))
            dense = np.c_[page_numbers(pa.Table.from_batches([batch]).to_pandas()), shape_rates(words)].astype("<f8")
            pairs, counts = [], []
            for start, stop in zip(words.offsets, words.offsets[1:]):
                own = words.codes[start:stop]
                each, number = np.unique(words.word[own] * FEATURES + words.prefix[own], return_counts=True)
                first = np.zeros(2 * len(each), dtype="int64")
                first[np.unique(np.r_[each // FEATURES, each % FEATURES], return_index=True)[1]] = 1
                pairs.append(np.diff(each, prepend=0).astype("<i8").tobytes())
                counts.append((number << 2 | first[:len(each)] | first[len(each):] << 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(pairs, pa.binary()), pa.array(counts, pa.binary()),
                                              pa.array([row.tobytes() for row in dense], pa.binary())], names=["doc_id", "row_key", "pairs", "counts", "dense"])

    return stored(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key")).mapInArrow(extract, FEATURE_SCHEMA))


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of documents."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def half_of(pairs: list[bytes]) -> np.ndarray:
    """Half of a document, by its words."""
    return np.array([zlib.crc32(raw) & 1 for raw in pairs], dtype="int64")


def summed(parts: DataFrame) -> Sums:
    """Add up the parts of all tasks, shard by shard, then all shards."""
    def merge(group: pa.Table) -> pa.Table:
        # part of the features are whole numbers, the last part is of doubles
        kind = "int64" if group["number"][0].as_py() < len(HEADS) * 4 * FEATURES // PART else "float64"
        total = sum(np.frombuffer(zlib.decompress(packed), dtype=kind) for packed in group["packed"].to_pylist())
        return group.select(["shard", "number"]).slice(0, 1).append_column("packed", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))

    schema = "shard int, number int, packed binary"
    once = parts.groupBy("shard", "number").applyInArrow(merge, schema).withColumn("shard", F.lit(0))
    return Sums.of([(row.number, row.packed) for row in once.groupBy("shard", "number").applyInArrow(merge, schema).collect()])


def learned_from(pool: DataFrame, heads: dict[str, Head]) -> Sums:
    """Sums over the documents that one view is sure of, for the other view to learn from."""
    shared = pool.sparkSession.sparkContext.broadcast(heads)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shard = Sums(), TaskContext.get().partitionId() % SHARDS
        for batch in few(batches):
            words, rates, numbers = unpacked(batch)
            meta, half = metadata(numbers), half_of(batch.column("pairs").to_pylist())
            for h, head in enumerate(shared.value[name] for name in HEADS):
                if head.text is not None:
                    by_text, by_meta = chance(head.text.scores(words, rates)), chance(head.meta.scores(meta))
                    for kind in (0, 1):
                        sure = [(p if kind else 1 - p) >= SURE for p in (by_text, by_meta)]
                        sums.add_pages(h, kind, meta[sure[0]])
                        sums.add_words(h, kind, half, np.nonzero(sure[1])[0], words)
        parts = sums.parts()
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int32()), pa.array([n for n, _ in parts], pa.int32()),
                                          pa.array([packed for _, packed in parts], pa.binary())], names=["shard", "number", "packed"])

    return summed(pool.select("pairs", "counts", "dense").mapInArrow(learn, "shard int, number int, packed binary"))


@dataclass
class Labelled:
    """The sampled labelled documents as the driver sees them: numbers only, no words.

    ``kind`` of each question is 0, 1 or -1; ``part`` is 0 for held-out documents, else 1 or 2 for the halves.
    """

    kind: np.ndarray
    part: np.ndarray
    rates: np.ndarray
    meta: np.ndarray


def labelled_sums(labelled: DataFrame) -> Sums:
    """Word counts of the labelled documents that are not held out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shard = Sums(), TaskContext.get().partitionId() % SHARDS
        for batch in few(batches):
            words = unpacked(batch)[0]
            for h, name in enumerate(HEADS):
                kind, part = (batch.column(f"{name}{end}").to_numpy(zero_copy_only=False) for end in ("", "_part"))
                for k in (0, 1):
                    sums.add_words(h, k, part - 1, np.nonzero((kind == k) & (part > 0))[0], words)
        parts = sums.parts()
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int32()), pa.array([n for n, _ in parts], pa.int32()),
                                          pa.array([packed for _, packed in parts], pa.binary())], names=["shard", "number", "packed"])

    return summed(labelled.select("pairs", "counts", "dense", *LABELS).mapInArrow(count, "shard int, number int, packed binary"))


def labelled_stats(labelled: DataFrame, weights: list[list[np.ndarray]]) -> np.ndarray:
    """Word statistics of the labelled documents for each question, in the order of ``row_key``.

    ``weights`` of a question: of all documents, and of each half. A document of a half is looked at with the weights of the
    other half, so the model on word statistics is fitted on documents whose words did not make the weights.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(weights)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            words, found = unpacked(batch)[0], []
            for h, name in enumerate(HEADS):
                part = batch.column(f"{name}_part").to_numpy(zero_copy_only=False)
                each = np.stack([word_stats(words, w) for w in (shared.value[h][0], shared.value[h][2], shared.value[h][1])])
                found.append(each[part, np.arange(len(part))])
            rows = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array([row.tobytes() for row in rows], pa.binary())], names=["row_key", "stats"])

    rows = labelled.select("row_key", "pairs", "counts", "dense", *LABELS).mapInArrow(look, "row_key long, stats binary").collect()
    found = [np.frombuffer(row.stats, dtype="float64") for row in sorted(rows, key=lambda row: row.row_key)]
    return np.array(found).reshape(len(found), len(HEADS), 4)


LABELS = [f"{name}{end}" for name in HEADS for end in ("", "_part")]


def co_train(labelled: DataFrame, pool: DataFrame) -> dict[str, Head]:
    """Both heads from features with labels (``LABELS``) and features without."""
    rows = labelled.select("row_key", "dense", *LABELS).toPandas().sort_values("row_key", ignore_index=True)
    dense = np.frombuffer(b"".join(rows["dense"]), dtype="<f8").reshape(-1, NUMBERS + RATES)
    known = Labelled(rows[list(HEADS)].to_numpy().T, rows[[f"{name}_part" for name in HEADS]].to_numpy().T, dense[:, NUMBERS:], metadata(dense[:, :NUMBERS]))
    trains = {}
    heads = {}
    for h, name in enumerate(HEADS):
        kind, part = known.kind[h], known.part[h]
        heads[name] = Head(None, None, None, float(kind.mean()) if len(kind) else 0.0)
        if len(kind) >= 10 and len(np.unique(kind[part > 0])) == 2 and len(np.unique(kind[part == 0])) == 2:
            trains[h] = np.nonzero(part > 0)[0]
    if not trains:
        return heads
    base = labelled_sums(labelled)
    for h, train in trains.items():
        for k in (0, 1):
            base.add_pages(h, k, known.meta[train[known.kind[h][train] == k]])
    more = Sums()
    for turn in range(ROUNDS + 1):
        seen, docs = base.seen + more.seen, base.docs + more.docs
        weights = [[log_odds(seen[h].sum(axis=1), docs[h].sum(axis=1)), *[log_odds(seen[h][:, side], docs[h][:, side]) for side in (0, 1)]]
                   for h in range(len(HEADS))]
        del seen
        stats = labelled_stats(labelled, weights)
        for h, train in trains.items():
            y = known.kind[h].astype("float64")
            text = TextView(weights[h][0], logistic(np.c_[stats[train, h], known.rates[train]], y[train]))
            direction = discriminant(base.pages[h] + more.pages[h], base.total[h] + more.total[h], base.products[h] + more.products[h])
            meta = MetaView(direction, logistic((known.meta[train] @ direction)[:, None], y[train], ridge=0.1))
            held = np.nonzero(known.part[h] == 0)[0]
            both = np.stack([logit(text.model, np.c_[stats[held, h], known.rates[held]]), meta.scores(known.meta[held])], axis=1)
            heads[HEADS[h]] = Head(text, meta, logistic(both, y[held], ridge=0.1), heads[HEADS[h]].constant)
        if turn < ROUNDS:
            more = learned_from(pool, heads)
    return heads


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(id_column: str, text_column: str, lang: str, source: str, chars: str) -> list[Column]:
    return [F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
            F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(chars).cast("double").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, Head]:
    """Both heads from documents (renamed as in ``COLUMNS``) and ``labels`` (doc_id, quality, toxic).

    Labels that are null or contradict each other are left out. Of several rows of a labelled id the one with the smallest
    hash counts. Of each class every fourth document is held out.
    """
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("q"), F.min("toxic").alias("toxic"), F.max("toxic").alias("t"))
             .filter("quality = q AND toxic = t")
             .select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"), (F.col("toxic") > 0).cast("int").alias("toxic")))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    order = F.xxhash64("doc_id")
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_labelled)
    for name in HEADS:
        # max_labelled rows at most
        place = F.row_number().over(Window.partitionBy(name).orderBy(order, "doc_id")) - 1
        chosen = chosen.withColumn(f"{name}_part", F.when(place % 4 == 0, 0).otherwise(1 + place % 2))
    chosen = stored(chosen)
    if chosen.isEmpty():
        return {name: Head(None, None, None, 0.0) for name in HEADS}
    found = features_of(docs)
    first = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *LABELS).agg(F.min("row_key").alias("row_key"))
    labelled = stored(found.join(F.broadcast(stored(first)), ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"]))
    return co_train(labelled, found.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti"))


def with_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                 source_column: str = "source", chars_column: str = "n_chars", name: str = "quality_scores",
                 max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents, all columns, with ``name`` (``p_junk`` and ``p_toxic``, doubles between 0 and 1).

    Null and empty texts are texts without words; null language, source and size are values of their own. Without
    labels of both classes of a question its probability is the labelled share, 0 without labels. Equal rows
    give equal rows; an empty table gives no rows.
    """
    columns = _columns(id_column, text_column, lang_column, source_column, chars_column)
    heads = docs.sparkSession.sparkContext.broadcast(fit(docs.select(*columns), labels, max_labelled))

    @F.arrow_udf("struct<p_junk: double, p_toxic: double>")
    def probabilities(texts: pa.Array, langs: pa.Array, sources: pa.Array, chars: pa.Array) -> pa.Array:
        found = [np.zeros((len(HEADS), 0))]
        for start, stop in slices(texts):
            part = pa.table({"text": texts, "lang": langs, "source": sources, "n_chars": chars}).slice(start, stop - start)
            words = words_of(texts.slice(start, stop - start))
            rates, meta = shape_rates(words), metadata(page_numbers(part.to_pandas()))
            found.append(np.stack([heads.value[head].probability(words, rates, meta) for head in HEADS]))
        return pa.StructArray.from_arrays([pa.array(values) for values in np.concatenate(found, axis=1)], ["p_junk", "p_toxic"])

    return docs.withColumn(name, probabilities(*columns[1:]))


def is_kept(name: str = "quality_scores", threshold: float = 0.5) -> Column:
    """Neither junk nor toxic."""
    return (F.col(f"{name}.p_junk") < threshold) & (F.col(f"{name}.p_toxic") < threshold)

"""Token counts of whole texts by rank-synchronous merging of a byte-fallback BPE vocabulary.

Texts are cut into pre-tokens at spaces, which no piece of the vocabulary crosses. The different pre-tokens of a
batch are held as ragged numpy arrays of symbols. In each round every sequence applies its pair of lowest
rank, all sequences at once; sequences without a pair are finished and leave the arrays. What survives is
counted. A pair is merged at all its places at once where that cannot differ from merging them left to right
one by one, which the vocabulary decides; otherwise only its leftmost place is.

Runs of spaces are merged after everything else in such vocabularies, all with one rank and so from the left;
their count follows from the length of the run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.iinfo("int32").max
UNKNOWN = -1
# different pre-tokens merged together
WORDS_AT_ONCE = 100_000


class Vocabulary:
    """Symbols, pair ranks and merged symbols of a vocabulary, as arrays; bounded by the vocabulary's size."""

    def __init__(self, pieces: list[tuple[str, float]]):
        words = [(piece, score) for piece, score in pieces if piece.strip(SPACE)]
        runs = [(piece, score) for piece, score in pieces if piece and not piece.strip(SPACE)]
        if any(SPACE in piece.lstrip(SPACE) or piece.startswith(SPACE * 2) for piece, _ in words):
            raise ValueError("a piece crosses a space")
        long_runs = [score for piece, score in runs if len(piece) > 1]
        if long_runs and (len(set(long_runs)) > 1 or max(long_runs) >= min(score for _, score in words)):
            raise ValueError("runs of spaces are not merged last")
        self.run_sizes = frozenset(len(piece) for piece, _ in runs if len(piece) > 1)
        known = {piece: (number, score) for number, (piece, score) in enumerate([(SPACE, 0.0)] + words)}
        self.symbol = np.full(0x110000, UNKNOWN, dtype="int32")
        ranks = {score: rank for rank, score in enumerate(sorted({score for _, score in words}, reverse=True))}
        entries = []
        for piece, (number, score) in known.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left and right:
                    entries.append((left[0], right[0], ranks[score], number))
        table = np.array(sorted(entries), dtype="int64").reshape(-1, 4)
        self.size = len(known)
        self.pairs = table[:, 0] * self.size + table[:, 1]
        self.rank, self.merged = table[:, 2].astype("int32"), table[:, 3].astype("int32")
        # a rank is safe if no piece made with its result comes before it
        rank_of = np.array([NONE if len(piece) == 1 else ranks[score] for piece, (_, score) in known.items()], dtype="int64")
        self.safe = np.ones(len(ranks) + 1, dtype=bool)
        for side in (0, 1):
            made = rank_of[table[:, side]]
            self.safe[made[(made != NONE) & (table[:, 2] <= made)]] = False

    def pair_entries(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one) and merged symbol of each pair."""
        key = left.astype("int64") * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], NONE).astype("int32"), self.merged[at]

    def run_tokens(self, length: int) -> int:
        """Tokens of a run of spaces, merged from the left."""
        blocks: list[int] = []
        for _ in range(length):
            if blocks and blocks[-1] + 1 in self.run_sizes:
                blocks[-1] += 1
            else:
                blocks.append(1)
            while len(blocks) > 1 and blocks[-2] + blocks[-1] in self.run_sizes:
                blocks[-2:] = [blocks[-2] + blocks[-1]]
        return len(blocks)


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
                       if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))])


def word_tokens(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each pre-token (a space and these characters): number of tokens, and whether the space is one of them alone."""
    text = "".join(SPACE + word for word in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1
    symbols = vocabulary.symbol[points]
    owner = np.repeat(np.arange(len(words)), lengths)
    # characters without a piece become their UTF-8 bytes
    unknown = symbols == UNKNOWN
    wide = 1 + (points[unknown] > 0x7F) + (points[unknown] > 0x7FF) + (points[unknown] > 0xFFFF)
    tokens = np.bincount(owner[unknown], wide - 1, minlength=len(words)).astype("int64")
    alone = np.zeros(len(words), dtype=bool)
    rank = np.full(len(symbols), NONE, dtype="int32")
    merged = np.zeros(len(symbols), dtype="int32")

    def look_up(at: np.ndarray) -> None:
        at = at[at < len(symbols) - 1]
        rank[at], merged[at] = vocabulary.pair_entries(symbols[at], symbols[at + 1])
        rank[at[owner[at] != owner[at + 1]]] = NONE

    look_up(np.arange(len(symbols)))
    while len(symbols):
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            tokens[owner[starts[done]]] += sizes[done]
            alone[owner[starts[done]]] = symbols[starts[done]] == vocabulary.symbol[ord(SPACE)]
            active = np.repeat(~done, sizes)
            symbols, owner, rank, merged = symbols[active], owner[active], rank[active], merged[active]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.nonzero(rank == np.repeat(lowest, sizes))[0]
        # neighbours share a symbol: from the left, every other one of them is merged
        head = np.r_[True, np.diff(at) > 1]
        begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - begin) % 2 == 0
        first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        at = at[first | (chosen & vocabulary.safe[rank[at]])]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        place = (np.cumsum(keep) - 1)[at]
        symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
        rank[place] = NONE
        look_up(np.unique(np.r_[place, place[place > 0] - 1]))
        rank[-1] = NONE
    return tokens, alone


def text_tokens(texts: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """Number of tokens of each text."""
    lists = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if not len(codes):
        return np.zeros(len(texts), dtype="int64")
    parts = [word_tokens(words[i:i + WORDS_AT_ONCE], vocabulary) for i in range(0, len(words), WORDS_AT_ONCE)]
    tokens, alone = (np.concatenate(part) for part in zip(*parts))
    each = tokens[codes]
    # several spaces in a row: empty pre-tokens before a word, or at the end of the text
    empty = np.fromiter((not word for word in words), dtype=bool, count=len(words))[codes]
    if empty.any():
        run_tokens = functools.lru_cache(maxsize=4096)(vocabulary.run_tokens)
        each[empty] = 0
        last = np.zeros(len(codes), dtype=bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        ends = np.nonzero(empty & (last | ~np.r_[empty[1:], False]))[0]
        begins = np.nonzero(empty & ~(np.r_[False, (empty & ~last)[:-1]]))[0]
        for begin, end in zip(begins, ends):
            length = int(end - begin + 1)
            if last[end]:
                each[end] = run_tokens(length)
            else:
                bare = bool(alone[codes[end + 1]])
                each[end] = run_tokens(length + bare) - bare
    total = np.r_[0, np.cumsum(each)]
    counts = total[offsets[1:]] - total[offsets[:-1]]
    return np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, counts, 0)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 4096) -> DataFrame:
    """One row per input row: its id, ``n_bytes`` (UTF-8), ``n_tokens`` (longs) and ``over_limit``.

    Null and empty texts have no bytes and no tokens. Equal rows give equal rows; null ids are kept; other
    columns are left out; an empty table gives no rows. The vocabulary is broadcast: its size does not depend
    on the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast("int64"), pa.array(text_tokens(texts, shared.value))],
                ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return (rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
            .select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))

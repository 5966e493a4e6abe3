"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has a bit for each of 64 positions, set where more than half of the hashes of the document's
word shingles have it. Two fingerprints are linked at ``MAX_DISTANCE`` = 2 or fewer differing bits. The
64 bits are two segments of 32, each with a table of the fingerprints by their bits there. Of two fingerprints
within two bits at least one segment differs in one bit or none, so each fingerprint looks up the Hamming ball of
radius 1 of each of its segments (its bits and 32 flips), and what the tables hold there is verified by the
complete distance. A code that more than ``CROWD`` fingerprints share is looked up together with a piece of the other
segment: that differs in two bits at most, so one of its three pieces is equal. Nothing is capped, and a
fingerprint has at most 2080 others within two bits. Copies share one fingerprint and are expanded only in the result.

``similar_documents`` looks further, for texts whose sets of shingles have a Jaccard similarity of ``similarity`` (0.8).
At that similarity about 15 % of all bits differ, so it takes a fingerprint of 128 bits in four segments of 32 and
shares the ball of radius 1 on both sides, which finds pairs with two or fewer differing bits in some segment: by
calculation 97 % at a similarity of 0.95, 81 % at 0.9, 40 % at 0.8. As this is not enough, ``BANDS`` codes of
``ROWS`` smallest hashes each are looked up beside the segments: two sets share one of them with 99 % at 0.8.
What the complete distance (and, in crowded codes, the share of equal smallest hashes) allows, with ``SPREAD`` standard
deviations of the estimate, is verified by the exact similarity of the two sets of shingle hashes; only then it
is a link. A code is first compared by its smallest and largest node, which settles three nodes or fewer; of
codes with more, all pairs that are not connected yet are compared, large codes as pairs of blocks of ``BUCKET`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.components import connected_components
from ticklane.llm.shared import NO_ID, row_key, small, stored

SEED = 42
SEGMENT_BITS = 32
MAX_DISTANCE = 2
SPREAD = 2
BUCKET = 1024
# fingerprints of one segment code beyond which the other segment refines it
CROWD = 64
BANDS = 12
ROWS = 5
# shingles whose bits are counted at once, so that a very long text needs no more memory than this
BLOCK = 65_536


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another hash for each hash; the first (0) is itself."""
    for _ in range(number):
        hashes = hashes + np.uint64(0x9E3779B97F4A7C15)
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes ^ (hashes >> np.uint64(31))
    return hashes


def _shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles in blocks; none for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return
    shingles = iter([b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)))))
    total = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        size = min(BLOCK, total - start)
        yield np.fromiter((digest(next(shingles), SEED) for _ in range(size)), dtype="<u8", count=size)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Different hashes of the word shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, dtype="<u8"), *_shingle_hashes(text, width)]))


def fingerprint_of(text: str | None, width: int, parts: int = 1) -> list[int]:
    """Fingerprint of one text as ``parts`` signed 64-bit numbers; zeros for a text without words."""
    return _fingerprint(_shingle_hashes(text, width), parts)


def _fingerprint(blocks: Iterable[np.ndarray], parts: int) -> list[int]:
    ones, total = np.zeros((parts, 64), dtype="int64"), 0
    for block in blocks:
        total += len(block)
        for part in range(parts):
            bits = _mixed(block, part).view("uint8").reshape(-1, 8)
            ones[part] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


# odd factors, one for each order in which the smallest hash is taken
_ORDERS = _mixed(np.arange(BANDS * ROWS, dtype="uint64"), 1) | np.uint64(1)


def smallest_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the hashes in each of ``BANDS * ROWS`` orders; the largest number if there are none."""
    best = np.full(len(_ORDERS), np.iinfo("uint64").max, dtype="uint64")
    for start in range(0, len(hashes), 4096):
        best = np.minimum(best, (hashes[start:start + 4096, None] * _ORDERS).min(axis=0))
    return best


def band_codes(smallest: np.ndarray) -> list[int]:
    """A signed 64-bit code of each band."""
    return [int(np.uint64(xxhash.xxh64_intdigest(band.tobytes(), SEED)).astype("int64")) for band in smallest.reshape(BANDS, ROWS)]


def with_fingerprint(docs: DataFrame, text_column: str = "text", width: int = 5, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (long). Words are split at ASCII white space after lower-casing A-Z; null text is empty."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(text, width)[0] for text in texts], dtype="int64")

    return docs.withColumn(name, fingerprint(F.col(text_column)))


def _keys(key: Column, other: Column, crowded: Column) -> Column:
    """The keys a code is looked up by: itself, or one for each piece of the other segment if the code is crowded."""
    pieces = [(0, 11), (11, 11), (22, 10)]
    refined = [key.bitwiseOR(F.lit(number << 33)).bitwiseOR(
        F.shiftleft(F.shiftrightunsigned(other, first).bitwiseAND(F.lit((1 << size) - 1)), 35)) for number, (first, size) in enumerate(pieces, 1)]
    return F.explode(F.when(crowded, F.array(*refined)).otherwise(F.array(key)))


def fingerprint_links(fingerprints: DataFrame, column: str = "fingerprint", crowd: int = CROWD) -> DataFrame:
    """The pairs ``a`` < ``b`` of different fingerprints within ``MAX_DISTANCE`` bits, each once."""
    low, high = F.col("f").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("f", SEGMENT_BITS)
    # a key is the bits of a segment, and at bit 32 its number
    segments = [(low, high), (high.bitwiseOR(F.lit(1 << SEGMENT_BITS)), low)]
    flips = [0] + [1 << bit for bit in range(SEGMENT_BITS)]
    entry = lambda key, other: F.struct(key.alias("key"), other.alias("other"))
    prints = stored(fingerprints.select(F.col(column).alias("f")).distinct())
    table = prints.select("f", F.inline(F.array(*[entry(key, other) for key, other in segments])))
    ball = prints.select("f", F.inline(F.array(*[entry(key.bitwiseXOR(F.lit(flip)), other) for key, other in segments for flip in flips])))
    crowded = small(stored(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
                           .select("key", F.lit(True).alias("crowded"))))
    is_crowded = F.coalesce(F.col("crowded"), F.lit(False))
    sides = [side.join(crowded, "key", "left").select(F.col("f").alias(name), _keys(F.col("key"), F.col("other"), is_crowded).alias("key"))
             for side, name in ((ball, "a"), (table, "b"))]
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return sides[0].join(sides[1], "key").filter((F.col("a") < F.col("b")) & (distance <= MAX_DISTANCE)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (long) and ``component_id`` (smallest id reachable by links).

    Texts without words, null ones included, have fingerprint zero and are linked like any other. Equal rows
    give equal rows; null ids are kept and never are a component's id unless all its ids are null. An empty
    table gives no rows; other columns are left out.
    """
    marked = stored(with_fingerprint(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
                                     width=width).select("doc_id", "fingerprint"))
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(marked))
    linked = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = (nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
             .join(smallest, "root", "left")
             .select("fingerprint", F.coalesce("component_id", "first").alias("component_id")))
    # one row a fingerprint, stored so that a fingerprint of very many copies can be split in the join
    return (marked.join(stored(named), "fingerprint", "left")
            .select(F.col("doc_id").alias(id_column), "fingerprint", "component_id"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets of shingle hashes have the similarity."""
    both = F.size(F.array_intersect("set_a", "set_b"))
    rows = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b"))
    return stored(rows.filter(both >= similarity * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view("u8")).astype("int64")


def crowded_pairs(entries: DataFrame, most: int, similarity: float, block: int = BUCKET) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes of two families that share a code and may be similar.

    ``entries`` has ``segment``, ``code``, ``node``, ``family``, ``f0``, ``f1``, ``shingles`` and ``sketch``, a byte of each
    smallest hash. A pair shares several codes; it is taken in the first segment that has one, there with the
    smallest code on the way from one to the other. Segments from 4 on are bands; a pair that only they
    bring together is listed for each.
    """
    least = BANDS * ROWS * similarity - SPREAD * math.sqrt(BANDS * ROWS * similarity * (1 - similarity))

    buckets = entries.groupBy("segment", "code").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("one"), F.max("family").alias("two"))
    buckets = stored(buckets.filter(F.col("one") < F.col("two")).select("segment", "code", F.ceil(F.col("n") / block).alias("blocks")))
    dealt = (entries.join(buckets, ["segment", "code"]).withColumn("own", F.pmod("node", "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        segment, code, low, high = (int(rows[name].iloc[0]) for name in ("segment", "code", "low", "high"))
        one, two = (rows, rows) if low == high else (rows[rows["own"] == low], rows[rows["own"] == high])
        node, family, f0, f1, size = ([part[name].to_numpy() for part in (one, two)] for name in ("node", "family", "f0", "f1", "shingles"))
        left, right = np.nonzero((family[0][:, None] != family[1][None, :]) & (
            _bits(f0[0][:, None] ^ f0[1][None, :]) + _bits(f1[0][:, None] ^ f1[1][None, :]) <= most))
        keep = np.minimum(size[0][left], size[1][right]) >= similarity * np.maximum(size[0][left], size[1][right])
        keep &= node[0][left] < node[1][right] if low == high else True
        left, right = left[keep], right[keep]
        sketch = [np.frombuffer(b"".join(part["sketch"]), dtype="uint8").reshape(len(part), -1) for part in (one, two)]
        equal = np.ones(len(left), dtype=bool)
        for at in range(0, len(left), BLOCK):
            span = slice(at, at + BLOCK)
            equal[span] = (sketch[0][left[span]] == sketch[1][right[span]]).sum(axis=1) >= least
        left, right = left[equal], right[equal]
        parts = [[(f[side][at].view("u8") >> np.uint64(shift)) & np.uint64(0xFFFFFFFF) for side, at in ((0, left), (1, right))]
                 for f in (f0, f1) for shift in (0, SEGMENT_BITS)]
        new = np.ones(len(left), dtype=bool)
        for x, y in parts[:segment]:
            new &= np.bitwise_count(x ^ y) > 2
        if segment < len(parts):
            x, y = parts[segment]
            flip = (x ^ y) & (~(x ^ y) + np.uint64(1))
            way = np.where(np.bitwise_count(x ^ y) == 2, np.minimum(x ^ flip, y ^ flip), np.minimum(x, y))
            new &= way == np.uint64(code)
        a, b = node[0][left[new]], node[1][right[new]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("segment", "code", "low", "high").applyInPandas(compare, "a long, b long")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5,
                      similarity: float = 0.8) -> DataFrame:
    """One row per input row: its id and ``component_id``, the smallest id of the texts connected by similarity.

    Texts with equal sets of shingles and texts without words are one group each. Null ids count as the smallest
    number there is and come back as null; equal rows give equal rows; an empty table gives no rows.
    """
    groups = _similar_rows(docs, id_column, text_column, width, similarity)
    return groups.select(*[F.when(F.col(name) != NO_ID, F.col(name)).alias(other) for name, other in (("id", id_column), ("component_id", "component_id"))])


def _similar_rows(docs: DataFrame, id_column: str, text_column: str, width: int, similarity: float) -> DataFrame:
    """Of each row its ``id`` (NO_ID for null), ``text_key``, the ``root`` of its group and the smallest id there."""
    # of two sets of one size and this similarity, the cosine; then the share of bits that differ
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = int(128 * share + SPREAD * math.sqrt(128 * share * (1 - share)))

    @F.pandas_udf("node long, f0 long, f1 long, shingles int, bands array<long>, sketch binary")
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            blocks = list(_shingle_hashes(text, width))
            hashes = np.unique(np.concatenate([np.empty(0, dtype="<u8"), *blocks]))
            node = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype("int64"))
            smallest = smallest_hashes(hashes)
            rows.append((node, *_fingerprint(blocks, 2), len(hashes), band_codes(smallest), smallest.astype("uint8").tobytes()))
        return pd.DataFrame(rows, columns=["node", "f0", "f1", "shingles", "bands", "sketch"])

    @F.pandas_udf("array<long>")
    def hashes_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(text, width).view("<i8") for text in texts])

    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_column).alias("text"))
    described = ("f0", "f1", "shingles", "bands", "sketch")
    marked = stored(texts.select("id", F.xxhash64("text").alias("text_key"), fingerprint("text").alias("f")).select("id", "text_key", "f.*"))
    # texts of one set of shingles are one node, so copies are neither compared nor verified; fingerprints of one set
    # may differ with the number of times it has each shingle
    nodes = stored(marked.groupBy("node").agg(F.min("id").alias("least"), F.min("text_key").alias("text_key"),
                                              *[F.min_by(name, "text_key").alias(name) for name in described]))
    segments = [F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(name, 32)
                for name in ("f0", "f1") for low in (True, False)]
    ball = F.array(*[F.struct(F.lit(number).alias("segment"), (value.bitwiseXOR(F.lit(flip))).alias("code"))
                     for number, value in enumerate(segments) for flip in [0] + [1 << bit for bit in range(SEGMENT_BITS)]])
    bands = F.transform("bands", lambda code, number: F.struct((number + 4).alias("segment"), code.alias("code")))
    entries = nodes.select("node", F.explode(F.concat(ball, bands)).alias("e")).select("node", "e.segment", "e.code")
    hubs = stored(entries.groupBy("segment", "code").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
                  .filter(F.col("low") < F.col("high")))
    near = stored(entries.join(hubs, ["segment", "code"]))
    pairs = near.select("node", F.explode(F.array("low", "high")).alias("hub")).filter(F.col("node") != F.col("hub"))
    pairs = stored(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    for name in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("f0", "f1", "shingles")]), name)
    distance = F.bit_count(F.col("f0_a").bitwiseXOR(F.col("f0_b"))) + F.bit_count(F.col("f1_a").bitwiseXOR(F.col("f1_b")))
    # sets of more different sizes are not similar
    sizes = F.least("shingles_a", "shingles_b") >= similarity * F.greatest("shingles_a", "shingles_b")
    pairs = stored(pairs.filter((distance <= most) & sizes).select("a", "b"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "text_key"))
        sets = texts.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key")
        return stored(sets.groupBy("node").agg(F.first("text").alias("text")).select("node", hashes_of("text").alias("hashes")))

    roots = connected_components(_verified(pairs, sets_of(pairs), similarity))
    families = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("family"), "f0", "f1", "shingles", "sketch")
    crowded = stored(near.filter("n > 3").select("segment", "code", "node").join(families, "node"))
    others = stored(crowded_pairs(crowded, most, similarity).distinct())
    if not others.isEmpty():
        # the families that these connect, as a graph of families only
        links = _verified(others, sets_of(others), similarity)
        for name in ("a", "b"):
            links = links.join(families.select(F.col("node").alias(name), F.col("family").alias(f"family_{name}")), name)
        joined = connected_components(links, "family_a", "family_b").select(F.col("node").alias("family"), F.col("root").alias("joined"))
        roots = stored(families.join(joined, "family", "left").select("node", F.coalesce("joined", "family").alias("root")))
    smallest = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(roots, "node", "left").join(smallest, "root", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(stored(named), "node").select("id", "text_key", "root", "component_id")


def drop_similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5,
                           similarity: float = 0.8) -> DataFrame:
    """The document with the smallest id of each group, with all columns; of several texts with that id the one with the
    smallest hash, of rows with one id and text the one with the smallest hash of all columns.

    Nulls and empty tables are treated as in ``similar_documents``.
    """
    groups = _similar_rows(docs, id_column, text_column, width, similarity)
    first = groups.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("first")).select("first.id", "first.text_key")
    whole = F.xxhash64(*docs.columns)
    keys = docs.select(*row_key(id_column, text_column), whole.alias("key_row"))
    same = (F.col("key_id") == F.col("id")) & (F.col("key_text") == F.col("text_key"))
    kept = stored(keys.join(first, same, "left_semi").groupBy("key_id", "key_text").agg(F.min("key_row").alias("key_row")).withColumnsRenamed(
        {name: f"kept_{name}" for name in ("key_id", "key_text", "key_row")}))
    same = whole == F.col("kept_key_row")
    for part, name in zip(row_key(id_column, text_column), ("key_id", "key_text")):
        same = same & (part == F.col(f"kept_{name}"))
    # what is left of equal ids and texts is equal in all columns
    return docs.join(kept, same, "left_semi").dropDuplicates([id_column, text_column])

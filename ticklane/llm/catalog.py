"""The registered queries of these operators and the SQL some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.line_templates import drop_recurring_lines

    return drop_recurring_lines(table(spark, folder, "documents")).select("doc_id", "n_dropped", "text")


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), width=3).withColumn(
        "fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


# Brute force over all pairs; the components by repeated smallest labels.
SIMILAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT component.vec_id, coalesce(n_links, 0) AS n_links, component_id, component.vec_id = component_id AS kept
FROM component LEFT JOIN degree ON component.vec_id = degree.vec_id
"""


@query("op3_embedding_near_dedup", SIMILAR_SQL)
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.vectors import similar_vectors

    return similar_vectors(table(spark, folder, "embeddings"))


LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lengths ON len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, runs.n FROM runs JOIN windows ON runs.s = windows.s AND runs.n = windows.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@query("op4_decontamination", LEAK_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op10_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.sentence_spans import drop_repeated_spans

    return drop_repeated_spans(table(spark, folder, "documents")).select("doc_id", "n_removed", "n_removed_words", "text")


@query("op5_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from ticklane.llm.token_counts import count_tokens, sentencepiece_vocabulary

    vocabulary = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, folder, "documents"), vocabulary)


@query("op8_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from ticklane.llm.packing import pack, tokenized_pieces

    pieces = tokenized_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op6_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.quality import is_kept, with_quality

    scored = with_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "quality_scores.p_junk", "quality_scores.p_toxic", is_kept().alias("keep"))


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@query("op7_warc", WARC_SQL)
def warc(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.archive import lookup, read_records, wanted_keys, write_archives, write_index

    pages = table(spark, folder, "pages")
    index = write_index(write_archives(pages))
    records = read_records(lookup(index, wanted_keys(spark, pages)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_lm_scores")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.lm_scores import cross_entropy_difference

    good = table(spark, folder, "labels").filter("quality = 1 AND toxic = 0")
    return cross_entropy_difference(table(spark, folder, "documents"), good)


# The closed form of the shares: sources in order of how soon they are full, the first k of them filled.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER before, 0) AS given,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_weights
  FROM weighed WINDOW before AS (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(total - given AS DOUBLE) AS rest, CAST(open_weights AS DOUBLE) AS open_weights FROM filled
  WHERE (total - given) * w <= 3 * source_size * open_weights ORDER BY source_size / w, r LIMIT 1),
targets AS (
  SELECT source, r, source_size, CASE WHEN level.rest * w > 3 * source_size * level.open_weights THEN CAST(3 * source_size AS DOUBLE)
    ELSE level.rest * w / level.open_weights END AS target
  FROM weighed CROSS JOIN level),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source
    ORDER BY substring(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(size, floor(target + 0.5) - start)) + greatest(0, least(size, floor(target + 0.5) - start - source_size))
  + greatest(0, least(size, floor(target + 0.5) - start - 2 * source_size)) AS BIGINT) AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""


@query("op11_curriculum_mix", MIX_SQL)
def curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.curriculum import mix_sources

    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ROUND_SQL = """
a{now} AS (
  SELECT vec_id, x, k, d FROM (SELECT vec_id, v.x, k, row_number() OVER (PARTITION BY row_id ORDER BY d, k) AS place, d FROM (
    SELECT v.*, k, CAST(list_sum(list_transform(list_zip(v.x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v CROSS JOIN c{now}) v) WHERE place = 1),"""
MEANS_SQL = """
m{next} AS (SELECT k, list(m ORDER BY i) AS c FROM (
  SELECT k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{now} CROSS JOIN range(1, 65) r(i) GROUP BY k, i) GROUP BY k),
c{next} AS (SELECT c{now}.k, coalesce(m{next}.c, c{now}.c) AS c FROM c{now} LEFT JOIN m{next} ON c{now}.k = m{next}.k),"""
CLUSTER_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS k, x AS c
  FROM v ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) LIMIT 16),""" + "".join(
    ROUND_SQL.format(now=i) + MEANS_SQL.format(now=i, next=i + 1) for i in range(3)) + ROUND_SQL.format(now=3) + """
sums AS (SELECT k, sum(d) AS t FROM a3 GROUP BY k)
SELECT vec_id, CAST(a3.k AS INT) AS cluster, d AS distance, CAST(t AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(t) FROM sums) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN sums ON a3.k = sums.k JOIN c3 ON a3.k = c3.k
"""


@query("op12_centroid_clustering", CLUSTER_SQL)
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.centroids import clustered

    return clustered(table(spark, folder, "embeddings"))


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from ticklane.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))

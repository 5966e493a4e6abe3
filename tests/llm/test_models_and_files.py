"""Embeddings, tokens, quality, archives, packing, language models and the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import CLASHING, docs, none, texts  # noqa: F401
from pyspark.sql import functions as F
from test_documents import components

from ticklane.llm import archive, components as graph, lm_scores, packing, quality, token_counts, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    edges += [(rng.randint(3000, 3060), rng.randint(3000, 3060)) for _ in range(50)]
    found = {row.node: row.root for row in graph.connected_components(spark.createDataFrame(edges + [(None, 7)], "a long, b long")).collect()}
    expected = components({n for e in edges for n in e if e[0] != e[1]}, edges)
    assert set(found) == set(expected)
    assert {frozenset(n for n in found if found[n] == r) for r in found.values()} == {frozenset(n for n in expected if expected[n] == r) for r in expected.values()}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).astype("f4").tolist()) for i in range(60)]
    for i in range(40):
        rows.append((100 + i, (np.array(rows[i % 8][1]) + rng.standard_normal(16) * 0.12).astype("f4").tolist()))
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(210, (np.array(rows[0][1]) * 3).tolist())]
    rows += [(300, None), (301, [0.0] * 16), (302, [None] + [1.0] * 15), (303, [float("nan")] * 16), (304, [float("inf")] + [0.0] * 15), (305, [])]
    return rows + [(310, [1.0, 2.0]), (311, [2.0, 4.0]), (None, rows[9][1]), (7, rows[7][1])]


@pytest.mark.parametrize("block", [2048, 7])
def test_similar_vectors(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(0).alias("size"), F.lit(0).alias("code"), F.lit(0).alias("key"))
    good = [(k, i, np.array(v, dtype="f4").astype(float)) for k, (i, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, _, u in good for b, _, v in good if a != b and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.95]
    degree, group = collections.Counter(a for a, _ in links), components(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    expected = collections.Counter((i, degree[k], least.get(group[k]), i == least.get(group[k])) for k, (i, _) in enumerate(rows))
    found = vectors.similar_vectors(df, block=block)
    assert collections.Counter(map(tuple, found.select("vec_id", "n_links", "component_id", "kept").collect())) == expected
    assert vectors.similar_vectors(df.limit(0)).count() == 0


def test_bits_and_tables_follow_the_number_of_classes():
    assert vectors.plan(10**4, 0.95)[0] < vectors.plan(10**9, 0.95)[0]
    for n in (1, 100, 10**6):
        bits, tables = vectors.plan(n, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= vectors.MISS


def test_token_counts_equal_the_library(docs, texts, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.sentencepiece_vocabulary(path)
    rng = random.Random(6)
    parts = ["a", "e", " ", "   ", "\n", "the", "▁", "é", "漢", "\U0001f600", "12", "\t", "<s>", "<0x41>", "\x00", "====", " the", "ing", "ß"]
    odd = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + [" " * n + w for n in range(40) for w in ("", "x", "the")]
    odd += ["ab" * 3000, "".join(rng.choices("abcdefXYZ019", k=6000))]
    assert token_counts.text_tokens(pa.array(odd), vocabulary).tolist() == [len(ids) for ids in model.encode(odd)]
    expected = collections.Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 50) for i, t in texts)
    found = token_counts.count_tokens(docs, vocabulary, limit=50)
    assert collections.Counter(map(tuple, found.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == expected
    assert token_counts.count_tokens(none, vocabulary).count() == 0


def test_packing_round_trip(docs, texts, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.tokenized_pieces(docs, path, length=256)
    rows = packing.pack(pieces, size=256).collect()
    expected = collections.Counter()
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            expected[(i, k // 256, k, len(ids[k:k + 256]), zlib.crc32(np.array(ids[k:k + 256], dtype="<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == expected
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        assert [at for at, _ in sorted(parts)] == np.r_[0, np.cumsum([n for _, n in sorted(parts)])][:-1].tolist()
        assert sum(n for _, n in parts) <= 256
    assert len(places) <= 1.01 * -(-sum(r.length for r in rows) // 256)
    assert packing.pack(packing.tokenized_pieces(none, path)).count() == 0


def test_words_are_encoded_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(12)
    parts = ["a", "B", "the", ".", ",", "..", "'s", "'", "é", "E\u0301", "İ", "漢", "\U0001f600", "7", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00a0", "\x1c", "!?", "\x00", "ß", "Σ"]
    words = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(4000)] + ["", ".", ",", "it's.", "a.", "a,", "<|endoftext|>."]
    words = [part for word in words for part in word.split("\x1c")]
    flat, sizes = packing.encode_words(words, tokenizer)
    assert [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])] == [tokenizer.encode(word, add_special_tokens=False).ids for word in words]


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = 128
    counts = np.zeros(size + 1, dtype="int64")
    lengths = np.clip(rng.lognormal(3.5, 0.9, 20_000).astype(int), 1, size) if seed else np.full(9999, 50)
    np.add.at(counts, lengths, 1)
    plan = packing.plan_sequences(counts, size)
    filled, number = collections.Counter(), counts[lengths].sum() * 0
    for length, part in plan.groupby("length"):
        stops = [*part["first"].iloc[1:], counts[length]]
        assert part["first"].iloc[0] == 0
        for first, stop, sequence in zip(part["first"], stops, part["sequence"]):
            number += stop - first
            for k in range(stop - first):
                filled[sequence + k] += length
    assert number == counts.sum() and max(filled.values()) <= size
    bound = -(-int((counts * np.arange(size + 1)).sum()) // size)
    assert len(filled) <= (bound * 1.01 + 1 if seed else 5000)


def test_quality_learns_both_questions(spark, docs, none, texts):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        junk, toxic = i % 5 == 0, i % 5 == 1
        if junk:
            words = [word.upper() + "!!" for word in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "horrid"])
        rows.append((i, " ".join(words), "en" if i % 2 else None, f"s{i % 3}", None))
        if i < 280:
            labels.append((i, int(not junk), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (4, 1, None), (9999, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality.with_quality(df, labels).withColumn("keep", quality.is_kept()).filter("doc_id >= 280").collect()
    right = sum(row.keep == (row.doc_id % 5 > 1) for row in scored)
    assert right >= 0.95 * len(scored)
    other = quality.with_quality(docs, labels, name="scores")
    assert other.columns == [*docs.columns, "scores"] and other.filter("scores.p_junk BETWEEN 0 AND 1").count() == len(texts)
    assert quality.with_quality(docs, labels.limit(0)).filter(quality.is_kept()).count() == len(texts)
    assert quality.with_quality(none, labels).count() == 0


def page_rows():
    big = "<p>" + "z" * 300_000 + "</p>"
    pages = [(i, f"http://www.Site{i % 4}.example.com:80{i % 3}/a b/{i}?q={i}#f", f"<html>{i % 7}" + "x" * (i % 5) * 60 + "</html>") for i in range(60)]
    return pages + [(70, None, None), (71, "", ""), (72, "not a url", big), (73, "http://[bad", big), (74, "http://é.example/ü", "é" * 60), (75, "http://x.example", "é" * 60),
                    (3, pages[3][1], pages[3][2]), (None, "http://x.example", "é" * 60), (None, None, "n")]


def test_archives_and_index(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).select("*", *[F.lit(1).alias(n) for n in ("file", "offset", "digest")])
    captures = archive.write_archives(pages)
    index = archive.write_index(captures, block_lines=7)
    found = archive.lookup(index, archive.wanted_keys(spark, pages))
    assert found.count() == captures.count() == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    expected = collections.Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        response = first.get(html, i) if len(raw) >= 100 else i
        expected[(i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if response == i else "revisit", None if response == i else response)] += 1
    records = archive.read_records(found, with_payload=True)
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()) == expected
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in records.filter("record_type = 'response'").collect())
    # every capture of one URL, and none of an unknown one
    wanted = spark.createDataFrame([(archive.url_key("http://x.example") + " ",), ("com,nowhere)/ ",)], "prefix string")
    assert archive.lookup(index, wanted).count() == 2
    none = archive.write_index(archive.write_archives(pages.limit(0)))
    assert archive.read_records(archive.lookup(none, archive.wanted_keys(spark, pages))).count() == 0


def test_url_keys():
    assert archive.url_key("https://www.Blog.example.com/en/8?x=1#top") == "com,example,blog)/en/8?x=1"
    assert archive.url_key(None) == archive.url_key(" ") == "-"


def test_cross_entropy_difference(spark, docs, none, texts):
    targets = spark.createDataFrame([(1,), (2,), (206,), (None,), (77777,)], "doc_id long")
    extra = [(900001, "Straße, naïve ZEBRA 12ab — 日本語 zebra"), (900002, "\t\x00 \n"), (None, "the zebra"), (None, "the zebra"), (2, "другой Текст")]
    rows = texts + extra
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, block string").repartition(3)
    found = lm_scores.cross_entropy_difference(given, targets).collect()
    # small blocks and many parts give the same rows
    cut = lm_scores.cross_entropy_difference(given, targets, block_bytes=3000, part_bytes=2000).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score or 0, 6))
    assert len(found) == len(cut) == len(rows)
    for left, right in zip(sorted(found, key=order), sorted(cut, key=order)):
        assert left[:2] == right[:2] and (left.score is None) == (right.score is None)
        assert left.score is None or abs(left.score - right.score) < 1e-9

    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    split = [["^"] + re.findall("[0-9a-z\u0080-\u07ff]+|[^\x00-\x20\x7f]", (t or "").translate(fold)) for _, t in rows]
    wanted = [i in (1, 2, 206) for i, _ in rows]

    def counted(tokens):
        words = collections.Counter(tokens if len(tokens) > 1 else [])
        return words, collections.Counter(zip(tokens, tokens[1:]))

    vocabulary = len({w for tokens in split for w in tokens[1:]})
    own = [counted(tokens) for tokens in split]
    models = []
    for members in (wanted, [True] * len(rows)):
        total = (collections.Counter(), collections.Counter())
        for parts, yes in zip(own, members):
            if yes:
                total[0].update(parts[0])
                total[1].update(parts[1])
        models.append((members, *total, sum(n for w, n in total[0].items() if w != "^")))
    expected = []
    for k, (i, _) in enumerate(rows):
        n, losses = len(split[k]) - 1, []
        for members, words, pairs, size in models:
            mine = members[k]
            loss = 0.0
            for v, w in zip(split[k], split[k][1:]):
                single = (words[w] - mine * own[k][0][w] + 1 / vocabulary) / (size - mine * n + 1)
                loss -= math.log((pairs[v, w] - mine * own[k][1][v, w] + single) / (words[v] - mine * own[k][0][v] + 1))
            losses.append(loss / n if n else None)
        expected.append((i, n, *losses))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2] or 0, 6), round(r[3] or 0, 6))
    for row, want in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert tuple(row[:2]) == want[:2]
        assert row[2:4] == (None, None) if want[2] is None else max(abs(row[2] - want[2]), abs(row[3] - want[3])) < 1e-9
        assert row.score == (None if want[2] is None else row.target_loss - row.background_loss)
    assert lm_scores.cross_entropy_difference(none, targets).count() == 0


def test_scores_tell_documents_that_occur_twice(spark):
    """A near copy elsewhere in the corpus makes a document likelier; its own words alone don't."""
    rng = random.Random(5)
    lexicon = [f"w{n}" for n in range(3000)]
    texts = [" ".join(rng.choices(lexicon, k=80)) for _ in range(200)]
    rows = list(enumerate(texts)) + [(500, texts[7] + " more words"), (501, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r.doc_id: r.background_loss for r in lm_scores.cross_entropy_difference(docs, docs.limit(0)).collect()}
    twice = {7, 8, 500, 501}
    assert max(scored[i] for i in twice) < min(loss for i, loss in scored.items() if i not in twice)


def test_pipeline_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(1, " ".join(docs.filter("doc_id = 7").first().text.split()[:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, sizes = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{number}"
        stage(spark, now, folder).write.parquet(path)
        assert number == 4 or spark.read.parquet(path).columns == docs.columns
        now = spark.read.parquet(path)
        sizes.append(now.select("doc_id").distinct().count())
    assert sizes == sorted(sizes, reverse=True) and now.filter("doc_id = 7 OR doc_id = 101").count() == 0
    assert now.filter("doc_id = 8").count() > 0
    spark.createDataFrame([], docs.schema).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_contaminated_rows_go_and_not_their_ids(spark, tmp_path):
    import corpus_pipeline

    words = "some passage of the benchmark that is long enough to be one whole window of words"
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a clean text"), (None, f"x {words} y"), (None, None), (5, f"before {words}"), (5, "another clean text"), (6, "clean too")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({name: F.lit(1) for name in ("row", "hit_row", "key_id", "n_hit")})
    left = corpus_pipeline.decontamination(spark, df, str(tmp_path))
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter([rows[0], rows[2], rows[4], rows[5]])
    assert left.columns == df.columns


def quality_rows(rng, count, labelled):
    """Junk shouts, some of it in words that no labelled document has; toxic documents hold a bad word."""
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(count):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        junk, toxic = i % 4 == 0, i % 5 == 1
        if junk:
            words = [(word if i < labelled or rng.random() < 0.7 else "novelty").upper() + "!!" for word in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "horrid"])
        rows.append((i, " ".join(words), "en" if i % 2 else None, f"s{i % 3}", None))
        if i < labelled:
            labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def plain_co_training(frame, labels, rounds):
    """Whole documents in memory, sets of features in loops; models of the module on the sums found so."""
    import pandas as pd
    import zlib

    q = quality
    words = [q.words_of(pa.array([text])) for text in frame["text"]]
    rates = np.concatenate([q.shape_rates(w) for w in words])
    meta = q.metadata(q.page_numbers(frame))
    sets = [set(w.word[w.codes].tolist()) | set(w.prefix[w.codes].tolist()) for w in words]
    stored_pairs = [np.diff(np.unique(w.word[w.codes] * q.FEATURES + w.prefix[w.codes]), prepend=0).astype("<i8").tobytes() for w in words]
    half = [zlib.crc32(raw) & 1 for raw in stored_pairs]
    stats = lambda i, weights: q.word_stats(words[i], weights)[0]
    heads, kinds, parts = {}, {}, {}
    for name, at in (("junk", 1), ("toxic", 2)):
        kind = {row[0]: int(row[at] == 0) if name == "junk" else int(row[at] > 0) for row in labels}
        part = {}
        for k in (0, 1):
            for place, i in enumerate(i for i, _ in labels_order(labels) if kind[i] == k):
                part[i] = 0 if place % 4 == 0 else 1 + place % 2
        kinds[name], parts[name] = kind, part
    pseudo = {name: ([], []) for name in q.HEADS}
    for turn in range(rounds + 1):
        for name in q.HEADS:
            kind, part = kinds[name], parts[name]
            train, held = [[i for i in sorted(kind) if (part[i] > 0) == wanted] for wanted in (True, False)]
            for_text = [(i, kind[i], part[i] - 1) for i in train] + [(i, k, half[i]) for i, k in pseudo[name][0]]
            weights = []
            for sides in ((0, 1), (0,), (1,)):
                seen, n = np.zeros((2, q.FEATURES)), np.zeros(2)
                for i, k, side in for_text:
                    if side in sides:
                        n[k] += 1
                        for feature in sets[i]:
                            seen[k, feature] += 1
                weights.append(q.log_odds(seen, n))
            y = np.array([kind[i] for i in train], dtype=float)
            text = q.TextView(weights[0], q.logistic(np.array([np.r_[stats(i, weights[2 - (part[i] - 1)]), rates[i]] for i in train]), y))
            for_meta = [(i, kind[i]) for i in train] + pseudo[name][1]
            x = [meta[[i for i, k in for_meta if k == side]] for side in (0, 1)]
            direction = q.discriminant(np.array([len(rows) for rows in x]), np.array([rows.sum(axis=0) for rows in x]), np.array([rows.T @ rows for rows in x]))
            view = q.MetaView(direction, q.logistic((meta[train] @ direction)[:, None], y, ridge=0.1))
            both = np.array([[q.logit(text.model, np.r_[stats(i, weights[0]), rates[i]][None])[0], view.scores(meta[[i]])[0]] for i in held])
            heads[name] = q.Head(text, view, q.logistic(both, np.array([kind[i] for i in held], dtype=float), ridge=0.1), 0.0)
            pool = [i for i in range(len(words)) if i not in kind]
            p_text = {i: q.chance(text.scores(words[i], rates[[i]]))[0] for i in pool}
            p_meta = {i: q.chance(view.scores(meta[[i]]))[0] for i in pool}
            sure = lambda p: [(i, k) for i in pool for k in (0, 1) if (p[i] if k else 1 - p[i]) >= q.SURE]  # noqa: E731, B023
            pseudo[name] = (sure(p_meta), sure(p_text))
    return heads, [[heads[name].probability(words[i], rates[[i]], meta[[i]])[0] for name in q.HEADS] for i in range(len(words))]


def labels_order(labels):
    """Labelled ids in the order of the sample."""
    import xxhash

    signed = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) ^ 1 << 63) - (1 << 63)
    return sorted(((row[0], row) for row in labels), key=lambda pair: (signed(pair[0]), pair[0]))


def test_co_training_equals_brute_force_and_learns_from_all_documents(spark, monkeypatch):
    rows, labels = quality_rows(random.Random(4), 360, 160)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = df.orderBy("doc_id").select(*quality._columns("doc_id", "text", "lang", "source", "n_chars")).toPandas()
    heads, expected = plain_co_training(frame, labels, quality.ROUNDS)
    scored = quality.with_quality(df, known).orderBy("doc_id").collect()
    found = np.array([list(row.quality_scores) for row in scored])
    assert np.abs(found - np.array(expected)).max() < 1e-6
    assert 0.95 < np.mean((found > 0.5) == np.array([[i % 4 == 0, i % 5 == 1] for i in range(360)]))
    # a word that only unlabelled documents have counts as junk, and not without them
    novelty = quality.words_of(pa.array(["novelty"])).word[0]
    columns = df.select(*quality._columns("doc_id", "text", "lang", "source", "n_chars"))
    assert quality.fit(columns, known)["junk"].text.weights[novelty] > 1
    monkeypatch.setattr(quality, "ROUNDS", 0)
    assert quality.fit(columns, known)["junk"].text.weights[novelty] == 0

"""Line templates, fingerprints, decontamination and sentence spans against brute force."""

import collections
import random
import re

import xxhash
from llm_fixtures import docs, none, texts  # noqa: F401
from pyspark.sql import functions as F

from ticklane.llm import decontaminate as decon
from ticklane.llm import line_templates, sentence_spans, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return collections.Counter(tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in df.select(*columns).collect())


def components(nodes, linked):
    parent = {node: node for node in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, texts, none):
    prints = {text: plain_fingerprint(text, 3) for _, text in texts}
    least = {}
    for i, text in texts:
        if i is not None:
            least[prints[text]] = min(i, least.get(prints[text], i))
    group = components(least, [(a, b) for a in least for b in least if a < b and bin(a ^ b).count("1") <= 2])
    smallest = {}
    for f, root in group.items():
        smallest[root] = min(smallest.get(root, least[f]), least[f])
    expected = collections.Counter((i, prints[t] - (1 << 64) if prints[t] >> 63 else prints[t], smallest[group[prints[t]]]) for i, t in texts)
    found = simhash.near_duplicates(docs, width=3)
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(none).count() == 0


def test_links_connect_all_pairs_within_two_bits(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(4):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fingerprint long")).collect()
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert sorted((a, b) for a, b in links) == sorted(near)
    crowded = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fingerprint long"), crowd=1).collect()
    assert sorted((a, b) for a, b in crowded) == sorted(near)


def test_a_crowded_segment_loses_no_link(spark):
    rng = random.Random(8)
    # all share their low half; the high halves are close, so codes are crowded at the default bound
    halves = {rng.getrandbits(32) for _ in range(60)}
    for half in sorted(halves):
        halves |= {half ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32), half ^ 1 << rng.randrange(32)}
    signed = sorted((h << 32 | 12345) - ((1 << 64) if h >> 31 else 0) for h in halves)
    near = sorted((a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fingerprint long")).collect()
    assert len(near) > 100 and sorted((a, b) for a, b in links) == near


def test_similar_texts_are_found_from_the_threshold_on(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, pairs = [], collections.defaultdict(list)
    shingles = lambda words: {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    for i in range(400):
        words = [word() for _ in range(rng.randint(120, 400))]
        other = list(words)
        for _ in range(rng.randint(1, max(2, len(words) // 40))):
            other[rng.randrange(len(other))] = word()
        one, two = shingles(words), shingles(other)
        pairs[min(int(len(one & two) / len(one | two) * 20), 19)].append(i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    recall = {band: sum(found[1000 + i] == i for i in ids) / len(ids) for band, ids in pairs.items()}
    assert recall[16] >= 0.9 and recall[17] >= 0.9 and recall[18] >= 0.95 and recall[19] >= 0.98, recall
    assert all(value == 0 for band, value in recall.items() if band < 16), recall


def test_one_document_of_each_group_stays(docs, texts, none):
    kept = simhash.drop_similar_documents(docs)
    assert kept.columns == docs.columns
    ids = [row[0] for row in kept.select("doc_id").collect()]
    assert not {100, 101, 102, 103, 104} & set(ids) and {0, 1, 2, 3, 5} <= set(ids)
    assert simhash.drop_similar_documents(none).count() == 0
    assert collections.Counter(ids)[3] == 1 and len(ids) < len(texts)


def plain_windows(docs, items):
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for item, text in items:
        words = split(text)
        n = min(len(words), 10)
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i:i + n])].add("" if item is None else str(item))
    result = []
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                got = windows.get(tuple(words[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        result.append((i, len(words), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return collections.Counter(result)


def template_pages(pages: int, shared: int, own: int):
    """Pages with words of one template and words of their own, each with a copy that has another last word."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    template = " ".join(word() for _ in range(shared))
    rows = [(i, f"{template} " + " ".join(word() for _ in range(own))) for i in range(pages)]
    return rows + [(pages + i, text + " " + word()) for i, text in rows]


def test_pages_of_one_template_are_no_near_duplicates(spark):
    rows = template_pages(1500, 200, 60)
    kept = simhash.drop_similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    ids = {row.doc_id for row in kept.select("doc_id").collect()}
    # no page is lost; a copy stays where fingerprints don't find it
    assert ids >= set(range(1500)) and len(ids) < 1515


def test_all_members_of_a_code_are_compared(spark):
    rng = random.Random(6)
    segments = [[rng.getrandbits(32) for _ in range(4)] for _ in range(30)]
    for parts in segments[:20]:
        parts[1] = segments[0][1] ^ (rng.random() < 0.5) << rng.randrange(32) ^ (rng.random() < 0.5) << rng.randrange(32)
    for parts in segments[8:12]:
        parts[2:] = [segments[8][2] ^ 1 << rng.randrange(32), segments[8][3] ^ 1 << rng.randrange(32)]
        parts[0] = segments[8][0] ^ 7 << rng.randrange(29)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = [(i, i, signed(p[0] | p[1] << 32), signed(p[2] | p[3] << 32), 100, b"s" * 60) for i, p in enumerate(segments)]
    balls = [(s, p[s] ^ flip, *node) for node, p in zip(nodes, segments) for s in range(4) for flip in [0, *(1 << bit for bit in range(32))]]
    entries = spark.createDataFrame(balls, "segment int, code long, node long, family long, f0 long, f1 long, shingles int, sketch binary")
    bits = lambda p, q: [(x ^ y).bit_count() for x, y in zip(p, q)]
    expected = sorted((i, j) for i, p in enumerate(segments) for j, q in enumerate(segments)
                      if i < j and min(bits(p, q)) <= 2 and sum(bits(p, q)) <= 26)
    assert expected
    for block in (4, 1024):
        assert sorted((r.a, r.b) for r in simhash.crowded_pairs(entries, 26, 0.8, block).collect()) == expected


def test_decontamination(spark, docs, texts, none):
    by_id = dict(texts)
    items = [(1, " ".join(by_id[2].split()[1:40])), (2, by_id[3]), (3, "Beta"), (4, "eta, théta!"), (5, None), (6, ""), (10, by_id[2]),
             (7, "words that are in no document at all but many enough to be a window"), (None, by_id[6]), (2, by_id[3]),
             (8, "same " * 12), (9, "same " * 9)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decon.decontaminate(docs, benchmark)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == plain_windows(texts, items)
    assert decon.decontaminate(none, benchmark).count() == 0
    clean = decon.decontaminate(docs, benchmark.limit(0))
    assert clean.filter("contaminated OR n_hit > 0").count() == 0 and clean.count() == len(texts)


def test_fingerprints_are_shared_by_every_run_of_ten_words(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{rng.randint(0, 9)}" for _ in range(10))
    rows = [(i, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30))) + f" {shared} " + "z y x") for i in range(60)]
    found = decon.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, shared)], "item_id long, text string"))
    assert found.filter("n_hit >= 10").count() == 60


def boilerplate_docs():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(40):
        lines = [" ".join(word() for _ in range(rng.randint(6, 12))) for _ in range(6)]
        if i % 2 == 0:
            lines.insert(rng.randrange(6), f"Page {i} of 40 printed on day {i * 7}")
        if i % 3 == 0:
            lines.append(f"Article was written by {word()} for our readers everywhere")
        if i % 4 == 0:
            lines.append("All rights reserved.")
        rows.append((i, "\n".join(lines)))
    return rows + [(100 + i, rows[1][1]) for i in range(20)] + [(200, None), (201, ""), (202, "All rights reserved.")]


def test_templates_generalise_variable_fields(spark, docs, texts, none):
    rows = boilerplate_docs()
    result = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {row.doc_id: row for row in result.collect()}
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [line for line in lines if line.startswith(("Page ", "Article was", "All rights"))]
        assert got[i].n_dropped == len(gone), i
        assert got[i].text == (None if text is None else "\n".join(line for line in lines if line not in gone))
    # copies alone are no recurrence, and nothing crashes
    all_rows = line_templates.drop_recurring_lines(docs, count_column="gone")
    assert all_rows.count() == len(texts) and all_rows.columns == [*docs.columns, "gone"]
    assert {row.doc_id: row.text for row in all_rows.filter("doc_id IN (100, 206, 208)").collect()} == {i: t for i, t in texts if i in (100, 206, 208)}
    assert line_templates.drop_recurring_lines(none).count() == 0


def test_templates_recur_whatever_their_hash_number_and_copies(spark):
    """The line with the smallest leaf hash, a line many times in each document, a line in a text of many copies."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(rng.randint(6, 12)))
    prose = lambda: [line() for _ in range(8)]
    low = spark.createDataFrame([(f"Printed under {word()} license of this house",) for _ in range(500)], "line string").orderBy(
        line_templates._leaf(F.col("line"))).first().line
    often, hot = "Back to the top of this page", "See our terms before you order"
    rows = [(i, [*prose(), low]) for i in range(60)]
    for i in range(100, 110):
        lines = prose()
        rows.append((i, [part for own in lines for part in (own, often)] + [often] * 20))
    rows += [(i, [*prose(), hot]) for i in range(200, 210)]
    copied = [*prose(), hot]
    rows += [(1000 + i, copied) for i in range(150)]
    for i in range(150):
        near = list(copied)
        words = near[i % 8].split(" ")
        words[rng.randrange(len(words))] = word()
        rows.append((2000 + i, [*near[:i % 8], " ".join(words), *near[i % 8 + 1:]]))
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in rows], "doc_id long, text string").repartition(4)
    got = {row.doc_id: row.text for row in line_templates.drop_recurring_lines(docs).collect()}
    for i, lines in rows:
        assert got[i] == "\n".join(part for part in lines if part not in (low, often, hot)), i


def test_short_lines_and_lines_without_spaces_recur(spark):
    rng = random.Random(22)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8))
    rows = []
    for i in range(40):
        lines = [line() for _ in range(8)]
        lines += ["Read more", f"Page {i}", "Share", "", f"{i * 37}"]
        lines += ["版权所有保留所有权利"] * (i < 8) + ["Thanks!"] * (i < 8)
        rows.append((i, lines))
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in rows], "doc_id long, text string").repartition(4)
    got = {row.doc_id: row.text for row in line_templates.drop_recurring_lines(docs).collect()}
    for i, lines in rows:
        gone = ("Read more", f"Page {i}", "Share", "版权所有保留所有权利")
        assert got[i] == "\n".join(part for part in lines if part not in gone), i


def test_sentence_spans(docs, texts, none):
    first = {}
    for i, text in sorted({(-(1 << 63) if i is None else i, t or "") for i, t in texts}):
        for k, h in enumerate(sentence_spans.run_hashes(sentence_spans.units_of(text))):
            first.setdefault(int(h), (i, k))
    expected = collections.Counter()
    for i, text in texts:
        gone = set()
        for k, h in enumerate(sentence_spans.run_hashes(sentence_spans.units_of(text))):
            if first[int(h)] != (-(1 << 63) if i is None else i, k):
                gone |= {k, k + 1, k + 2}
        expected[(i, len(gone), sentence_spans.without_units(text, gone) if gone else text)] += 1
    result = sentence_spans.drop_repeated_spans(docs)
    assert rows_of(result, "doc_id", "n_removed", "text") == expected
    assert result.columns == [*docs.columns, "n_removed", "n_removed_words"]
    assert sentence_spans.drop_repeated_spans(none).count() == 0


def test_a_long_passage_goes_wherever_it_stands():
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(55)) + "."
    one, two = (sentence_spans.units_of(f"{head}\n{passage}\n{tail}") for head, tail in (("A b.", "End here."), ("Some longer start of it.", "Z.")))
    shared = set(sentence_spans.run_hashes(one)) & set(sentence_spans.run_hashes(two))
    assert len(shared) == len(sentence_spans.units_of(passage)) - 2 > 0
    assert sentence_spans.without_units("A b c d e.\nx y", {0}) == "x y"


def test_a_passage_inside_longer_sentences_is_found(spark):
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    spaced = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    plain = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows, clean = [], []
    for i in range(100):
        for first, words, size in ((0, spaced, 200), (1000, spaced, 60), (2000, plain, 200)):
            passage, gap = words(size), "" if words is plain else " "
            for copy in (0, 500):
                rows.append((first + copy + i, gap.join([words(rng.randint(20, 31)), passage, words(rng.randint(20, 31))])))
        clean.append(3000 + i)
        rows.append((3000 + i, spaced(250)))
    result = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    caught = lambda first: sum(result[first + 500 + i].n_removed > 0 for i in range(100))
    assert caught(0) == 100 and caught(1000) >= 90 and caught(2000) == 100, (caught(0), caught(1000), caught(2000))
    before = dict(rows)
    assert all(result[i].text == before[i] for i in clean) and all(result[i].text == before[i] for i in before if i % 1000 < 500)
    # what goes is one stretch of the passage, what stays is as it was
    for i in [*range(500, 600), *range(2500, 2600)]:
        assert len(result[i].text) < len(before[i]) - 80 and before[i].startswith(result[i].text[:40].strip()[:20])


def test_units_cover_their_lines():
    rng = random.Random(9)
    for _ in range(300):
        line = "".join(rng.choice(["a", "bc ", " ", ". ", "\t", "\u3002", "\u4e2d", "\u6587", "! ", "x" * 20]) for _ in range(rng.randint(0, 120)))
        units = sentence_spans.units_of(line)
        assert "".join(line[start:stop] for _, start, stop, _ in units).strip() == line.strip()
        assert [w for *_, words in units for w in words] == sentence_spans.WORD.findall(line)
    assert len(sentence_spans.units_of("same " * 3000)) > 40 and sentence_spans.units_of(" \n\t") == [] == sentence_spans.units_of(None)


def test_near_duplicates_are_told_apart_by_row_and_not_by_id(spark):
    rng = random.Random(31)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(5, a, 1), (5, b, 2), (7, b + " more", 3), (None, c, 4), (None, a + " end", 5), (9, c + " tail", 6), (5, a, 0), (5, a, 0), (None, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    kept = [tuple(r) for r in simhash.drop_similar_documents(df).collect()]
    texts = collections.Counter(t for _, t, _ in kept)
    # one row of each group: the null id is the smallest; b stays though its id is taken by a
    assert texts[a + " end"] == 1 and texts[a] == 0 and texts[b] == 1 and texts[b + " more"] == 0 and texts[c] == 1 and texts[c + " tail"] == 0
    assert len(kept) == 4 and (None, None, 7) in kept
    again = [tuple(r) for r in simhash.drop_similar_documents(df.repartition(5)).collect()]
    assert collections.Counter(map(str, again)) == collections.Counter(map(str, kept))
    twice = spark.createDataFrame([(1, a, 9), (1, a, 4), (1, a, 4)], "doc_id long, text string, n_chars long")
    assert simhash.drop_similar_documents(twice).count() == 1

"""Curriculum, clustering and whitening against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from llm_fixtures import CLASHING, docs, none, texts  # noqa: F401
from pyspark.sql import functions as F

from ticklane.llm import centroids, curriculum, whitening
from ticklane.llm.integer_vectors import component_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and left * weight[s] > most * sizes[s] * rest}
        if not above:
            return {s: float(most * sizes[s]) if s in full else left * weight[s] / rest if rest else 0.0 for s in order}
        full |= above


def plain_mix(rows):
    """Documents dealt out one after another, pass after pass, until the demand of the source is met."""
    sizes, sources = collections.Counter(), collections.defaultdict(list)
    for i, text, source in rows:
        size = len(WORD.findall(text or ""))
        sizes[source] += size
        key = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[:16]
        sources[source].append((key, i is not None, i or 0, size))
    target, result = plain_targets(sizes), []
    for source, own in sources.items():
        own.sort()
        left, taken = math.floor(target[source] + 0.5), [0] * len(own)
        for _ in range(3):
            for k, (*_, size) in enumerate(own):
                taken[k] += min(size, left)
                left -= min(size, left)
        result += [(i if there else None, size, sizes[source], target[source], t) for (_, there, i, size), t in zip(own, taken)]
    return collections.Counter(result)


def source_rows(texts):
    names = ["a", "b", "é", "z", None, "ab", "", "B"]
    rng = random.Random(3)
    rows = [(i, text, rng.choice(names)) for i, text in texts]
    rows += [(1000 + i, "w " * 40, "hot") for i in range(300)] + [(5000, "tail " * 7, "hot")] * 80 + [(5001, None, "hot"), (5001, None, "hot")]
    return rows + [(6000, None, "empty"), (6001, "  ", "empty"), (6002, "one", "tiny"), (6003, "two words", "tiny")]


def test_mix_equals_dealing_out(spark, texts):
    rows = source_rows(texts)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    df = df.select("*", *[F.lit(1).alias(name) for name in [*CLASHING, "size", "rank", "range", "copies", "begin", "target", "taken"]])
    found = curriculum.mix_sources(df)
    got = [tuple(row) for row in found.select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert collections.Counter(got) == plain_mix(rows)
    for row in found.collect():
        assert len(row.positions) == (math.ceil(row.taken / row.size) if row.size else 0) and row.taken <= 3 * row.size
        assert all(0 <= a < 1 for a in row.positions) and list(row.positions) == sorted(row.positions)
    by_source = collections.Counter()
    for row in found.collect():
        by_source[(row.source, row.target)] += row.taken
    assert all(abs(taken - target) <= 0.5 for (_, target), taken in by_source.items())
    again = curriculum.mix_sources(df.repartition(2))
    assert collections.Counter(map(str, again.collect())) == collections.Counter(map(str, found.collect()))


def test_mix_of_few_or_no_documents(spark, none):
    assert curriculum.mix_sources(none).count() == 0
    empty = spark.createDataFrame([(1, None, None), (None, "", "x")], "doc_id long, text string, source string")
    assert {tuple(r) for r in curriculum.mix_sources(empty).select("doc_id", "size", "target", "taken").collect()} == {(1, 0, 0.0, 0), (None, 0, 0.0, 0)}


@pytest.mark.parametrize("knots", [*curriculum.SCHEDULES, ((0.0, 0.0), (0.25, 4.0), (0.25, 1.0), (1.0, 0.0))])
def test_times_invert_the_integral(spark, knots):
    shares = np.linspace(0, 0.999, 200)
    df = spark.createDataFrame([(float(s),) for s in shares], "share double")
    times = [row.t for row in df.select(curriculum.time_of_demand(F.col("share"), knots).alias("t")).collect()]
    grid = np.linspace(0, 1, 400_001)
    weight = np.interp(grid, [t for t, _ in knots], [w for _, w in knots])
    for (a, v), (b, w) in zip(knots, knots[1:]):
        inside = (grid > a) & (grid <= b)
        weight[inside] = v + (w - v) * (grid[inside] - a) / (b - a) if b > a else weight[inside]
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)]) / 400_000
    assert np.abs(np.interp(times, grid, area) / curriculum.integral(knots) - shares).max() < 1e-5


def test_training_order_follows_the_schedules(spark):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(900)] + [(2000, "x y", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("words", F.lit(0))
    mixed = curriculum.mix_sources(df)
    ordered = curriculum.in_training_order(df, mixed).collect()
    positions = [row.position for row in ordered]
    assert positions == sorted(positions) and set(ordered[0].asDict()) == {"doc_id", "text", "source", "position", "words"}
    taken = collections.Counter()
    for row in ordered:
        taken[row.doc_id] += row.words
    wanted = collections.Counter()
    for row in mixed.collect():
        wanted[row.doc_id] += row.taken
    assert +taken == +wanted
    for source, knots in zip("abc", curriculum.SCHEDULES):
        half = sum(r.words for r in ordered if r.source == source and r.position < 0.5) / sum(r.words for r in ordered if r.source == source)
        (a, v), *_, (b, w) = knots
        middle = {"a": (7.5 + 5) / 2 / 2 / 5, "b": 0.5, "c": 0.25}[source]
        assert abs(half - middle) < 0.02, (source, half)


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(
        "*", *[F.lit(0).alias(name) for name in ("id", "x", "cluster", "lower", "index", "component", "label")]).repartition(3)


def odd_vectors(dims):
    inf = float("inf")
    return [(9001, None), (9002, [None] + [1.0] * (dims - 1)), (9003, [float("nan")] * dims), (9004, [inf] + [0.0] * (dims - 1)),
            (9005, [-inf] * dims), (9006, [1e30] + [0.0] * (dims - 1))]


def plain_k_means(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 1e6 for c in v)]
    start = sorted(kept, key=lambda row: (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1]))
    centres = [list(x) for _, x in start[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        for j, own in groups.items():
            centres[j] = [sum(column) // len(own) for column in zip(*own)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found)


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 9), (1, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 64)) * 0.3
    rows = [(i, (centres[i % 8] + rng.standard_normal(64) * 0.15).astype("f4").tolist()) for i in range(300)]
    rows += [(500 + i, [float(i % 3)] * 64) for i in range(40)] + [(7, rows[7][1]), (None, rows[9][1]), (600, [1.0] * 63), (601, [])]
    rows += [(700 + i, rows[3][1]) for i in range(150)] + odd_vectors(64)
    found = centroids.clustered(vector_table(spark, rows), centroids=k, rounds=rounds)
    assert collections.Counter(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())) \
        == plain_k_means(rows, k, rounds)
    df = vector_table(spark, rows)
    few = df.where("vec_id < 3")
    assert centroids.clustered(few).count() == 3 and centroids.clustered(few).where("distance > 0").count() == 0
    assert centroids.clustered(df.limit(0)).count() == 0 and centroids.clustered(df.where("vec_id > 9000")).count() == 0


def test_bounds_are_loosened_by_total_displacement():
    """Centroids that go there and back cost nothing, although each round's drift is long; ties go to the smaller number."""
    x = np.array([[0, 0], [1, 0], [100, 0], [50, 0]])
    first, away = np.array([[0, 0], [100, 0]]), np.array([[0, 40], [100, 40]])
    bounds = centroids.Bounds.first(x, first)
    assert bounds.cluster.tolist() == [0, 0, 1, 0]
    bounds.reassign(np.stack([first, away]))
    bounds.evaluated[:] = 0
    bounds.reassign(np.stack([first, away, first]))
    assert bounds.evaluated[:3].tolist() == [0, 0, 0] and bounds.cluster.tolist() == [0, 0, 1, 0]
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (500, 8))
    history = [x[:12].astype("int64")]
    bounds, spent = centroids.Bounds.first(x, history[0]), 0
    for _ in range(12):
        sums = [x[bounds.cluster == j].sum(axis=0) // max(1, (bounds.cluster == j).sum()) for j in range(12)]
        history.append(np.stack(sums))
        bounds.evaluated[:] = 0
        bounds.reassign(np.stack(history))
        spent += bounds.evaluated.sum()
        squares = np.stack([centroids.squared_distances(x, c) for c in history[-1]], axis=1)
        assert (bounds.cluster == squares.argmin(axis=1)).all()
    assert spent < 0.7 * 12 * 500 * 12


def test_component_sums_are_exact(spark):
    big = (1 << 53) - 1
    df = spark.createDataFrame([(0, [big, -big, 1]), (0, [big, -big, -2]), (1, [-1, 0, 5])] * 40, "g int, x array<long>").repartition(3)
    assert component_sums(df, "g", "x", 3) == {0: (80, [80 * big, -80 * big, -40]), 1: (40, [-40, 0, 200])}


def plain_whitening(rows, dims, components=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 1e13 for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, dtype=float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    result = {}
    for i, x in kept:
        for k in range(min(components, dims)):
            e = values[-1 - k]
            if e > 1e-9 * values.sum():
                result.setdefault((i, k + 1), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                                                          abs(float((np.array(x) - mean) @ vectors[:, -1 - k] / math.sqrt(e))), float(e / values.sum())))
    return result


@pytest.mark.parametrize("block", [4096, 50])
def test_whitening_equals_numpy(spark, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "TASK_VALUES", block * 16)
    rng = np.random.default_rng(6)
    mix = rng.standard_normal((16, 16)) * np.linspace(1, 0.05, 16)[:, None]
    rows = [(i, (rng.standard_normal(16) @ mix + 0.3).astype("f4").tolist()) for i in range(333)]
    rows += [(1000 + i, rows[5][1]) for i in range(120)] + [(5, rows[5][1]), (None, rows[8][1])] + odd_vectors(16)
    rows += [(2000, []), (2001, [0.5, 1.5])] + [(2100 + i, [float(i), 2.0 * i, 7.0]) for i in range(5)]
    found = collections.defaultdict(list)
    errors = set()
    for row in whitening.whiten(vector_table(spark, rows)).collect():
        found[(row.vec_id, row.component)].append((row.n, row.deviation, abs(row.whitened), row.explained))
        errors.add(row.identity_error)
    expected = plain_whitening(rows, 16) | plain_whitening(rows, 3)
    assert set(found) == set(expected) and len(errors) == 2 and max(errors) < 1e-9
    for key, values in expected.items():
        for got, wanted in zip(sorted(found[key]), sorted(values), strict=True):
            assert got[:2] == wanted[:2] and got[2:] == pytest.approx(wanted[2:], rel=1e-7, abs=1e-9), key


def test_whitening_of_few_or_large_vectors(spark):
    df = vector_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    wide = vector_table(spark, [(1, [3e9, 0.0]), (2, [-3e9, 0.0]), (3, [0.0, 1e5])])
    found = {(r.vec_id, r.component): r for r in whitening.whiten(wide).collect()}
    x = [[256 * int(np.float32(c)) for c in v] for v in ([3e9, 0], [-3e9, 0], [0, 1e5])]
    sums = [sum(column) for column in zip(*x)]
    deviations = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [found[(i, 1)].deviation for i in (1, 2, 3)] == [d if d < 1 << 63 else None for d in deviations]
    middle = spark.createDataFrame([(i, [1e4 * i, 0.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(middle).orderBy("vec_id").collect()] == [(3 * 256 * 10_000) ** 2, 0, (3 * 256 * 10_000) ** 2]

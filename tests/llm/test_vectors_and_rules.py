"""Whitening, quality rules and hard negatives against brute force, with nulls, ties, repeated rows and empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("cuetrace.llm")
from pyspark.sql import functions as F  # noqa: E402

from cuetrace.llm import negatives, quality_rules, queries, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, n int, x string"


def as_rows(frame):
    return frame.collect()


# whitening

def brute_covariance(vectors):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    return x, n, total, centred, centred.T @ centred / n


def check_whitening(found, vectors, ids, components):
    x, n, total, centred, v = brute_covariance(vectors)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert sorted(by_id) == sorted(ids) and {len(r) for r in by_id.values()} == {components}
    deviation = {i: int(sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, total))) for i, row in zip(ids, x)}
    white = np.array([[r["whitened"] for r in sorted(by_id[i], key=lambda r: r["component"])] for i in ids])
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in found)
    for k in range(components):
        own = next(r["explained"] for r in found if r["component"] == k + 1)
        assert own == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(components)).max() < 1e-8
    assert max(r["identity_error"] for r in found) < 1e-8
    # The components are eigenvectors: projections give back whitened values up to sign.
    recovered = np.linalg.lstsq(centred, white * np.sqrt(values[:components]), rcond=None)[0]
    assert np.abs(v @ recovered - recovered * values[:components]).max() < 1e-6 * values[0]
    assert np.linalg.norm(recovered, axis=0) == pytest.approx(np.ones(components), rel=1e-6)


def test_whitening_of_the_test_table(spark):
    found = queries.op11_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(found, [r["embedding"] for r in table], [r["vec_id"] for r in table], 32)


@pytest.mark.parametrize("kind", ["equal deviations", "low rank", "steep", "repeated"])
def test_whitening_of_hard_spectra(kind):
    random = np.random.default_rng(3)
    if kind == "equal deviations":
        rows = np.concatenate([np.eye(12) * 3, -np.eye(12) * 3])
    elif kind == "low rank":
        rows = random.normal(size=(60, 4)) @ random.normal(size=(4, 12))
    elif kind == "steep":
        rows = random.normal(size=(300, 12)) * 10.0 ** -np.linspace(0, 4, 12)
    else:
        rows = np.repeat(random.normal(size=(9, 12)), 20, axis=0)
    x = rows - rows.mean(axis=0)

    def product(p):
        return float(np.linalg.norm(x @ p)), x.T @ (x @ p)

    components, values = whitening.bidiagonalise(product, 12, 8)
    exact = np.linalg.svd(x, compute_uv=False)
    top = int((exact[:8] > 1e-6 * exact[0]).sum())
    assert values[:top] == pytest.approx(exact[:top], rel=1e-8)
    own = components[:, :top]
    assert np.abs(own.T @ own - np.eye(top)).max() < 1e-10
    assert np.abs(x.T @ (x @ own) - own * values[:top] ** 2).max() < 1e-8 * values[0] ** 2


def test_whitening_stops_early_where_few_dimensions_matter():
    random = np.random.default_rng(4)
    x = random.normal(size=(400, 5)) @ random.normal(size=(5, 300))
    calls = []

    def product(p):
        calls.append(1)
        return float(np.linalg.norm(x @ p)), x.T @ (x @ p)

    components, values = whitening.bidiagonalise(product, 300, 4)
    assert values[:4] == pytest.approx(np.linalg.svd(x, compute_uv=False)[:4], rel=1e-9) and len(calls) < 60


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, -1.0, 3.0], [2.0, 2.0, 2.0], [2.0, 2.0, 2.0], [-1.0, 0.0, 0.3]]
    rows = [(i, v, 1, 2, "y") for i, v in enumerate(good)]
    rows += [(None, good[0], 1, 2, "y"), (90, None, 1, 2, "y"), (91, [1.0, None, 1.0], 1, 2, "y"),
             (92, [nan, 1.0, 1.0], 1, 2, "y"), (93, [inf, 1.0, 1.0], 1, 2, "y"), (94, [1.0, 2.0], 1, 2, "y"),
             (95, [], 1, 2, "y")]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    white, model, n = whitening.whiten(frame)
    found = white.collect()
    assert n == 6 and sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found)[:5] == [(False, i) for i in range(5)]
    assert len(model.deviations) == 3 and {len(r["whitened"]) for r in found} == {3}
    x, _, total, _, _ = brute_covariance([*good, good[0]])
    expected = {i: sum((6 * int(a) - int(t)) ** 2 for a, t in zip(row, total)) for i, row in enumerate(x[:5])}
    assert {r["vec_id"]: int(r["deviation"]) for r in found if r["vec_id"] is not None} == expected
    for none in (frame.limit(0), frame.filter("vec_id >= 90"), frame.filter("vec_id in (2, 3)")):
        assert not whitening.whiten(none.filter("vec_id not in (94, 95)"))[0].collect()


def test_exact_squared_lengths_beyond_a_long():
    x, rest, n = np.array([[1 << 30, -5], [3, 7]]), np.array([11, -2]), 10 ** 9
    found = whitening.squared_length(x, n, rest).to_pylist()
    assert [int(d) for d in found] == [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in x]


# quality rules

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(documents, labels):
    worst = {}
    for doc_id, quality, toxic in labels:
        if None not in (doc_id, quality, toxic):
            q, t = worst.get(doc_id, (1, 0))
            worst[doc_id] = (min(q, quality), max(t, toxic))
    raw, target, grams_of = Counter(), Counter(), []
    for doc_id, text in documents:
        words = [w.lower() for w in SPLIT.findall(text or "")]
        grams = [xxhash.xxh64_intdigest(g.encode(), seed=42) % (1 << 20)
                 for g in words + [" " + w[:5] for w in words if len(w) >= 5]]
        grams_of.append(grams)
        raw.update(grams)
        if worst.get(doc_id) == (1, 0):
            target.update(grams)
    share = sum(target.values()) / sum(raw.values()) if raw else 0
    out = []
    for (doc_id, text), grams in zip(documents, grams_of):
        text = text or ""
        words = SPLIT.findall(text)
        windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
        filled = [line for line in text.split("\n") if SPLIT.search(line)]
        steps = sum(max(0, min(127, math.floor((-math.log((target[g] + 30) / (raw[g] * share + 30)) - 0.3) * 16)))
                    for g in grams)
        ratio = -steps / 16 / len(grams) if grams else 0.0
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                    len(filled) - len(set(filled)), len(covered), round(ratio, 9), failed,
                    not failed and ratio >= -0.015))
    return out


def found_rules(frame):
    return [(r["doc_id"], *(r[c] for c in quality_rules.RESULTS[:5]), round(r["target_ratio"], 9), r["base_failed"],
             r["kept"]) for r in frame.collect()]


def none_first(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_quality_rules(spark):
    random = np.random.default_rng(8)
    vocabulary = [f"Word{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(vocabulary[i] for i in random.integers(0, 300, n))

    line = "one two three four five six seven"
    documents = [(i, text(60) + ("\nnasty words" if i % 3 == 0 else "")) for i in range(240)]
    documents += [(300, None), (301, ""), (302, " \n\t\x0b"), (303, f"{line}\n{line}\n \n \n{line} "), (304, line), (305, text(20_000)),
                  (306, "a b c d e " * 3_000), (307, "x" * 200_000), (308, "# * & <b> | 100% $ " * 4), (309, "a a a a a"),
                  (309, "a a a a a a"), (None, text(30)), (None, text(30)), (310, text(12)), (310, documents[3][1])]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(200)] + [(5, 0, 0), (7, None, 1), (None, 1, 0), (9999, 1, 0)]
    frame = spark.createDataFrame([(d, t, "z", True) for d, t in documents],
                                  "doc_id long, text string, n_words string, quality boolean").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality_rules.judge(frame, known)
    assert set(found.columns) == {"doc_id", "text", "quality", *quality_rules.RESULTS}
    assert none_first(found_rules(found)) == none_first(brute_rules(documents, labels))
    nothing = quality_rules.judge(frame, known.limit(0))
    assert none_first(found_rules(nothing)) == none_first(brute_rules(documents, []))
    assert not quality_rules.judge(frame.limit(0), known).collect()


def test_quality_rules_on_the_test_table(spark):
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    found = queries.op12_quality_rules(spark, SF)
    assert none_first(found_rules(found)) == none_first(brute_rules(documents, labels))


def test_quality_rules_run_no_python(spark):
    plan = queries.op12_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Subquery")[0]


def test_quality_rules_find_toxic_documents(spark):
    """At the size of sf0.1 only the frequent toxic words can be told; at larger sizes all kinds."""
    folder = "/root/testdata/sf0.1"
    found = queries.op12_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    shares = found.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in shares}
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.35 and kept[1, 1] < 0.35


# hard negatives

def brute_negatives(rows):
    least = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (len(v), (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        least[vec_id] = min(least.get(vec_id, own), own)
    out = []
    for a, (_, label, x) in least.items():
        if a % 100:
            continue
        score = sorted(((-sum(p * q for p, q in zip(x, y)), c, other) for c, (_, other, y) in least.items()
                        if c != a and len(y) == len(x)))
        for most, p, _ in [s for s in score if s[2] == label][:5]:
            inside = [(c, s) for s, c, other in score if other != label and -80 * most <= -100 * s <= -100 * most]
            out += [(a, p, k + 1, c, -most, -s) for k, (c, s) in enumerate(inside[:5])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "scattered", "ties"])
@pytest.mark.parametrize("shard_rows", [70, 8192])
def test_negatives(spark, kind, shard_rows, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 4)
    random = np.random.default_rng(6)
    if kind == "clusters":
        rows = np.repeat(random.normal(size=(6, 8)), 40, axis=0) + random.normal(size=(240, 8)) * 0.05
    elif kind == "ties":
        rows = random.integers(0, 2, size=(240, 4)).astype(float)
    else:
        rows = random.normal(size=(240, 8))
    nan = float("nan")
    data = [(int(i) * 10, [float(x) for x in v], int(random.integers(0, 3))) for i, v in enumerate(rows)]
    data += [data[10], (100, [9.0] * len(rows[0]), 2), (5, None, 1), (6, [nan] * 8, 1), (7, [1.0, None], 1), (8, [1.0] * 8, None),
             (None, [1.0] * 8, 1), (200, [0.5, 0.5], 0), (900, [], 1), (901, [], 2), (11, [0.5, 0.4], 0), (12, [0.5, 0.2], 1)]
    frame = spark.createDataFrame([(i, v, label, 1, "y") for i, v, label in data], VECTORS).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(frame, moved, F.col("vec_id") % 100 == 0, shard_rows=shard_rows)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == brute_negatives(data)
    assert not negatives.hard_negatives(frame.limit(0), moved, F.col("vec_id") % 100 == 0).collect()
    assert not negatives.hard_negatives(frame, moved, F.lit(None).cast("boolean")).collect()


def test_bounds_spare_scores_in_clusters():
    random = np.random.default_rng(2)
    centres = random.normal(size=(8, 16)) * 2_000
    x = (np.repeat(centres, 100, axis=0) + random.normal(size=(800, 16)) * 20).astype(np.int64)
    shard = negatives.Shard(np.arange(800), np.arange(800) % 3, x)
    anchors = x[::25]
    order, parent, length = negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(32)) and (parent == -1).sum() == 1
    number = np.argsort(order)
    group = {"dim": 16, "ids": (order * 25).tolist(), "labels": (order * 25 % 3).tolist(), "x": anchors[order].tobytes(),
             "parents": [int(number[p]) if p >= 0 else -1 for p in parent[order]], "lengths": length[order].tolist()}
    shard.positives(group, 5)
    assert shard.scored < 0.35 * 32 * 800


def test_scores_that_do_not_fit_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e8, 1e8], 1), (1, [1e8, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="do not fit"):
        negatives.hard_negatives(frame, F.col("label"), F.col("vec_id") == 0).collect()


def test_quality_rules_count_without_functions_over_arrays(spark, monkeypatch):
    """The corpus is counted by compiled code alone, which takes rows of single words."""
    plans, store = {}, quality_rules.store
    monkeypatch.setattr(quality_rules, "store", lambda df, name: plans.update(
        {name: df._jdf.queryExecution().executedPlan().toString()}) or store(df, name))
    frame = spark.createDataFrame([(1, "ΟΔΟΣ ΟΔΟΣ, Σ\tABCDE İx\nΑΣ"), (2, None), (3, "abcde ς")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in quality_rules.ngram_counts(frame, labels).collect()}
    assert "lambda" not in plans["ngram-counts"]
    words = F.explode(quality_rules.words_of(F.coalesce("text", F.lit("")))).alias("w")
    single = frame.select("doc_id", words).select("doc_id", F.explode(F.array(
        *quality_rules.word_buckets(F.lower("w")))).alias("b")).filter("b is not null").collect()
    assert counts == {b: (sum(r["b"] == b for r in single), sum(r["b"] == b and r["doc_id"] == 1 for r in single))
                      for b in {r["b"] for r in single}}


def test_repeat_words_with_and_without_repeats(spark):
    texts = ["", "a b c d e", "a b c d e f", "a a a a a a", "a b c d e x a b c d e", "a b c d e a b c d e a", "A b c d e a b c d e"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        "i", quality_rules.words_of(F.col("text")).alias("w")).withColumn("h", quality_rules.window_hashes(F.col("w")))
    found = frame.select("i", F.size("h").alias("n"), quality_rules.repeat_words(F.col("w"), F.col("h")).alias("r")).collect()
    assert [(r["n"], r["r"]) for r in sorted(found)] == [(0, 0), (0, 0), (2, 0), (2, 6), (7, 10), (7, 11), (6, 0)]

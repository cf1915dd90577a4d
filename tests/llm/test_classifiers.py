import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from asklens.llm import learning, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def _right(spark, name, label):
    found = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = found.where("held_out").groupBy(label, "predicted").count().collect()
    counts = {(r[label], r["predicted"]): r["count"] for r in rows}
    return counts, (counts.get((1, 1), 0) + counts.get((0, 0), 0)) / sum(counts.values())


def test_toxicity_of_held_out_documents(spark):
    # About one label in five of the toxic ones is on a text without any toxic word here.
    counts, right = _right(spark, "op5_toxicity", "toxic")
    assert right > 0.95 and counts.get((0, 1), 0) <= 0.02 * (counts[0, 0] + counts.get((0, 1), 0))


def test_quality_of_held_out_documents(spark):
    assert _right(spark, "op8_quality", "quality")[1] > 0.98


def test_held_out_rows_are_never_learnt_from(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    ids = {r["id"] for r in learning.training_rows(docs, labels, "toxic", 1000).collect()}
    assert ids == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5}
    assert learning.training_rows(docs, labels, "toxic", 17).count() == 17


def test_contradicting_and_odd_labels_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 7), (3, 1), (3, 1), (None, 1)], "doc_id long, toxic int")
    found = {r["id"]: (r["text"], r["label"]) for r in learning.training_rows(docs, labels, "toxic", 10).collect()}
    assert found == ({3: ("", 1)} if zlib.crc32(b"3") % 5 else {})


def test_repeats_of_an_id_are_one_row(spark):
    docs = spark.range(400).select(F.when(F.col("id") < 300, 3).otherwise(F.col("id")).cast("long").alias("doc_id"),
                                   F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    found = learning.training_rows(docs, labels, "toxic", 1000).collect()
    want = {k for k in (3, *range(300, 400)) if zlib.crc32(str(k).encode()) % 5}
    assert 3 in want and sorted(r["id"] for r in found) == sorted(want)
    again = learning.training_rows(docs.repartition(7), labels, "toxic", 1000).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in found}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows_are_scored(spark, awkward, nothing, module):
    words = {1: "clear water under a green bridge in spring ", 0: "$$$ ### *** %%% buy!! now!! "}
    label = "toxic" if module is toxicity else "quality"
    docs = spark.createDataFrame([(k, words[k % 2] * (1 + k % 7)) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], f"doc_id long, {label} int")
    model = module.fit(docs, labels)
    scored = module.score(awkward, model)
    rows = scored.collect()
    assert len(rows) == 10 and scored.columns.count("score") == 1 and set(scored.columns) == set(awkward.columns)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(nothing, model).count() == 0
    again = {r["doc_id"]: r["score"] for r in module.score(docs, module.fit(docs, labels)).collect()}
    first = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert again == first and all((first[k] >= 0.5) == (k % 2 == 1) for k in first)
    none = module.fit(docs, labels.limit(0))
    assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}


def test_grams_of_long_texts(monkeypatch):
    text = "abc déf 😀 " * 50
    whole = set(toxicity.grams(text).tolist())
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert set(toxicity.grams(text).tolist()) == whole
    assert len(toxicity.grams(text)) == len(whole)


def test_quality_score_is_the_calibrated_size_difference(spark):
    import math

    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    slope, bias = model.weights
    assert slope > 0

    def size(raw: bytes, text: bytes) -> int:
        tool = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw))
        return sum(len(tool.compress(text[k:k + model.piece])) for k in range(0, len(text), model.piece))

    for r in quality.score(docs, model).collect():
        text = (r["text"] or "").encode()
        bad, good = size(model.bad, text), size(model.good, text)
        want = 1 / (1 + math.exp(-(slope * (bad - good) / max(1, bad, good) + bias)))
        assert abs(r["score"] - want) < 1e-9


def _hashed(text, sizes=toxicity.SIZES, bits=toxicity.BITS):
    """Distinct n-grams one after the other, in plain integers."""
    whole, found = f" {text.lower()} ", set()
    for n in sizes:
        for k in range(len(whole) - n + 1):
            mixed = n
            for c in whole[k:k + n]:
                mixed = (mixed * 0x01000193 + ord(c) * 0x9E3779B1) % 2**32
            mixed ^= mixed >> 15
            found.add(mixed * 0x85EBCA6B % 2**32 >> 32 - bits)
    return found


def _sample(spark, label, n):
    """(docs, labels, training rows by id): documents of the given table in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(docs.select("doc_id"), "doc_id").select("doc_id", label)
    labels = spark.createDataFrame(labels.orderBy(F.xxhash64("doc_id")).limit(n).collect(), labels.schema)
    ids = {r["doc_id"]: r[label] for r in labels.collect()}
    held = {r["doc_id"]: r["text"] or "" for r in docs.join(F.broadcast(labels.select("doc_id")), "doc_id").collect()}
    train = {k: (held[k], y) for k, y in ids.items() if zlib.crc32(str(k).encode()) % 5}
    return docs.join(F.broadcast(labels.select("doc_id")), "doc_id"), labels, held, train


def test_toxicity_against_a_plain_version(spark):
    docs, labels, held, train = _sample(spark, "toxic", 400)
    model = toxicity.fit(docs, labels, rounds=40)
    own = {k: _hashed(text) for k, (text, _) in train.items()}
    positive = {k for k, (_, y) in train.items() if y}
    n, toxic = len(train), len(positive)
    assert 0 < toxic < n
    counts = {}
    for k, slots in own.items():
        for slot in slots:
            p, q = counts.get(slot, (0, 0))
            counts[slot] = (p + (k in positive), q + (k not in positive))
    ratios = {}
    for slot, (p, q) in counts.items():
        plain = math.log((p + 0.5) / (toxic + 1)) - math.log((q + 0.5) / (n - toxic + 1))
        error = math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        if p + q >= toxicity.LEAST_DOCS and abs(plain) > toxicity.SURE * error:
            a, b = toxicity.SMOOTHING * toxic / n, toxicity.SMOOTHING * (n - toxic) / n
            ratios[slot] = math.log((p + a) / (toxic + toxicity.SMOOTHING)) - math.log((q + b) / (n - toxic + toxicity.SMOOTHING))
    assert len(ratios) < toxicity.MOST_FEATURES and set(model.features.tolist()) == set(ratios)

    # The same logistic steps on a dense table of scaled features.
    slots = sorted(ratios)
    x = np.array([[ratios[s] if s in own[k] else 0.0 for s in slots] for k in train])
    y = np.array([train[k][1] for k in train], float)
    w, m, v = (np.zeros(len(slots) + 1) for _ in range(3))
    x = np.column_stack([x, np.ones(n)])
    for t in range(1, 41):
        gap = 1 / (1 + np.exp(-(x @ w))) - y
        g = x.T @ gap / n + np.append(np.full(len(slots), 1e-6), 0) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= (0.05 if t <= 20 else 0.01) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weight = {s: w[i] * ratios[s] for i, s in enumerate(slots)}
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(held)
    for row in scored:
        z = w[-1] + sum(weight.get(s, 0.0) for s in _hashed(held[row["doc_id"]]))
        assert abs(row["score"] - 1 / (1 + math.exp(-z))) < 1e-3, row["doc_id"]


def test_quality_against_a_plain_version(spark):
    docs, labels, held, train = _sample(spark, "quality", 400)
    model = quality.fit(docs, labels)

    def difference(text):
        data, sizes = text.encode(), []
        for raw in (model.bad, model.good):
            one = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
            sizes.append(sum(len(one.compress(data[k:k + quality.PIECE])) for k in range(0, len(data), quality.PIECE)))
        return (sizes[0] - sizes[1]) / max(1, *sizes)

    # Dictionaries see one part of the sample, the calibration the other.
    first = {k for k in train if zlib.crc32(str(k).encode()) % 5 <= 2}
    for y, raw in ((1, model.good), (0, model.bad)):
        cuts = [train[k][0].encode()[i:i + quality.PIECE] for k in first if train[k][1] == y
                for i in range(0, len(train[k][0].encode()), quality.PIECE)]
        assert len(cuts) <= quality.MOST_PIECES
        hashes = {r["p"]: r["h"] for r in spark.createDataFrame([(bytearray(c),) for c in cuts], "p binary").select(
            "p", F.xxhash64("p").alias("h")).collect()}
        ordered = sorted(cuts, key=lambda c: (hashes[c], c))
        assert raw == zstandard.train_dictionary(
            min(quality.DICTIONARY, sum(map(len, cuts)) // 8), ordered, level=quality.LEVEL).as_bytes()
    points = [(difference(text), y) for k, (text, y) in train.items() if k not in first]
    slope = bias = 0.0
    for _ in range(100):  # Newton steps on two numbers, with the same small ridge
        a = b = h = i = j = 0.0
        for d, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * d + bias))))
            a, b, c = a + d * (p - y), b + p - y, p * (1 - p) + 1e-9
            h, i, j = h + d * d * c, i + d * c, j + c
        a, b, h, j = a + 1e-3 * slope, b + 1e-3 * bias, h + 1e-3, j + 1e-3
        det = h * j - i * i
        slope, bias = slope - (j * a - i * b) / det, bias - (h * b - i * a) / det
    for row in quality.score(docs, model).collect():
        z = max(-500.0, min(500.0, slope * difference(held[row["doc_id"]]) + bias))
        assert abs(row["score"] - 1 / (1 + math.exp(-z))) < 1e-6, row["doc_id"]

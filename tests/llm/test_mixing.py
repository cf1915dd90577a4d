import re

import numpy as np
from pyspark.sql import functions as F

from asklens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_targets(sizes, weights, total):
    """Water filling by bisection, another way than the operator's."""
    low, high = 0.0, 4.0 * (sum(sizes) + 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(2 * s, low * w) for s, w in zip(sizes, weights, strict=True)]


def _check(df, **limits):
    rows = mixing.mix(df, **limits).collect()
    docs = df.collect()
    assert sorted((r["doc"], r["size"]) for r in rows if r["doc"] is not None) == sorted(
        (d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in docs if d["doc_id"] is not None)
    assert len(rows) == len(docs)
    names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(d["text"] or "")) for d in docs if d["source"] == n) for n in names]
    want = _plain_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes))
    for name, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in rows if r["source"] == name]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) for r in own)
        assert sum(r["taken"] for r in own) == round(own[0]["target"])
    for r in rows:
        assert r["taken"] == sum(p["stop"] - p["start"] for p in r["pieces"]) <= 2 * r["size"]
        for epoch in (0, 1):
            words = [w for p in r["pieces"] if p["epoch"] == epoch for w in range(p["start"], p["stop"])]
            assert len(words) == len(set(words)) and all(0 <= w < r["size"] for w in words)
    return rows


def test_documents(documents):
    first = _check(documents, block=100, shards=5)
    again = mixing.mix(documents.repartition(3), block=100, shards=5).collect()
    key = lambda r: (r["doc"], str(r["pieces"]))
    assert sorted(first, key=key) == sorted(again, key=key)


def test_awkward_rows(awkward, nothing):
    _check(awkward.where("doc_id IS NULL OR doc_id <> 6"), block=3, shards=2)
    _check(awkward, block=1000, shards=3)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_shards_hold_the_trees_counts(documents):
    rows = mixing.mix(documents, block=50, shards=6).select("source", F.explode("pieces").alias("p")).select("source", "p.*")
    ranks = rows.select("source", "shard", "epoch", "rank").distinct().groupBy("shard").count().collect()
    sizes = [r["count"] for r in ranks]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 2


def test_every_shard_draws_its_own_quota_of_each_source(documents):
    block, shards = 50, 6
    rows = mixing.mix(documents, block=block, shards=shards).withColumn("shard_words", mixing.words_by_shard("pieces")).collect()
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    first = {n: next(r for r in rows if r["source"] == n) for n in names}
    quotas = [mixing.quota(k, first[n]["source_size"], first[n]["target"], 1, block) for k, n in enumerate(names)]
    tree = mixing.splitting_tree(np.array([q.places for q in quotas]), shards, 1)
    words = {}
    for k, n in enumerate(names):
        own = [(r, p) for r in rows if r["source"] == n for p in r["pieces"]]
        # A place is one rank of one shard; each shard has as many of a source as the tree says, no two share any.
        places = {(p["shard"], p["rank"]) for _, p in own}
        assert [sum(s == shard for s, _ in places) for shard in range(shards)] == tree[:, k].tolist()
        assert len({rank for _, rank in places}) == len(places) == quotas[k].places
        for _, p in own:
            words[p["shard"]] = words.get(p["shard"], 0) + p["stop"] - p["start"]
    listed = {}
    for r in rows:
        parts = [tuple(map(int, x.split(":"))) for x in r["shard_words"].split(",") if x]
        assert sum(w for _, w in parts) == r["taken"] and [s for s, _ in parts] == sorted({p["shard"] for p in r["pieces"]})
        for s, w in parts:
            listed[s] = listed.get(s, 0) + w
    assert listed == words


def test_quotas_meet_their_words():
    rng = np.random.default_rng(0)
    for _ in range(400):
        size, block = int(rng.integers(1, 4000)), int(rng.integers(1, 600))
        q = mixing.quota(2, size, float(rng.uniform(0, 2 * size)), 1, block)
        words = 0
        for epoch in (0, 1):
            place = epoch * q.blocks + mixing.permuted(np.arange(q.blocks), q.blocks, mixing.epoch_key(1, 2, epoch))
            full = np.minimum(size, (np.arange(q.blocks) + 1) * block) - np.arange(q.blocks) * block
            words += int(np.where(place == q.places - 1, q.cut, np.where(place < q.places, full, 0)).sum())
        assert words == round(q.target)


def test_tree_is_a_partition_and_portions_agree():
    counts = np.array([1000, 10, 0, 345])
    out = mixing.splitting_tree(counts, 7, 3)
    assert (out.sum(axis=0) == counts).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 2
    draw = mixing._drawn(np.random.default_rng(1), counts, 700, most=100)
    assert draw.sum() == 700 and (draw <= counts).all() and (draw >= 0).all()


def test_mixed_documents_carry_the_words_taken(awkward, documents):
    for df in (awkward, documents):
        options = {"block": 50, "shards": 4}
        taken = mixing.mix(df, **options).agg(F.sum("taken")).first()[0]
        mixed = mixing.mixed_documents(df, **options)
        rows = mixed.collect()
        assert mixed.columns == df.columns
        assert sum(len(WORD.findall(r["text"])) for r in rows) == taken
        assert all(r["n_chars"] == len(r["text"]) for r in rows)

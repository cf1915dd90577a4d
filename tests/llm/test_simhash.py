import re

import numpy as np
import xxhash

from asklens.llm import simhash
from asklens.llm.components import components


def _plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(marks):
    """Brute force: (id, fingerprint) pairs to smallest reachable id."""
    label = list(range(len(marks)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(marks):
        if doc is not None:
            least[root(k)] = min(least.get(root(k), doc), doc)
    return [least.get(root(k)) for k in range(len(marks))]


def _check(df):
    rows = [(r["doc_id"], _plain_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    want = sorted(((d, f, c) for (d, f), c in zip(rows, _classes(rows), strict=True)), key=str)
    found = simhash.near_duplicates(df).collect()
    assert sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found), key=str) == want


def test_documents_against_brute_force(documents):
    _check(documents)


def test_awkward_rows(awkward, nothing):
    _check(awkward)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(awkward).collect()
    assert sorted((r["doc_id"] for r in kept)) == [1, 3, 6, 7]
    assert set(kept[0].asDict()) == set(awkward.columns)
    assert simhash.keep_first(nothing).count() == 0


def test_rows_without_any_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "quite another text here")], "doc_id long, text string")
    assert simhash.keep_first(df).count() == 2


def test_long_texts_are_hashed_whole():
    text = " ".join(f"w{k}" for k in range(200_000))
    assert simhash.fingerprint(text.encode()) == _plain_fingerprint(text)


def _links(spark, values, monkeypatch, **limits):
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    df = spark.createDataFrame([(int(v),) for v in values.astype(np.uint64).view(np.int64)], "fp long")
    found = simhash.near_pairs(df, shard_size=limits.get("SHARD_SIZE", simhash.SHARD_SIZE)).collect()
    index = {int(v): k for k, v in enumerate(values)}
    links = simhash._Links(len(values))
    pairs = [(index[r["a"] & (1 << 64) - 1], index[r["b"] & (1 << 64) - 1]) for r in found]
    links.add(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    got = simhash._smallest(*links.reduce(), len(values))
    plain = simhash._Links(len(values))
    simhash._plain(values, np.arange(len(values)), np.arange(len(values)), True, 2, plain)
    assert (got == simhash._smallest(*plain.reduce(), len(values))).all()


def test_shards_blocks_and_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    far = rng.integers(0, 2 ** 63, 1500, dtype=np.uint64)
    chain = [np.uint64(77)]
    for k in range(60):  # each link two bits from the one before
        chain.append(chain[-1] ^ np.uint64(0b11 << (k % 62)))
    ball = np.uint64(99 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) \
        ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    near = far[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    values = np.unique(np.concatenate([far, near, np.array(chain, np.uint64), ball]))
    _links(spark, values, monkeypatch, SHARD_SIZE=64, BLOCK=50, _PLAIN=16)
    _links(spark, values, monkeypatch, SHARD_SIZE=10 ** 9, BLOCK=10 ** 9, _PLAIN=32)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (None, 3)] + [(1, 0)] * 5
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[k] for k in range(101)}) == 1 and len({found[1000 + k] for k in range(300)}) == 1
    assert found[0] != found[1000] and 5000 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

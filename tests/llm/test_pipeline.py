import numpy as np

import corpus_pipeline
from asklens.llm import decontaminate, simhash, toxicity, training_order

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        results[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = results[name][1]
        if name != "training_order":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}

    before, after = results["toxicity"]
    model = toxicity.fit(before.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
    assert {r["doc_id"] for r in after.collect()} == clean and 0.7 * before.count() < len(clean) < before.count()

    before, after = results["near_dedup"]
    marks = sorted((r["doc_id"], simhash.fingerprint(r["text"].encode())) for r in before.collect())
    prints = np.array([f for _, f in marks], np.uint64)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = np.arange(len(marks))
    while True:
        low = np.where(close, label[None, :], len(marks)).min(axis=1)
        if (low == label).all():
            break
        label = low
    assert sorted(r["doc_id"] for r in after.collect()) == [marks[k][0] for k in np.unique(label)]

    before, after = results["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = set()
    for r in bench.collect():
        w = [x.decode() for part in decontaminate.words(r["text"].encode()) for x in part]
        windows |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))}
    kept = set()
    for r in before.collect():
        w = [x.decode() for part in decontaminate.words(r["text"].encode()) for x in part]
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == kept

    before, after = results["mixing"]
    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in before.collect()}
    words: dict[int, int] = {}
    for r in after.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert all(n <= 2 * sizes[d] for d, n in words.items())
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= 20

    before, after = results["training_order"]
    rows = after.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    vocabulary = training_order.Vocabulary.read()
    encoder, ends, tokens = vocabulary.encoder(), 0, 0
    for r in rows:
        own = np.frombuffer(r["tokens"], "<u2")[:r["n_tokens"]]
        ends, tokens = ends + int((own == vocabulary.end).sum()), tokens + len(own)
    texts = [r["text"] for r in before.collect()]
    assert ends == len(texts) and tokens == ends + sum(len(encoder.encode_ordinary(t)) for t in texts)

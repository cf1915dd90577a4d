import numpy as np

from asklens.llm import decontaminate
from asklens.llm.fmindex import FMIndex

ITEM = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from the warm red roof"


def test_index_against_a_plain_search():
    rng = np.random.default_rng(3)
    for size, letters in ((1, 3), (40, 2), (500, 3), (3000, 6)):
        text = rng.integers(0, letters + 1, size)
        index = FMIndex(text)
        for width in (1, 2, 5):
            patterns = rng.integers(1, letters + 3, (60, width))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [k for k in range(size - width + 1) if (text[k:k + width] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_index_of_one_repeated_symbol():
    index = FMIndex(np.ones(5000, int))
    low, high = index.search(np.ones((1, 13), int))
    assert sorted(index.locate(np.arange(low[0], high[0]))) == list(range(5000 - 12))


def _found(spark, texts, items, **limits):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, contamination string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    return {r["doc_id"]: r["contamination"] for r in decontaminate.find_passages(docs, bench, **limits).collect()}


def test_hits_items_and_packs(spark):
    words = ITEM.split()
    texts = [ITEM.upper() + "!", " ".join(["filler"] * 30 + words[2:16]), " ".join(words[:12]), None, "", "two words", "a two-words b",
             " ".join(words[:13]) + " x " + " ".join(words[3:])]
    items = [("b", ITEM), ("a", ITEM + " and more"), ("c", "two words"), (None, ITEM), ("d", None), ("e", ""), ("b", ITEM)]
    for pack in (10 ** 6, 10):
        found = _found(spark, texts, items, pack_words=pack)
        assert (found[0]["n_words"], found[0]["n_hit"], found[0]["items"]) == (19, 19, ["a", "b"])
        assert (found[1]["n_hit"], [tuple(h) for h in found[1]["hits"]]) == (14, [(30, 44)])
        assert found[2]["n_hit"] == 0 and found[3]["n_words"] == 0 and found[4]["items"] == []
        assert found[5]["items"] == ["c"] and found[6]["n_hit"] == 2
        assert [tuple(h) for h in found[7]["hits"]] == [(0, 13), (14, 30)]


def test_no_hit_across_documents_or_shards(spark, monkeypatch):
    words = ITEM.split()
    texts = [" ".join(words[:7]), " ".join(words[7:]), ITEM, ITEM]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 5)
    found = _found(spark, texts, [("a", ITEM)])
    assert [found[k]["n_hit"] for k in range(4)] == [0, 0, 19, 19]


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(0, "Über: " + ITEM + ". Ende", "k"), (1, None, "k")], "doc_id long, text string, text_cut string")
    bench = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    cut = {r["doc_id"]: r["text_cut"] for r in decontaminate.cut_passages(decontaminate.find_passages(docs, bench)).collect()}
    assert cut == {0: "Über: . Ende", 1: None}


def test_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([("a", "one two three four five six")], "item_id string, text string")
    found = decontaminate.find_passages(awkward, bench)
    assert found.count() == 10 and found.where("contamination.n_hit = 6").count() == 4
    assert found.where(decontaminate.contaminated()).count() == 4
    assert decontaminate.find_passages(nothing, bench).count() == 0
    assert decontaminate.find_passages(awkward, bench.limit(0)).where("contamination.n_hit > 0").count() == 0


def test_packs_are_bounded_in_any_script_and_for_a_hot_item(spark, monkeypatch):
    plain, packs, live = decontaminate.Phrases, [], []

    class Counted(plain):
        def __init__(self, items, window):
            packs.append(sum(len(part) for _, t in items for part in decontaminate.words(t.encode())))
            super().__init__(items, window)

    class Sent(decontaminate.Shipped):
        def __init__(self, spark, value):
            live.append(1)
            assert sum(live) == 1  # the pack before is released
            super().__init__(spark, value)

        def unpersist(self):
            live.append(-1)
            super().unpersist()

    monkeypatch.setattr(decontaminate, "Phrases", Counted)
    monkeypatch.setattr(decontaminate, "Shipped", Sent)
    for letter in "яa":
        packs.clear()
        live.clear()
        items = [("hot" if k % 3 else f"i{k}", " ".join(f"{letter * (1 + j)}{k}" for j in range(14))) for k in range(60)]
        texts = [items[7][1], "x " + items[9][1] + " x " + items[10][1], "nothing", None, items[7][1]]
        found = _found(spark, texts, items, pack_words=140)
        assert len(packs) >= 6 and max(packs) <= 3 * 140 and sum(packs) == 60 * 14
        assert [found[k]["n_hit"] for k in range(5)] == [14, 28, 0, 0, 14]
        assert found[1]["items"] == ["hot", "i9"] and found[1]["n_words"] == 30 and found[0]["items"] == ["hot"]

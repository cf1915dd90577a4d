import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from asklens.llm import training_order as t
from asklens.llm.feistel import permuted


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in ("a", "b"):
            out = permuted(np.arange(n), n, key)
            assert sorted(out) == list(range(n)) and (permuted(out, n, key, back=True) == np.arange(n)).all()
    assert (permuted(np.arange(1000), 1000, "a") != permuted(np.arange(1000), 1000, "b")).any()


@pytest.fixture(scope="module")
def vocabulary():
    return t.Vocabulary.read()


def _texts(rows, vocabulary, length):
    """Documents back from sequences in their original order."""
    encoder = vocabulary.encoder()
    tokens = np.concatenate([np.frombuffer(r["tokens"], "<u2")[:r["n_tokens"]] for r in rows]) if rows else np.zeros(0, int)
    ends = np.flatnonzero(tokens == vocabulary.end)
    return [encoder.decode(tokens[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)] if len(ends) else []


@pytest.mark.parametrize("length", [16, 2048])
def test_round_trip(spark, awkward, documents, vocabulary, length):
    for docs in (awkward, documents):
        staged = t.stage_sequences(docs, vocabulary, length)
        rows = sorted(staged.collect(), key=lambda r: (r["part"], r["row"]))
        assert all(len(r["tokens"]) == 2 * length for r in rows)
        assert sorted(_texts(rows, vocabulary, length)) == sorted(r["text"] or "" for r in docs.select("text").collect())
        ordered = t.training_order(staged, 2, length, "k", shard_sequences=7).collect()
        assert sorted(r["slot"] for r in ordered) == list(range(len(rows)))
        slots = permuted(np.arange(len(rows)), len(rows), "k")
        by = {r["slot"]: r for r in ordered}
        for number, row in enumerate(rows):
            r = by[slots[number]]
            assert (r["tokens"], r["doc_ids"], r["n_tokens"]) == (row["tokens"], row["doc_ids"], row["n_tokens"])
            assert (r["shard"], r["position"], r["byte_offset"]) == (r["slot"] // 7, r["slot"] % 7, r["slot"] % 7 * 2 * length)


def test_documents_of_a_sequence(spark, vocabulary):
    docs = spark.createDataFrame([(k, "word " * (k % 5)) for k in range(30)], "doc_id long, text string").coalesce(1)
    rows = sorted(t.stage_sequences(docs, vocabulary, 8).collect(), key=lambda r: r["row"])
    encoder = vocabulary.encoder()
    owner = [d for r in docs.collect() for d in [r["doc_id"]] * (1 + len(encoder.encode_ordinary(r["text"])))]
    for k, r in enumerate(rows):
        assert r["doc_ids"] == sorted(set(owner[8 * k:8 * k + 8]))


def test_no_documents(spark, nothing, vocabulary):
    assert t.materialise(nothing, vocabulary).count() == 0


def test_shards_are_written_once_and_read_from_any_slot(spark, documents, vocabulary, tmp_path):
    ordered = t.materialise(documents, vocabulary, length=64, key="x", shard_sequences=50)
    folder = str(tmp_path / "shards")
    first = sorted(t.write_shards(ordered, folder).collect())
    total = ordered.count()
    assert [r["sequences"] for r in first][:-1] == [50] * (len(first) - 1) and sum(r["sequences"] for r in first) == total
    assert all(r["written"] for r in first)
    # One shard is lost and one cut short: only these are written again, with the same bytes.
    (tmp_path / "shards" / "shard-00000001.bin").unlink()
    (tmp_path / "shards" / "shard-00000002.bin").write_bytes(b"half")
    again = sorted(t.write_shards(ordered, folder).collect())
    assert [r["shard"] for r in again if r["written"]] == [1, 2]
    assert [r["sha256"] for r in again] == [r["sha256"] for r in first]
    want = {r["slot"]: r["tokens"] for r in ordered.collect()}
    got = [x.tobytes() for x in t.read_slots(folder, 73, 10 ** 9, 2, 64, 50)]
    assert got == [want[k] for k in range(73, total)]


def test_shards_of_another_key_or_of_fewer_documents_are_replaced(spark, documents, vocabulary, tmp_path):
    folder = str(tmp_path / "shards")
    staged = t.stage_sequences(documents, vocabulary, 64)
    fewer = t.stage_sequences(documents.where("doc_id % 3 = 0"), vocabulary, 64)
    for source, key in ((staged, "x"), (staged, "y"), (fewer, "y")):
        ordered = t.training_order(source, 2, 64, key, 50)
        found = t.write_shards(ordered, folder).collect()
        want = [r["tokens"] for r in ordered.orderBy("slot").collect()]
        assert [x.tobytes() for x in t.read_slots(folder, 0, 10 ** 9, 2, 64, 50)] == want
        for r in found:
            with open(t.shard_file(folder, r["shard"]), "rb") as file:
                assert r["written"] and hashlib.sha256(file.read()).hexdigest() == r["sha256"]
    assert not any(r["written"] for r in t.write_shards(ordered, folder).collect())


def test_reading_fails_where_a_shard_is_missing(spark, documents, vocabulary, tmp_path):
    folder = str(tmp_path / "shards")
    t.write_shards(t.materialise(documents, vocabulary, 64, shard_sequences=50), folder).collect()
    (tmp_path / "shards" / "shard-00000001.bin").unlink()
    with pytest.raises(FileNotFoundError):
        list(t.read_slots(folder, 0, 10 ** 9, 2, 64, 50))


@pytest.mark.parametrize("name", ["op6_training_order", "pipeline"])
def test_queries_write_their_shards(spark, vocabulary, name):
    import __spark_entry__

    found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    folder = found.schema["byte_offset"].metadata["folder"]
    want = [r["tokens"] for r in found.orderBy("slot").collect()]
    assert want and [x.tobytes() for x in t.read_slots(folder, 0, 10 ** 9, 2)] == want


def test_a_broken_off_write_leaves_no_manifest_and_can_be_resumed(spark, documents, vocabulary, tmp_path):
    folder = str(tmp_path / "shards")
    staged = t.stage_sequences(documents, vocabulary, 64)
    ordered = t.training_order(staged, 2, 64, "x", 50)
    whole = t.write_shards(ordered, folder).count()
    broken = ordered.withColumn("tokens", F.expr("if(slot = 777, cast(raise_error('lost') AS binary), tokens)"))
    with pytest.raises(Exception, match="lost"):
        t.write_shards(broken, folder)
    assert not (tmp_path / "shards" / "manifest.json").exists()
    with pytest.raises(FileNotFoundError):
        list(t.read_slots(folder, 0, 10, 2, 64, 50))
    assert not [f for f in (tmp_path / "shards").iterdir() if f.suffix != ".bin"]
    found = t.write_shards(ordered, folder).collect()
    assert len(found) == whole and not any(r["written"] for r in found)
    assert len(list(t.read_slots(folder, 0, 10 ** 9, 2, 64, 50))) == staged.count()


def test_looking_at_a_few_rows_finds_all_shards_written(spark, documents, vocabulary):
    found = t.materialise(documents, vocabulary, 64, shard_sequences=50)
    folder = found.schema["byte_offset"].metadata["folder"]
    assert found.limit(3).count() == 3
    assert len(list(t.read_slots(folder, 0, 10 ** 9, 2, 64, 50))) == found.count()


def test_stores_that_tasks_cannot_open_are_refused():
    with pytest.raises(Exception, match="odd"):
        t._opened("odd://other/shards")


@pytest.mark.parametrize("n", [0, 1, 40])
def test_packed_sequences(spark, vocabulary, n):
    docs = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(n)], "doc_id long, text string")
    packing = t.Packing.of(docs, vocabulary, 16, "text")
    plain = t.stage_sequences(docs, vocabulary, 16).collect()
    packed = t.stage_sequences(docs, vocabulary, 16, packing=packing).collect()
    unpack = packing.unpacker()
    key = lambda r: (r["part"], r["row"])
    assert [r["tokens"] for r in sorted(plain, key=key)] == [unpack(r["packed"]) for r in sorted(packed, key=key)]

import json
import random

from pyspark.sql import functions as F

from asklens.sources import examples as src
from asklens.sources import json_ranges
from asklens.sources.json_ranges import json_entries


def test_entries_by_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(5)
    bits = ["a", "\\", '"', ",", "[", "]", "{", "}", "é😀", "\\\\", " ", "\n"]

    def text():
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))

    def value(deep=0):
        kind = rng.randint(0, 5 if deep < 3 else 2)
        if kind <= 2:
            return [text(), rng.randint(-9, 9), None][kind]
        return [value(deep + 1) for _ in range(rng.randint(0, 3))] if kind == 3 else {text(): value(deep + 1) for _ in range(rng.randint(0, 3))}

    want = {}
    for k in range(8):
        rows = [value() for _ in range(rng.randint(0, 12))]
        name = f"f{k}.json"
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=k % 2 == 0, indent=k % 3 or None))
        want[name] = rows
    (tmp_path / "one.json").write_text(' {"a": [1, 2]}')
    (tmp_path / "open.json").write_text('[{"a": 1}, {"b": "x}]')
    (tmp_path / "none.json").write_text("")
    (tmp_path / "blank.json").write_text("  ")
    for size in (3, 17, 100_000):
        rows = json_entries(spark, str(tmp_path), size).orderBy("file", "pos").collect()
        got = {name: [json.loads(r.value) for r in rows if r.file.endswith("/" + name)] for name in want}
        assert got == want
        others = [(r.value, r.listed) for r in rows if r.file.rsplit("/", 1)[1] not in want]
        assert others == [(' {"a": [1, 2]}', False)]


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"example_id": k, "question": f"q{k} " + "x" * (k % 300), "sql": f"s{k}", "db_id": "d"} for k in range(60_000)]
    path = str(tmp_path / "big.json")
    (tmp_path / "big.json").write_text(json.dumps(rows))
    whole, _ = src.read_examples(spark, path)
    split, bad = src.read_examples(spark, path, split_bytes=1 << 20)
    assert bad.count() == 0 and split.count() == 60_000 and split.exceptAll(whole).count() == 0
    assert split.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    first, _ = src.read_examples(spark, path, limit=5, split_bytes=1 << 20)
    assert sorted(r.example_id for r in first.collect()) == [0, 1, 2, 3, 4]


def test_folders_of_mixed_files_by_ranges(spark, tmp_path):
    one, two = {"question": "q1", "query": "s1", "db_id": "d"}, {"question": "q2", "SQL": "s2", "example_id": 4}
    for name, content in (("a.json", [one, two]), ("b.json", {"data": [two]}), ("c.json", {"examples": [one]}), ("d.json", one),
                          ("e.json", {"table_names_original": ["t"]}), ("f.json", [])):
        (tmp_path / name).write_text(json.dumps(content))
    whole = src.read_example_dir(spark, str(tmp_path))
    split = src.read_example_dir(spark, str(tmp_path), split_bytes=16)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 5


def test_marks_by_arrays_as_by_steps():
    """Any bytes, in any state: what arrays find is what a walk mark by mark finds."""
    rng = random.Random(7)
    bits = [b"a", b"\\", b'"', b",", b"[", b"]", b"{", b"}", b"\0", b"\\\\", b'\\"', b"\n", b'"x":"y",']
    fast = 0
    for _ in range(20_000):
        data = b"".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        fast += all(json_ranges.ends(data))
        for state, end in enumerate(json_ranges.ends(data)):
            depth = rng.randint(0, 2)
            want = json_ranges._walk(data, state, depth)
            assert json_ranges.scan(data, state, depth) == want, (data, state, depth)
            assert end is None or (end[0], depth + end[1]) == want[:2], (data, state)
    assert fast > 1000


def test_documents_are_bounded_files(spark, tmp_path, monkeypatch):
    """A file is a document of many rows, however many rows there are; none is lost."""
    from asklens.plans import staging

    rows = spark.range(0, 20_000, 1, 4).select("id", F.lit('a "b" \\').alias("t"))
    staging.documents(rows, F.struct("id", "t"), str(tmp_path / "one"), '{"data": %s}')
    files = sorted((tmp_path / "one").rglob("part-*.txt"))
    assert len(files) == 4 and sum(len(json.loads(f.read_text())["data"]) for f in files) == 20_000
    monkeypatch.setattr(staging, "DOCUMENT_CHARS", 1000)
    staging.documents(rows, F.struct("id", "t"), str(tmp_path / "many"))
    files = sorted((tmp_path / "many").rglob("part-*.txt"))
    lists = [json.loads(f.read_text()) for f in files]
    assert len(files) > 100 and max(len(f.read_text()) for f in files) < 1200
    assert sorted(e["id"] for one in lists for e in one) == list(range(20_000))

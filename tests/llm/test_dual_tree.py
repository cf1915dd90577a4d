import hashlib

import numpy as np
import pytest

from asklens.llm import dual_tree as d

COLUMNS = "vec_id long, embedding array<float>, label int, code string, id long"


def _nearest(points, books):
    apart = ((points[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1)
    code = apart.argmin(2)
    counts, sums = np.zeros(books.shape[:2], int), np.zeros_like(books)
    for p in range(len(points)):
        np.add.at(counts[p], code[p], 1)
        np.add.at(sums[p], code[p], points[p])
    return counts, sums, code


@pytest.mark.parametrize("spread", [2, 4000])  # many ties, hardly any
@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_walk_of_both_trees_against_all_distances(k, spread):
    draw = np.random.default_rng(k)
    for n in (1, 2, 5, 16, 17, 33, 100, 1000, 4097):
        points, books = draw.integers(-spread, spread, (8, n, 4)), draw.integers(-spread, spread, (8, k, 4))
        points = np.take_along_axis(points, d.tree_order(points)[:, :, None], axis=1)
        found = d.assign(points, d.tree_levels(points), d.Entries.over(books), codes=True)
        for a, b in zip(found, _nearest(points, books), strict=True):
            assert (a == b).all()


def test_near_parts_are_assigned_by_whole_nodes(monkeypatch):
    draw = np.random.default_rng(1)
    centres = draw.integers(-4000, 4000, (8, 16, 8))
    points = np.take_along_axis(centres, draw.integers(0, 16, (8, 4096))[:, :, None], axis=1) + draw.integers(-9, 9, (8, 4096, 8))
    points = np.take_along_axis(points, d.tree_order(points)[:, :, None], axis=1)
    compared = []
    kept = d._leaves
    monkeypatch.setattr(d, "_leaves", lambda *a: (compared.append(len(a[2])), kept(*a)))
    d.assign(points, d.tree_levels(points), d.Entries.over(centres))
    assert sum(compared) < 0.05 * 8 * 4096 / d.LEAF * 16


def _brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    sizes = sorted({len(v) for _, v, _ in kept}, key=lambda s: (-sum(len(v) == s for _, v, _ in kept), -s))
    kept = [r for r in kept if len(r[1]) == sizes[0]]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    cut = lambda v: np.array(v).reshape(len(v), parts, -1).transpose(1, 0, 2)
    points, books = cut([v for _, v, _ in kept]), cut([first[i] for i in sorted(first)[:entries]])
    for _ in range(rounds):
        counts, sums, _ = _nearest(points, books)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    code = _nearest(points, books)[2]
    error = ((points - np.take_along_axis(books, code[:, :, None], axis=1)) ** 2).sum((0, 2))
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in code[:, k]), int(error[k])) for k, (i, _, _) in enumerate(kept)), digest


def _found(rows, spark, **options):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], COLUMNS)
    coded, made = d.compress(table, **options)
    return sorted((str(r["id"]), r["code"], r["error"]) for r in coded.collect()), made.digest


def _vectors(n, seed, width=16):
    return np.random.default_rng(seed).normal(0, 0.3, (n, width)).round(4).tolist()


@pytest.mark.parametrize("block", [7, 8192])
def test_codes_against_brute_force(spark, block):
    rows = [(int(k * 7 % 300), v, k % 3) for k, v in enumerate(_vectors(300, 1))]
    assert _found(rows, spark, block=block) == _brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, v, None if k % 2 else k) for k, v in enumerate(_vectors(40, 2))]
    rows += [(50, None, 1), (51, [None] + [0.1] * 15, 1), (52, [nan] * 16, 1), (-1, [inf] + [0.0] * 15, 1), (53, [], 1), (-2, [0.5] * 8, 1)]
    rows += [(None, v, None) for v in _vectors(2, 3)] + [(0, v, 0) for v in _vectors(2, 4)] + [(60, [0.25] * 16, 2)] * 30
    assert _found(rows, spark) == _brute(rows)


def test_fewer_ids_than_entries(spark):
    rows = [(k % 3, v, 0) for k, v in enumerate(_vectors(20, 5))]
    assert _found(rows, spark) == _brute(rows)


def test_no_usable_rows(spark):
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 16, 1)]):
        assert _found(rows, spark)[0] == []


def test_what_is_refused(spark):
    with pytest.raises(ValueError):
        _found([(1, [0.5] * 9, 1)], spark)
    with pytest.raises(Exception, match="beyond"):
        _found([(1, [1e30] * 16, 1)], spark)

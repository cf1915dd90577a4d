import hashlib
import random
import zlib

import pytest

from asklens.llm import prefix_trie as p

COLUMNS = "conv_id long, turn long, role string, text string, depth int, x long, block string"


def _brute(rows):
    """Nodes by prefix from the definition."""
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        made[c] = own.get(c - base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for k in members:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += k not in children
    return sorted((min(m), len(k), str(min(members[k[:-1]]) if k else None), len(m), children.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


def _found(spark, rows, **options):
    chat = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], COLUMNS).repartition(3)
    return sorted((r["conv_id"], r["depth"], str(r["parent_conv_id"]), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                   r["ends_sha256"]) for r in p.prefix_trie(chat, **options).collect())


def _chat(seed, n, longest, turns="abc"):
    random.seed(seed)
    return [(c, t, random.choice(["user", None]), random.choice(turns)) for c in random.sample(range(3 * n), n)
            for t in random.sample(range(100), random.randint(1, longest))]


@pytest.mark.parametrize("width", [2, 8])
def test_random_conversations(spark, width):
    rows = _chat(1, 60, 12)
    assert _found(spark, rows, width=width) == _brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, None, None, None), (0, None, "user", "é😀"), (0, 3, "user", ""),
            (1, 1, None, None), (1, 1, "a", "b"), (1, 1, "a", "b"), (1, 1, "ab", ""), (-3, 0, "user", "minus"), (-7, 0, "user", "minus"),
            (-5, 2, "user", "base"), (4, 0, "user", "x"), (12, 0, "user", "w" * 100_000), (13, 0, "user", None), (13, 0, "user", "")]
    assert _found(spark, rows) == _brute(rows)


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(p, "SPAN", 4)
    monkeypatch.setattr(p, "CHUNK", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(5, 60) for t in range(11)]
    rows += [(c, t, "user", f"turn {t}") for c in (100, 101, 103) for t in range(300 + c)]
    assert _found(spark, rows, width=3) == _brute(rows)


def test_no_rows(spark):
    assert _found(spark, []) == [] and _found(spark, [(None, 1, "a", "b")]) == []

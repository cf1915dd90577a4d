import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from asklens.llm import queries, rank_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(rank_bpe.PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def encoder():
    return rank_bpe.Encoder(rank_bpe.Vocabulary.read())


def _want(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)


def _digest(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_every_character_is_cut_and_lowered_like_the_library(encoder, library):
    texts = [" ".join(f"a{chr(c)}{chr(c)}b{chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
             for start in range(0, 0x20000, 64) if not 0x3400 <= start < 0xA000 and not 0xAC00 <= start < 0xF900]
    found = library.encode_batch(texts, add_special_tokens=False)
    assert not [t[:9] for t, f in zip(texts, found, strict=True) if encoder.ids(t) != struct.pack(f"<{len(f.ids)}I", *f.ids)]


def test_random_texts(encoder, library):
    random.seed(3)
    chars = "ab'sΣςİéé́ 1٣½\x1c\x85​　你好😀\n-_!the"
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endof", "'LL", "the ", "ing", "a" * 70, "xyzzy" * 30, "é" * 40, "\x00", "\U00010d52"]
    for _ in range(3000):
        text = "".join(random.choice(parts) if random.random() < 0.2 else random.choice(chars) for _ in range(random.randint(0, 40)))
        ids, back = _want(library, text)
        assert encoder.ids(text) == ids and encoder.text(ids) == back


def test_array_and_heap_agree(encoder):
    random.seed(4)
    made = rank_bpe.Vocabulary.read()
    for _ in range(500):
        parts = [encoder.words.inner[b] for b in "".join(random.choice("theinganrso") for _ in range(random.randint(1, 150))).encode()]
        assert rank_bpe.merged_short(list(parts), made) == rank_bpe.merged_long(list(parts), made)


def test_one_word_of_a_million_letters(encoder, library):
    text = "lower" * 200_000
    assert encoder.ids(text) == _want(library, text)[0]


def test_awkward_rows(spark, awkward, library):
    clash = awkward.withColumnRenamed("score", "encoded").withColumnRenamed("lang", "text_in").withColumnRenamed("doc", "ids_in")
    found = rank_bpe.decode(rank_bpe.encode(clash))
    assert found.columns == [c for c in clash.columns if c != "encoded"] + ["encoded", "decoded"]
    got = sorted((str(r["doc_id"]), r["encoded"]["n_tokens"], bytes(r["encoded"]["ids"]), r["decoded"]) for r in found.collect())
    want = []
    for r in awkward.collect():
        ids, back = _want(library, r["text"] or "")
        want.append((str(r["doc_id"]), len(ids) // 4, ids, back))
    assert got == sorted(want)


def test_no_rows(nothing):
    assert rank_bpe.decode(rank_bpe.encode(nothing)).count() == 0


def test_other_files_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        rank_bpe.Vocabulary.read("/opt/tokenizers/byte_bpe_50k.json")


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_bpe_round"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, back = _want(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, _digest(ids), _digest(back))

"""Token sequences in training order: fixed-stride records, dealt to global slots by a keyed permutation."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from asklens.llm.feistel import permuted
from asklens.llm.shipping import Shipped
from asklens.session import fresh_path, written

LENGTH = 2048             # tokens of a sequence
SHARD_SEQUENCES = 4096    # sequences of a shard
MOST_PARTITIONS = 10_000  # tasks that write shards; beyond it a task writes several
PACK_LEVEL = 6            # of the compression in which sequences wait and travel
SAMPLE_DOCS = 1_000       # documents of a sample for that compression's dictionary; it changes no result
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """A byte-pair vocabulary of ranks; the first free number ends a document and fills the last sequence."""

    ranks: bytes
    pattern: str = PATTERN

    @classmethod
    def read(cls, path: str = RANKS, pattern: str = PATTERN) -> Vocabulary:
        """From a file of lines with a base64 token and its rank, on the driver; workers get its bytes."""
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def encoder(self):
        import tiktoken

        lines = (line.split() for line in self.ranks.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def end(self) -> int:
        return 1 + max(int(line.split()[1]) for line in self.ranks.splitlines() if line)

    @property
    def width(self) -> int:
        """Bytes of a token."""
        return 2 if self.end < 65536 else 4


class Packing:
    """Compression of single sequences, with a dictionary from a sample; records stay alone, so they can be dealt one by one."""

    def __init__(self, dictionary: bytes | None, level: int = PACK_LEVEL):
        self.dictionary, self.level = dictionary, level

    @classmethod
    def of(cls, docs: DataFrame, vocabulary: Vocabulary, length: int, text_col: str) -> Packing:
        """From the beginnings of a few documents that are at hand; none where they are too few to learn from."""
        import zstandard

        encoder, dtype = vocabulary.encoder(), _dtype(vocabulary.width)
        rows = docs.select(F.substring(text_col, 1, 20_000).alias("t")).where("t IS NOT NULL").limit(SAMPLE_DOCS).collect()
        tokens = [encoder.encode_to_numpy(r["t"]).astype(dtype) for r in rows]
        flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype)
        records = [flat[k:k + length].tobytes() for k in range(0, len(flat), length)]
        try:
            return cls(zstandard.train_dictionary(65_536, records).as_bytes())
        except zstandard.ZstdError:
            return cls(None)

    def _given(self) -> dict:
        import zstandard

        return {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}

    def packer(self):
        import zstandard

        return zstandard.ZstdCompressor(level=self.level, write_dict_id=False, **self._given()).compress

    def unpacker(self):
        import zstandard

        return zstandard.ZstdDecompressor(**self._given()).decompress


def _dtype(width: int) -> str:
    return f"<u{width}"


def stage_sequences(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH, id_col: str = "doc_id",
                    text_col: str = "text", path: str | None = None, packing: Packing | None = None) -> DataFrame:
    """(part int, row long, doc_ids array, n_tokens int, tokens binary): packed sequences, written and read back.

    Each task makes one stream of its documents' tokens, every document closed by the end token, and cuts it into
    sequences of ``length``; only a task's last one is filled up (with end tokens, not in ``n_tokens``). Null
    and empty texts are an end token alone. ``doc_ids`` names the documents with a token in the sequence,
    repeats included. Memory holds one batch and one unfinished sequence. Staged once, numbers never change. With a
    ``packing`` the column ``packed`` has each sequence's tokens compressed, in place of ``tokens``.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sent = Shipped(spark, (vocabulary, vocabulary.end, vocabulary.width, packing))
    payload = "tokens" if packing is None else "packed"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end, width, how = sent.value
        encoder, dtype, pack = made.encoder(), _dtype(width), how.packer() if how else bytes
        part, row, rest, owners, kept = TaskContext.get().partitionId(), 0, np.zeros(0, dtype), np.zeros(0, np.int64), None

        def rows(full: np.ndarray, of: np.ndarray, ids: pa.Array, counts: list[int]) -> pa.RecordBatch:
            nonlocal row
            n, starts, picks = len(counts), [0], []
            for k in range(n):
                picks.append(np.unique(of[k * length:k * length + counts[k]]))
                starts.append(starts[-1] + len(picks[-1]))
            named = ids.take(pa.array(np.concatenate(picks)))
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), named), pa.array(counts, pa.int32()),
                 pa.array([pack(full[k * length:(k + 1) * length].tobytes()) for k in range(n)], pa.binary())],
                names=["part", "row", "doc_ids", "n_tokens", payload])
            row += n
            return out

        for batch in batches:
            for begin in range(0, len(batch), 512):
                piece = batch.slice(begin, 512)
                # The unfinished sequence's documents come first in ``ids``.
                ids = piece.column(0) if kept is None else pa.concat_arrays([kept, piece.column(0)])
                first = 0 if kept is None else len(kept)
                tokens = [encoder.encode_to_numpy(t.as_py() or "") for t in piece.column(1)]
                flat = np.concatenate([rest, *(x for t in tokens for x in (t.astype(dtype), np.array([end], dtype)))])
                of = np.concatenate([owners, np.repeat(np.arange(first, first + len(tokens)), [len(t) + 1 for t in tokens])])
                n = len(flat) // length
                if n:
                    yield rows(flat[:n * length], of[:n * length], ids, [length] * n)
                rest, owners = flat[n * length:].astype(dtype), of[n * length:]
                held = np.unique(owners)
                kept, owners = ids.take(pa.array(held)), np.searchsorted(held, owners)
        if len(rest):
            filled = np.concatenate([rest, np.full(length - len(rest), end, dtype)])
            yield rows(filled, owners, kept, [len(rest)])

    staged = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        cut, f"part int, row long, doc_ids array<{kind}>, n_tokens int, {payload} binary")
    path = path or fresh_path(spark, "sequences")
    staged.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(staged.schema).parquet(path)


def training_order(staged: DataFrame, width: int, length: int = LENGTH, key: str = "1",
                   shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """(slot, shard, position, byte_offset, doc_ids, n_tokens, tokens): every sequence at its global slot, sorted in each shard.

    Sequences are numbered by (part, row); a Feistel network with cycle-walking, keyed by ``key``,
    permutes these numbers into slots. Shard k holds the slots from k * shard_sequences on, at a fixed
    stride of ``length * width`` bytes. Packed sequences stay packed. As slots fill their range evenly, the range of a partition is known without
    a sample; the tokens are shuffled once. The driver sees one count per task that staged sequences.
    """
    spark = staged.sparkSession
    counts = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    bases = dict(zip([p for p, _ in counts], np.cumsum([0] + [n for _, n in counts]).tolist(), strict=False))
    sent, stride = Shipped(spark, bases), length * width
    shards = max(1, -(-total // shard_sequences))
    tasks = min(shards, MOST_PARTITIONS)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in staged.schema.fields if f.name not in ("part", "row"))

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            parts, at = np.unique(part, return_inverse=True)
            number = np.array([sent.value[p] for p in parts.tolist()], np.int64)[at] + batch.column(1).to_numpy() \
                if len(part) else np.zeros(0, np.int64)
            slot = permuted(number, max(1, total), key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[2:]], names=["slot", *batch.schema.names[2:]])

    out = staged.mapInArrow(slotted, f"slot long, {kinds}")
    shard = F.floor(F.col("slot") / F.lit(shard_sequences).cast("long")).cast("long")
    out = out.withColumn("shard", shard).withColumn("position", F.pmod("slot", F.lit(shard_sequences)).cast("int"))
    dealt = out.repartitionById(tasks, F.floor(F.col("shard") * F.lit(tasks) / F.lit(shards)).cast("int"))
    return dealt.sortWithinPartitions("slot").select(
        "slot", "shard", "position", (F.col("position").cast("long") * stride).alias("byte_offset"), "doc_ids", "n_tokens", staged.columns[-1])


def shard_file(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def manifest_file(folder: str) -> str:
    return f"{folder}/manifest.json"


def _opened(path: str):
    """(file system, path in it): local folders and the stores that Arrow knows by their address, any other is refused."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def qualified(spark, path: str) -> str:
    """``path`` with the scheme that Spark resolves it to, so that tasks and Spark mean the same store."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(made).toUri()
    return f"file://{full.getPath()}" if full.getScheme() == "file" else full.toString()


def _put(path: str, data: bytes) -> None:
    """Put a small file in place at once."""
    store, target = _opened(path)
    own = f"{target}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as file:
        file.write(data)
    store.move(own, target)


def _there(path: str) -> bool:
    store, target = _opened(path)
    return store.get_file_info(target).type == fs.FileType.File


class _Shards:
    """Files of one task; ``close`` gives (bytes, sha256, written) of the shard that is finished."""

    def __init__(self, folder: str):
        self.folder, self.file, self.shard = folder, None, None
        self.store, path = _opened(folder)
        self.store.create_dir(path, recursive=True)

    def add(self, shard: int, tokens: bytes) -> None:
        if self.file is None:
            self.shard, self.digest, self.size = shard, hashlib.sha256(), 0
            self.target = _opened(shard_file(self.folder, shard))[1]
            self.own = f"{self.target}.{TaskContext.get().taskAttemptId()}"
            self.file = self.store.open_output_stream(self.own)
        self.file.write(tokens)
        self.digest.update(tokens)
        self.size += len(tokens)

    def close(self) -> tuple[int, str, bool]:
        self.file.close()
        self.file = None
        kept = self._same()
        if kept:
            self.store.delete_file(self.own)
        else:
            self.store.move(self.own, self.target)
        return self.size, self.digest.hexdigest(), not kept

    def _same(self) -> bool:
        """Whether the file in place has the new bytes; its length tells nothing, as records have a fixed stride."""
        found = self.store.get_file_info(self.target)
        if found.type != fs.FileType.File or found.size != self.size:
            return False
        with self.store.open_input_stream(self.target) as file:
            digest = hashlib.sha256()
            while piece := file.read(1 << 20):
                digest.update(piece)
        return digest.digest() == self.digest.digest()

    def drop(self) -> None:
        """Leave no half shard behind."""
        if self.file is not None:
            self.file.close()
            self.store.delete_file(self.own)
            self.file = None


def write_shards(ordered: DataFrame, folder: str, packing: Packing | None = None) -> DataFrame:
    """Write each shard as one file of fixed-stride records; (shard, sequences, bytes, sha256, written).

    ``ordered`` is sorted as ``training_order`` gives it, with ``tokens`` or ``packed``. ``folder`` is seen by the driver and all executors: a
    local path that they share, or the address of a store that Arrow opens. A shard goes to a name of its task's own
    first and is renamed when complete, so a lost executor leaves no half shard and a repeated task writes the same
    bytes. A shard in place is kept only if its bytes have the digest of the new ones, which resumes an interrupted write;
    any other is replaced, so ``sha256`` is that of the file that stays. The manifest is taken away first and put back with
    the number of sequences and all digests when every shard is in place: a folder without it is unfinished, and shards that
    an earlier, longer run left behind its end are not read. Records go to the file as they come; nothing holds a shard.
    """
    return _write(ordered, folder, packing)[1]


def _write(ordered: DataFrame, folder: str, packing: Packing | None) -> tuple[DataFrame, DataFrame]:
    """The sequences without their tokens, and the shards written; one job that does both."""
    slim = [f for f in ordered.schema.fields if f.name not in ("tokens", "packed")]
    names, at = [f.name for f in slim], [f.name for f in slim].index("shard")
    payload = "tokens" if packing is None else "packed"
    sent = Shipped(ordered.sparkSession, (folder, packing))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, packing = sent.value
        files, unpack = _Shards(folder), packing.unpacker() if packing else bytes
        held = None  # the last row waits until it is known whether its shard goes on

        def closed(batch: pa.RecordBatch, ends: list) -> pa.RecordBatch:
            more = [pa.array([e and e[k] for e in ends], t) for k, t in enumerate((pa.int64(), pa.string(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*names, "bytes", "sha256", "written"])

        try:
            for batch in batches:
                if not len(batch):
                    continue
                shards, ends = batch.column(at).to_pylist(), [None] * len(batch)
                for k, (shard, tokens) in enumerate(zip(shards, batch.column(len(names)), strict=True)):
                    if files.file is not None and files.shard != shard:
                        end = files.close()
                        if k:
                            ends[k - 1] = end
                        else:
                            yield closed(held, [end])
                            held = None
                    files.add(shard, unpack(tokens.as_py()))
                if held is not None:
                    yield closed(held, [None])
                if len(batch) > 1:
                    yield closed(batch.slice(0, len(batch) - 1), ends[:-1])
                held = batch.slice(len(batch) - 1)
            if held is not None:
                yield closed(held, [files.close()])
        finally:
            files.drop()

    if _there(manifest_file(folder)):
        store, path = _opened(manifest_file(folder))
        store.delete_file(path)
    _Shards(folder)
    kinds = StructType([*slim, StructField("bytes", LongType()), StructField("sha256", StringType()), StructField("written", BooleanType())])
    order = written(ordered.select(*names, payload).mapInArrow(kept, kinds), "order")
    ended = order.where("sha256 IS NOT NULL").select("shard", "bytes", "sha256", "written")
    found = order.groupBy("shard").agg(F.count("*").alias("sequences")).join(ended, "shard").select(
        "shard", "sequences", "bytes", "sha256", "written")
    rows = found.orderBy("shard").collect()  # a row for each file
    _put(manifest_file(folder), json.dumps(
        {"sequences": sum(r["sequences"] for r in rows), "sha256": [r["sha256"] for r in rows]}).encode())
    return order.drop("bytes", "sha256", "written"), found


def read_slots(folder: str, first: int, count: int, width: int, length: int = LENGTH,
               shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """Sequences from slot ``first`` on, as a resumed trainer reads them: one seek, then sequential reads.

    The manifest says how many there are; without it, or with a shard missing or short before that end, reading fails.
    """
    store, path = _opened(manifest_file(folder))
    with store.open_input_stream(path) as file:
        end = min(first + count, json.loads(file.read())["sequences"])
    stride, slot = length * width, first
    while slot < end:
        shard, position = divmod(slot, shard_sequences)
        with store.open_input_file(_opened(shard_file(folder, shard))[1]) as file:
            file.seek(position * stride)
            while slot < min(end, (shard + 1) * shard_sequences):
                record = file.read(stride)
                if len(record) < stride:
                    raise ValueError(f"shard {shard} in {folder} ends before slot {slot}")
                yield np.frombuffer(record, _dtype(width))
                slot += 1


def with_tokens(order: DataFrame, folder: str, stride: int) -> DataFrame:
    """``order`` (shard, byte_offset, ...) and ``tokens``: each sequence as its shard has it."""
    shard_at, byte_at, names = order.columns.index("shard"), order.columns.index("byte_offset"), order.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = file = None
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch, out = whole.slice(start, 1024), []
                for shard, begin in zip(batch.column(shard_at).to_pylist(), batch.column(byte_at).to_pylist(), strict=True):
                    if shard != now:
                        store, path = _opened(shard_file(folder, shard))
                        now, file = shard, store.open_input_file(path)
                    out.append(file.read_at(stride, begin))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "tokens"])

    return order.mapInArrow(read, StructType([*order.schema.fields, StructField("tokens", BinaryType())]))


def materialise(docs: DataFrame, vocabulary: Vocabulary | None = None, length: int = LENGTH, key: str = "1",
                shard_sequences: int = SHARD_SEQUENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to sequences in training order; see ``stage_sequences``, ``training_order`` and ``write_shards``.

    The call writes the shards, and then their manifest, to a new folder below the shared one, which the metadata of
    ``byte_offset`` name; the result lists the sequences and reads their tokens from the shards. Sequences wait and travel
    compressed, so each lies on disk twice in that form and once in its shard. Repeated rows and null ids are
    documents like any other, null and empty texts are an end token alone, an empty table gives no rows and a manifest of none.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or Vocabulary.read()
    packing = Packing.of(docs, vocabulary, length, text_col)
    staged = stage_sequences(docs, vocabulary, length, id_col, text_col, packing=packing)
    ordered = training_order(staged, vocabulary.width, length, key, shard_sequences)
    folder = qualified(spark, fresh_path(spark, "shards"))
    out = with_tokens(_write(ordered, folder, packing)[0], folder, length * vocabulary.width)
    return out.select(*(F.col(c).alias(c, metadata={"folder": folder}) if c == "byte_offset" else c for c in out.columns))

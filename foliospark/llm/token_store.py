"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

Shard file: the ids of its documents one after the other, two bytes each if the vocabulary allows it, else four
(little-endian); then each document's number of ids (eight bytes each), then a footer: the number of documents, the bytes of an
id, and the magic word.  Documents come in ascending order of their key, over all shards.

Index file: the keys of one hash bucket.  Levels of bit arrays give every key of the bucket its own number below the number of
keys: a key takes the first level where no other key has its bit, and its number is the count of bits before it.  A record at
that number holds a fingerprint of the key (so that keys that are not stored are told apart), the shard, the byte offset, the
number of the first document and how many documents have the key.  Looking a key up reads one record, whatever the size.

Buckets and shards are bounded, so no task holds more than one of them; a task that is run again writes new files, and
only files named by its finished rows are used.

Defined results: a null or empty text is the end id alone; a null key is stored first, as a key of its own; repeated keys are
stored one after the other and found together; an empty table gives no shards and an empty index; extra columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shingles import mixed
from .work import file_system, shared_folder, slices, stash

MAGIC = 0x54494453
SHARD_BYTES = 32 << 20
BUCKET_KEYS = 100_000
RECORD = np.dtype([("fingerprint", "<u4"), ("rows", "<u4"), ("shard", "<i8"), ("offset", "<u8"), ("first", "<u8")])
LEVELS = 48


def key_number(key: str) -> Column:
    """The 64-bit number that stands for a key in the index."""
    return F.xxhash64(F.col(key))


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit numbers."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bits of each level; numbers that no level could place
        self.ranks = [np.concatenate([[0], np.cumsum(bits)]) for bits in levels]
        self.before = np.cumsum([0, *[int(r[-1]) for r in self.ranks]])

    @staticmethod
    def _places(numbers: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(numbers ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def over(cls, numbers: np.ndarray) -> PerfectHash:
        levels, left = [], numbers
        while len(left) and len(levels) < LEVELS:
            size = 2 * len(left) + 1
            places = cls._places(left, len(levels), size)
            bits = np.bincount(places, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[places]]
        return cls(levels, np.sort(left))

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number; for one that was not in the set any place, or -1."""
        out, open_ = np.full(len(numbers), -1, np.int64), np.arange(len(numbers))
        for level, bits in enumerate(self.levels):
            places = self._places(numbers[open_], level, len(bits))
            hit = bits[places]
            out[open_[hit]] = self.before[level] + self.ranks[level][places[hit]]
            open_ = open_[~hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, numbers[open_]), len(self.rest) - 1)
            same = self.rest[at] == numbers[open_]
            out[open_[same]] = self.before[-1] + at[same]
        return out

    def dump(self) -> bytes:
        head = json.dumps({"levels": [len(b) for b in self.levels], "rest": len(self.rest)}).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.rest.tobytes()

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The function, and the number of bytes it took."""
        at = 8 + int.from_bytes(data[:8], "little")
        head, levels = json.loads(data[8:at]), []
        for size in head["levels"]:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels, np.frombuffer(data, np.uint64, head["rest"], at)), at + 8 * head["rest"]


def fingerprint(numbers: np.ndarray) -> np.ndarray:
    return (mixed(numbers ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class _Shard:
    """A shard file being written."""

    def __init__(self, folder: str, width: int):
        fs, path = file_system(folder)
        self.file = f"{uuid.uuid4().hex}.ids"
        fs.create_dir(path, recursive=True)
        self.out, self.width, self.bytes, self.counts = fs.open_output_stream(f"{path}/{self.file}"), width, 0, []

    def add(self, ids: np.ndarray) -> int:
        at = self.bytes
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.bytes += len(ids) * self.width
        self.counts.append(len(ids))
        return at

    def close(self) -> None:
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(np.array([len(self.counts), self.width, MAGIC], "<u4").tobytes())
        self.out.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents; per document: key, number (of the key), shard, file, row, offset, n_tokens (a stored table)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(chars // (2 * shard_bytes)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, made, shard, last = TaskContext.get().partitionId(), 0, None, object()
        encode = encoder(tokenizer)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for k, value in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if shard is None or shard.bytes >= shard_bytes and k != last:  # a key stays in one shard
                        if shard is not None:
                            shard.close()
                        shard, made = _Shard(folder, width), made + 1
                    ids = np.frombuffer(encode.ids(value), "<u4")
                    rows.append(((task << 20) + made, shard.file, len(shard.counts), shard.add(ids), len(ids)))
                    last = k
                own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("number"), *own], ["key", "number", "shard", "file", "row", "offset", "n_tokens"])
        if shard is not None:
            shard.close()

    dealt = docs.select(F.col(key).alias("key"), key_number(key).alias("number"), F.col(text).alias("text")).repartitionByRange(parts, "key").sortWithinPartitions("key")
    return stash(dealt.mapInArrow(run, f"key {kind}, number bigint, shard bigint, file string, row bigint, offset bigint, n_tokens bigint"), "entries")


def write_index(entries: DataFrame, folder: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Write the index files over the entries' keys; per bucket: bucket, buckets, index_file (a stored table)."""
    keys = entries.groupBy("number").agg(F.min(F.struct("shard", "row", "offset")).alias("at"), F.count("*").alias("rows"))
    buckets = max(1, -(-entries.count() // bucket_keys))

    def build(numbers: np.ndarray, rows: pa.Table, bucket: int) -> pa.RecordBatch:
        function = PerfectHash.over(numbers)
        place = function.find(numbers)
        records = np.zeros(len(numbers), RECORD)
        for name, column in (("rows", "rows"), ("shard", "shard"), ("offset", "offset"), ("first", "row")):
            records[name][place] = rows.column(column).to_numpy()
        records["fingerprint"][place] = fingerprint(numbers)
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.idx"
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(function.dump() + records.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([buckets], pa.int32()), pa.array([name])], ["bucket", "buckets", "index_file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            return build(rows.column("number").to_numpy().view(np.uint64), rows, now)
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                if end > begin:
                    if held and bucket[begin] != now:
                        yield done()
                        held = []
                    now = int(bucket[begin])
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield done()

    rows = keys.select(F.pmod("number", F.lit(buckets)).cast("int").alias("bucket"), "number", "rows", "at.shard", "at.row", "at.offset")
    return stash(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, buckets int, index_file string"), "index")


def look_up(keys: DataFrame, index: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """For keys (one column): key, shard, offset, first, rows through the index files; keys that are not stored are left out."""
    buckets = (index.agg(F.max("buckets")).first()[0]) or 1
    kind = keys.schema[key].dataType.simpleString()
    asked = keys.select(F.col(key).alias("key"), key_number(key).alias("number")).withColumn("bucket", F.pmod("number", F.lit(buckets)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        now = function = records = None
        for batch in batches:
            files = batch.column("index_file").to_pylist()
            cuts = [i for i in range(1, len(files)) if files[i] != files[i - 1]]
            for begin, end in zip([0, *cuts], [*cuts, len(files)], strict=True):
                if end == begin:
                    continue
                if files[begin] != now:
                    now = files[begin]
                    with fs.open_input_stream(f"{path}/{now}") as file:
                        data = file.read()
                    function, size = PerfectHash.load(data)
                    records = np.frombuffer(data, RECORD, -1, size)
                part = batch.slice(begin, end - begin)
                numbers = part.column("number").to_numpy().view(np.uint64)
                place = function.find(numbers)
                hit = (place >= 0) & (records["fingerprint"][place] == fingerprint(numbers))
                found = records[place[hit]]
                yield pa.RecordBatch.from_arrays([part.column("key").filter(pa.array(hit)), *(pa.array(found[c].astype(np.int64)) for c in ("shard", "offset", "first", "rows"))],
                                                 ["key", "shard", "offset", "first", "rows"])

    dealt = asked.repartition("bucket").join(index.select("bucket", "index_file"), "bucket").select("key", "number", "index_file").sortWithinPartitions("index_file")
    return dealt.mapInArrow(run, f"key {kind}, shard bigint, offset bigint, first bigint, rows bigint")


def read_documents(found: DataFrame, shards: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Per stored document of the found keys: key, shard, row, offset, n_tokens, ids_crc32 (and ids), from the shard files."""
    kind = found.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        now = counts = file = None
        for batch in batches:
            out: list[tuple] = []
            for k, shard, name, offset, first, rows in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "file", "offset", "first", "rows")), strict=True):
                if name != now:
                    now, file = name, fs.open_input_file(f"{path}/{name}")
                    end = file.size()
                    n, width, magic = np.frombuffer(file.read_at(12, end - 12), "<u4").tolist()
                    if magic != MAGIC:
                        raise ValueError(f"{name} is no shard file")
                    counts = np.frombuffer(file.read_at(8 * n, end - 12 - 8 * n), "<u8")
                for row in range(first, first + rows):
                    size = int(counts[row])
                    ids = np.frombuffer(file.read_at(size * width, offset), f"<u{width}").astype("<u4").tobytes()
                    out.append((k, shard, row, offset // width, size, zlib.crc32(ids), *[ids] * with_ids))
                    offset += size * width
            if out:
                types = [batch.column("key").type, *[pa.int64()] * 5, *[pa.binary()] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 ["key", "shard", "row", "before", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    dealt = found.repartition("shard").join(shards.select("shard", "file"), "shard").select("key", "shard", "file", "offset", "first", "rows").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, f"key {kind}, shard bigint, row bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents, index them, find every key and read it back: key, start, n_tokens, ids_crc32."""
    from pyspark.sql import Window
    folder = shared_folder(docs.sparkSession, "ids")
    entries = write_shards(docs, folder, tokenizer, key, text)
    index = write_index(entries, folder)
    shards = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    shards = stash(shards.withColumn("start", F.sum("n").over(Window.orderBy("shard")) - F.col("n")), "shards")  # one row for each shard file
    stored = read_documents(look_up(docs.select(key).distinct(), index, folder, key), shards, folder)
    return stored.join(shards.select("shard", "start"), "shard").select(F.col("key").alias(key), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

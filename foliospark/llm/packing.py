"""Packing documents into training windows by multiway differencing.

A document's ids are cut into full windows and one rest.  Rests are packed group by group (a group is what a task has
gathered up to a fixed number of ids, so memory does not grow with the table): the Karmarkar-Karp method keeps partial
partitions into k windows and merges the two with the widest spread, largest window of one with smallest of the other,
until one partition with near-equal windows is left.  k starts at about the fewest windows that could hold the group and rises
while the fullest window exceeds the capacity.  Rests longer than `most_piece` are cut first, as finer pieces balance better.

Defined results: a null or empty text is the end id alone; repeated rows and equal ids are packed as separate documents;
an empty table gives no rows; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .work import slices, stash

WINDOW = 2048


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp differencing of items into k windows: the items of each window."""
    left, right = [0] * (len(sizes) + 1), [0] * (len(sizes) + 1)  # nodes 1..n are items, later ones are unions
    single = lambda i: (np.array([sizes[i]] + [0] * (k - 1), np.int64), np.array([i + 1] + [0] * (k - 1), np.int64))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (a_sums, a_nodes), (b_sums, b_nodes) = (held.pop(i) if i in held else single(i) for i in (heapq.heappop(heap)[1], heapq.heappop(heap)[1]))
        sums, b_nodes = a_sums + b_sums[::-1], b_nodes[::-1]
        nodes = a_nodes + b_nodes
        both = np.flatnonzero((a_nodes > 0) & (b_nodes > 0))
        nodes[both] = np.arange(len(left), len(left) + len(both))
        left.extend(a_nodes[both].tolist())
        right.extend(b_nodes[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        held[made] = (sums - sums[-1], nodes[order])
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), made))
        made += 1
    roots = (held.popitem()[1] if held else single(0))[1].tolist() if sizes else []
    windows = []
    for root in roots:
        items, stack = [], [root] if root else []
        while stack:
            node = stack.pop()
            if node <= len(sizes):
                items.append(node - 1)
            else:
                stack += (left[node], right[node])
        windows.append(sorted(items))
    return windows


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`: differencing with ever more windows until the fullest one fits."""
    k = max(1, -(-sum(sizes) // capacity))
    k += k // 100  # many windows almost never fit without one spare in a hundred, and each trial costs a whole differencing
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += max(1, k // 200)


def document_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = WINDOW,
                    most_piece: int = 512, with_ids: bool = False) -> DataFrame:
    """Each document's ids cut into full windows and smaller rests: key, start, length, ids_crc32, doc_tokens (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20 if with_ids else 8 << 20):
                rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
                for i, value in enumerate(part.column("text").to_pylist()):
                    data = memoryview(encode.ids(value))
                    n, at = len(data) // 4, 0
                    while at < n:
                        length = capacity if n - at >= capacity else min(most_piece, n - at)
                        piece = data[4 * at:4 * (at + length)]
                        rows.append(i)
                        starts.append(at)
                        lengths.append(length)
                        sums.append(zlib.crc32(piece))
                        totals.append(n)
                        if with_ids:
                            ids.append(bytes(piece))
                        at += length
                columns = [part.column("key").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
                names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def pack(pieces: DataFrame, capacity: int = WINDOW, group_windows: int = 256) -> DataFrame:
    """Pieces with sequence_id and offset; `pieces` must be a stored table, as it is read twice."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, int(total // (4 * group_windows * capacity)))
    names = [f.name for f in pieces.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows.column("length").to_pylist()
            order, sequence, offsets = [], [], []
            for window in balanced_windows(lengths, capacity):
                at = 0
                for i in window:
                    order.append(i)
                    sequence.append(number)
                    offsets.append(at)
                    at += lengths[i]
                number += 1
            rows = rows.take(pa.array(order, pa.int64())).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

        for batch in batches:
            lengths = batch.column("length").to_numpy()
            full = batch.filter(pa.array(lengths == capacity))
            if full.num_rows:
                own = pa.array(np.arange(number, number + full.num_rows))
                yield pa.RecordBatch.from_arrays([*full.columns, own, pa.array(np.zeros(full.num_rows, np.int64))], [*names, "sequence_id", "offset"])
                number += full.num_rows
            rest = batch.filter(pa.array(lengths < capacity))
            sums = np.cumsum(rest.column("length").to_numpy())
            begin = done = 0
            while begin < rest.num_rows:
                end = int(np.searchsorted(sums, done + group_windows * capacity - size, "right"))
                if end >= rest.num_rows:
                    held.append(rest.slice(begin))
                    size += int(sums[-1]) - done
                    break
                if end > begin:
                    held.append(rest.slice(begin, end - begin))
                yield packed()
                done, begin, held, size = int(sums[end - 1]) if end else 0, end, [], 0
        if held:
            yield packed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.coalesce(tasks).mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = WINDOW,
                   with_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one piece of one window: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and the ids of the piece)."""
    return pack(stash(document_pieces(docs, tokenizer, key, text, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """Windows put together from pieces packed with their ids: sequence_id, length, ids (little-endian 32-bit)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.concat_ws("", F.transform(parts, F.hex)).alias("hexed")).select("sequence_id", "length", F.unhex("hexed").alias("ids"))

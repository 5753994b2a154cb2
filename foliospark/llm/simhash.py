"""SimHash fingerprints of word shingles, exact pairs within a Hamming radius by vantage-point trees, and their classes.

A shingle's number is the XXH64 of its words; a bit of the fingerprint is set where over half of a text's shingles (repeats count)
have it set.  Equal fingerprints are one point.  A vantage-point tree over a bounded sample of the points cuts the space into shards:
a node's points within `cut` of its vantage point go inside, the others outside.  By the triangle inequality an inside point has a
partner outside only if it lies within `radius` of the boundary, so only those points are copied outside; all other branches are
pruned.  Two points within the radius therefore meet in at least one shard, whatever the sample was.  Every shard is cut further by
trees of its own points in the same way, down to buckets whose pairs are compared; a bucket returns a spanning forest of its pairs
instead of all of them.  Components of the forests are found by joins.

Sampled: the points that the shards' tree is grown from (about SAMPLE).  All points are dealt and compared.  A bucket that no vantage
point cuts well (many points in a small ball) is compared whole, in blocks.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle; a bit set in exactly half of the shingles is 0; equal and repeated rows are one point; a row with a null
key gets the smallest key of its component that is not null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import attach
from .components import components
from .work import slices, stash

WORDS = 3
SEED = 42
RADIUS = 2
SAMPLE = 100_000      # points that the shards' tree is grown from
MOST_SHARDS = 4096
SHARD = 4_000         # points a shard should have, while there are fewer than MOST_SHARDS
BUCKET = 256          # points whose pairs are compared at once
TRIES = 8             # vantage points tried for each cut
HOT_SHARE = 1000      # a point with more than this part of all rows is joined by broadcast: at most as many points
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_numbers(text: str | None, size: int = WORDS) -> list[int]:
    """XXH64 of every shingle of a text.  A-Z are lower-cased; only ASCII white space separates words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    begins = [0] + [e + 1 for e in ends[:-1]]
    number = xxhash.xxh64_intdigest
    return [number(joined[b:e], SEED) for b, e in zip(begins, ends[size - 1:], strict=False)] if len(words) >= size else [number(joined, SEED)]


def fingerprint(numbers: list[int], block: int = 1 << 16) -> int:
    """The number whose bits are set in over half of the numbers; long lists are counted in blocks."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(numbers), block):
        part = np.array(numbers[i:i + block], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(numbers)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """(key, point) of every row; the point is the fingerprint as a signed 64-bit number."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                points = np.array([fingerprint(shingle_numbers(t, size)) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(points.view(np.int64))], ["key", "point"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, point bigint")


def distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def best_cut(points: np.ndarray, radius: int, seed: int = 1) -> tuple[int, int] | None:
    """A vantage point and a distance that cut the points evenly with few of them near the boundary; None if no cut helps.

    The larger side, copies included, must be smaller than nine tenths of the points.
    """
    rng, best, least = np.random.default_rng(seed), None, 0.9 * len(points)
    for vantage in points[rng.integers(0, len(points), TRIES)].tolist():
        upto = np.cumsum(np.bincount(distance(points, vantage), minlength=65))
        inside = upto[:64]
        outside = len(points) - np.concatenate([np.zeros(radius, np.int64), upto])[:64]  # all but those at most cut - radius away
        size = np.maximum(inside, outside)
        cut = int(np.argmin(size))
        if size[cut] < least:
            best, least = (vantage, cut), size[cut]
    return best


def sides(points: np.ndarray, vantage: int, cut: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside, and which outside: those beyond the cut and those inside that may have a partner there."""
    d = distance(points, vantage)
    return d <= cut, d > cut - radius


class Shards:
    """Vantage-point tree whose leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int = RADIUS):
        self.radius, self.nodes = radius, []
        self.shards = 0
        self._grow(sample, max(1, len(sample) // max(1, shards)))

    def _grow(self, sample: np.ndarray, enough: int) -> int:
        """Adds the node of some points and returns its number; nodes are (vantage, cut, inside, outside) or (shard,)."""
        here, found = len(self.nodes), None
        self.nodes.append(None)
        if len(sample) > enough:
            found = best_cut(sample, self.radius)
        if found is None:
            self.nodes[here] = (self.shards,)
            self.shards += 1
            return here
        within = distance(sample, found[0]) <= found[1]
        self.nodes[here] = (*found, self._grow(sample[within], enough), self._grow(sample[~within], enough))
        return here

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, index of the point) for every shard where a point may have a partner or is at home."""
        shards, index, todo = [], [], [(0, np.arange(len(points)))]
        while todo:
            here, rows = todo.pop()
            node = self.nodes[here]
            if len(node) == 1:
                shards.append(np.full(len(rows), node[0]))
                index.append(rows)
            elif len(rows):
                inside, outside = sides(points[rows], node[0], node[1], self.radius)
                todo += [(node[2], rows[inside]), (node[3], rows[outside])]
        return np.concatenate(shards), np.concatenate(index)


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a bucket within the radius: from every point but the first of a group to a point reached before."""
    if len(points) <= 2 * BUCKET:  # most small buckets have few pairs: go on with those points alone
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        points = points[near.sum(axis=1) > 1]
    left, a, b = points, [], []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            step = max(1, (1 << 22) // len(left))
            front, reached = reached[:step], reached[step:]
            near = np.bitwise_count(front[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                a.append(front[near.argmax(axis=0)[hit]])
                b.append(left[hit])
                reached, left = np.concatenate([reached, left[hit]]), left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(points: np.ndarray, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all distinct points that a chain of steps within the radius connects; trees cut the points into buckets."""
    a, b, todo = [], [], [points]
    while todo:
        here = todo.pop()
        found = best_cut(here, radius) if len(here) > bucket else None
        if found:
            todo += [here[side] for side in sides(here, *found, radius)]
        elif len(here) > 1:
            x, y = forest(here, radius)
            a.append(x)
            b.append(y)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_points(points: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, most: int = MOST_SHARDS) -> DataFrame:
    """Links (a, b) that connect the n distinct points of a stored table within the radius."""
    spark = points.sparkSession
    chosen = points.where(F.pmod(F.xxhash64("point"), F.lit(max(n, 1))) < SAMPLE).collect() if n > SAMPLE else points.collect()  # about SAMPLE numbers
    tree = Shards(np.sort(np.array([r["point"] for r in chosen], np.int64)).view(np.uint64), min(most, -(-n // shard)), radius)
    sent = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("point").to_numpy()
            if len(values):
                shards, rows = sent.value.deal(values.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(values[rows])], ["shard", "point"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        a, b = links(np.sort(group["point"].to_numpy(np.int64)).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.mapInArrow(deal, "shard int, point bigint").groupBy("shard").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row: key, fingerprint (16 hexadecimal digits), component_id (the smallest key that links reach)."""
    rows = stash(fingerprints(docs, key, text, size).withColumn("row", F.monotonically_increasing_id()), "points")
    points = stash(rows.groupBy("point").agg(F.min("key").alias("first"), F.count("*").alias("n_rows")), "distinct")
    total, n = points.agg(F.sum("n_rows"), F.count("*")).first()
    roots = components(near_points(points.select("point"), n, radius))
    joined = points.join(roots, points["point"] == roots["node"], "left").select("point", "first", "n_rows", F.coalesce("root", "point").alias("root"))
    joined = stash(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = attach(joined, least, ["root"], ["point"], "members", n // HOT_SHARE).select("point", "n_rows", "component_id")
    found = attach(rows, stash(named, "named"), ["point"], ["row"], "n_rows", (total or 0) // HOT_SHARE)
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")

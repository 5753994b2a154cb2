"""Exact Jaccard join of documents on word 5-grams, with a count-vector R-tree, and the classes of linked documents.

A document's shingles are hashed into groups; its point is the vector of group counts.  Two sets can share at most the
sum over the groups of the smaller count, and an R-tree node, which keeps the largest count of each group, bounds that sum
for all points below it.  Pairs whose bound reaches the overlap that the threshold needs are verified on the whole sets.

So that no task sees all points, a pair is only looked for where both documents share a key: a document's keys are its
n - ceil(t n) + 1 shingles that come first in one order of all shingles, so linked documents share one.  The order puts
shingles of crowded hash cells (passages that many documents share) last.  Documents with the same set are one class and
are compared once.  In each key the classes are first compared with single ones (the smallest, then pivots), round by round, which joins
groups of near copies without listing their pairs; then R-trees compare, in blocks, the classes of keys that still hold different components.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; fewer words than a
shingle make one shingle; equal and repeated rows are one class; rows are compared by their texts whatever their keys, null and
repeated ones too; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import components
from .shingles import WORDS, mixed, shingles
from .work import slices, stash

CELLS = 1 << 21   # hash cells whose load orders the shingles
PARTS = 16
GROUPS = 256      # dimensions of the count vectors, one byte each; FULL stands for that many or more
FULL = 255
FINE = 2048       # finer groups, one bit each, for the last bound before whole sets are compared
BITS = 1 << 22    # size of the filter that picks the documents whose sets are needed
LEAF = 16
BLOCK = 512
PERCENT = 75
HELD = 1 << 20    # pairs that a task holds before it hands them on
MANY = 10_000     # pairs from which bitmaps are worth one more pass over the documents


def _fingerprints(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for the set of each text."""
    begin = np.cumsum(n) - n
    has = n > 0
    out = np.zeros(len(n), np.uint64)
    if has.any():
        out[has] = mixed(np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin[has]) ^ mixed(np.bitwise_xor.reduceat(hashes, begin[has])) + n[has].astype(np.uint64))
    return out.view(np.int64)


def _points(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """For each text its group counts, then the bits of the fine groups that have a shingle."""
    counts = np.bincount(owner * GROUPS + (hashes % np.uint64(GROUPS)).astype(np.int64), minlength=rows * GROUPS)
    fine = np.zeros((rows, FINE), bool)
    fine[owner, ((hashes >> np.uint64(20)) % np.uint64(FINE)).astype(np.int64)] = True
    return np.concatenate([np.minimum(counts, FULL).astype(np.uint8).reshape(-1, GROUPS), np.packbits(fine, axis=1)], axis=1)


def _bytes(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _counts(points: np.ndarray) -> np.ndarray:
    """Group counts as numbers; a full one bounds nothing, so it is as large as any."""
    counts = points[:, :GROUPS].astype(np.int64)
    counts[counts == FULL] = 1 << 40
    return counts


def _bitmaps(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each text a bitmap of its shingles, 8 to 16 bits for each of them; sizes are powers of two, 64 at least."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(8 * n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    flat = np.zeros(int(bits.sum()), bool)
    flat[(ends - bits)[owner] + (hashes & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(flat)
    return [packed[(e - b) // 8:e // 8].tobytes() for b, e in zip(bits.tolist(), ends.tolist(), strict=True)]


def _bitmap_bound(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """How many shingles two sets can share, by their bitmaps; of different sizes, places are equal modulo the smaller size."""
    if len(x) > len(y):
        x, y, n, m = y, x, m, n
    each = y.reshape(-1, len(x))
    return int(min(n - np.bitwise_count(x & ~np.bitwise_or.reduce(each, axis=0)).sum(dtype=np.int64), m - np.bitwise_count(each & ~x).sum(dtype=np.int64)))


def _fine_bound(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles two sets can share: all but those whose fine group is empty in the other set."""
    return np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - int(math.log2(CELLS)))).astype(np.int64)


def classes(docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, class, point, mark) of every document, class null without shingles, mark a hash of its text; and the cells' loads of each task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, seen = np.zeros(CELLS, np.uint32), set()
        names = ["key", "n", "class", "point", "mark", "part", "load"]
        none = None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                owner, hashes = shingles(part.column("text").to_pylist(), size)
                n = np.bincount(owner, minlength=part.num_rows)
                marks = _fingerprints(owner, hashes, n)
                fresh = np.array([m not in seen and not seen.add(m) for m in marks.tolist()], bool)
                load += np.bincount(_cells(hashes[fresh[owner]]), minlength=CELLS).astype(np.uint32)
                keys, none = part.column("key"), part.column("key").type
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(marks, mask=n == 0), pa.array([p.tobytes() for p in _points(owner, hashes, len(n))], pa.binary()), part.column("mark"),
                                                  pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if none is not None:
            parts = np.split(load, PARTS)
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, none), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names)

    rows = stash(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(run, f"key {kind}, n bigint, class bigint, point binary, mark bigint, part int, load binary"), "classes")
    return rows.where("part is null").select("key", "n", "class", "point", "mark"), rows.where("part is not null").select("part", "load")


def cell_loads(loads: DataFrame) -> np.ndarray:
    """Loads of all cells over all tasks: an array of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, load in zip(batch.column("part").to_pylist(), batch.column("load").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(load), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], ["part", "load"])

    found = {r["part"]: np.frombuffer(bytes(r["load"]), np.uint32) for r in loads.repartition(PARTS, "part").mapInArrow(run, "part int, load binary").collect()}
    return np.concatenate([found.get(i, np.zeros(CELLS // PARTS, np.uint32)) for i in range(PARTS)])


def class_keys(docs: DataFrame, text: str, size: int, percent: int, loads) -> DataFrame:
    """(key, class): the first n - ceil(t n) + 1 shingles of every class in the order of the cells' loads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, seen = loads.value, set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                owner, hashes = shingles(part.column("text").to_pylist(), size)
                n = np.bincount(owner, minlength=part.num_rows)
                marks = _fingerprints(owner, hashes, n)
                fresh = np.array([m not in seen and not seen.add(m) for m in marks.tolist()], bool)[owner]
                owner, hashes = owner[fresh], hashes[fresh]
                order = np.lexsort((hashes, load[_cells(hashes)], owner))
                owner, hashes = owner[order], hashes[order]
                count = np.bincount(owner, minlength=part.num_rows)
                place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
                first = place < (n - -(-n * percent // 100) + 1)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(marks[owner[first]])], ["key", "class"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key bigint, class bigint")


def class_sets(docs: DataFrame, wanted: DataFrame, text: str, size: int, bitmaps: bool = False) -> DataFrame:
    """(class, n, shingles as bytes or their bitmap) of the wanted (class, mark) rows; mark: the hash of one text of the class.

    A filter of fixed size, built from the marks, picks those texts and a few others while documents are read, so texts are
    not shuffled.  What is picked is dealt by the class of the text itself, so keys play no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                owner, hashes = shingles(part.column("text").to_pylist(), size)
                n = np.bincount(owner, minlength=part.num_rows)
                marks, ends = _fingerprints(owner, hashes, n), np.cumsum(n)
                fresh = [i for i, m in enumerate(marks.tolist()) if n[i] and m not in seen and not seen.add(m)]
                made = _bitmaps(owner, hashes, n) if bitmaps else None
                sets = [made[i] if bitmaps else hashes[ends[i] - n[i]:ends[i]].tobytes() for i in fresh]
                yield pa.RecordBatch.from_arrays([pa.array(marks[fresh]), pa.array(n[fresh]), pa.array(sets, pa.binary())], ["class", "n", "shingles"])

    bit = F.pmod("mark", F.lit(BITS))
    mask = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    filters = wanted.withColumn("bit", bit).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(mask).alias("mask"))  # at most BITS / 64 rows
    read = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("mark")).withColumn("bit", bit).withColumn("word", F.expr("bit div 64"))
    picked = read.join(F.broadcast(filters), "word").where(F.col("mask").bitwiseAND(mask) != 0).select("text")
    found = picked.mapInArrow(run, "class bigint, n bigint, shingles binary")
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def possible(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and fine groups allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
                bound = _fine_bound(_bytes(batch.column("x")), _bytes(batch.column("y")), n, m)
                yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * bound >= percent * (n + m)))

    fine = F.substring("point", GROUPS + 1, FINE // 8)
    x = points.select(F.col("class").alias("a"), "n", fine.alias("x"))
    y = points.select(F.col("class").alias("b"), F.col("n").alias("m"), fine.alias("y"))
    sized = pairs.join(x, "a").join(y, "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return sized.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a bigint, b bigint")


def linked(pairs: DataFrame, docs: DataFrame, members: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), a stored table, of classes whose whole sets are as similar as asked for; also stored.

    Of many pairs bitmaps, an eighth of the sets' size, first bound the overlap: whole sets are dealt for few other pairs than links.
    """
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                bound = _bitmap_bound(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), n, m)
                keep.append((100 + percent) * bound >= percent * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compared(pairs: DataFrame, test, name: str, bitmaps: bool) -> DataFrame:
        needed = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = stash(members.join(needed, "class").groupBy("class").agg(F.min("mark").alias("mark")), "wanted")
        sets = stash(class_sets(docs, wanted, text, size, bitmaps), "sets")
        whole = pairs.join(sets.toDF("a", "n", "x"), "a").join(sets.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
        return stash(whole.mapInArrow(test, "a bigint, b bigint"), name)

    return compared(compared(pairs, bounded, "pairs", True) if pairs.count() >= MANY else pairs, run, "linked", False)


class Tree:
    """R-tree over count vectors, packed by size: every node keeps the largest counts and the range of sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > LEAF:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points that may be as similar as asked for: sizes fit and the summed minima reach the needed overlap."""
        found = np.arange(len(self.levels[-1][0]))
        for depth, (top, low, high) in reversed(list(enumerate(self.levels))):
            least = np.maximum(low[found], -(-size * percent // 100))
            fits = (100 * high[found] >= percent * size) & (percent * low[found] <= 100 * size)
            bound = np.minimum(top[found], point).sum(axis=1)
            found = found[fits & ((100 + percent) * bound >= percent * (size + least))]
            if depth:
                found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
                found = found[found < len(self.levels[depth - 1][0])]
        return self.order[found]


def survivors(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with different labels in a common key whose bound allows a link.

    rows: key, class, label; points: class, n, point.  A key of many classes is cut into blocks, and each pair of blocks is a group
    of its own.  Points join when rows are dealt, so only one shuffle carries them for each key.
    """
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    cut = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "label").join(points, "class")

    def compare(group: list[pa.RecordBatch]) -> np.ndarray:
        t = pa.Table.from_batches(group)
        block, cls, label, n = (t.column(c).to_numpy() for c in ("block", "class", "label", "n"))
        raw = _bytes(t.column("point").combine_chunks())
        points, fine = _counts(raw), raw[:, GROUPS:]
        left = np.flatnonzero(block == block.min())
        right = np.flatnonzero(block == block.max())
        tree, same, a, b = Tree(points[right], n[right]), block.min() == block.max(), [], []
        for q in left:
            near = right[tree.near(points[q], int(n[q]), percent)]
            near = near[label[near] != label[q]]
            near = near[(100 + percent) * _fine_bound(fine[near], fine[q][None, :], n[near], n[q]) >= percent * (n[near] + n[q])]
            near = cls[near[cls[near] > cls[q]]] if same else cls[near]
            a += [cls[q]] * len(near)
            b += near.tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        pairs = np.zeros((0, 2), np.int64)  # a pair comes once from a task, however many keys have it

        def row_batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            more = [pairs]
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if end == begin:
                    continue
                if held and tuple(ids[begin]) != now:
                    more.append(compare(held))
                    held = []
                now = tuple(ids[begin])
                held.append(batch.slice(begin, end - begin))
            pairs = np.unique(np.concatenate(more), axis=0)
            if len(pairs) >= HELD:
                yield row_batch()
                pairs = pairs[:0]
        if held:
            pairs = np.unique(np.concatenate([pairs, compare(held)]), axis=0)
        yield row_batch()

    # one block against another without rows of it compares a block with itself once more, which adds no wrong pair
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


class Links:
    """Links verified so far and the labels (node, root) they give; pairs inside a label need no verification."""

    def __init__(self, docs: DataFrame, members: DataFrame, points: DataFrame, text: str, size: int, percent: int):
        self.docs, self.members, self.points, self.text, self.size, self.percent = docs, members, points, text, size, percent
        self.found, self.roots = None, None

    def label(self, classes: DataFrame, column: str = "class") -> DataFrame:
        """Adds the label of a class."""
        if self.roots is None:
            return classes.withColumn("label", F.col(column))
        joined = classes.join(self.roots, classes[column] == self.roots["node"], "left")
        return joined.select(*classes.columns, F.coalesce("root", column).alias("label"))

    def verify(self, pairs: DataFrame) -> bool:
        """Compare the pairs' whole sets and join the labels of linked ones; whether there were any."""
        pairs = stash(pairs, "pairs")  # its size is known then, and small ones are not joined by shuffling points
        links = linked(stash(possible(pairs, self.points, self.percent), "pairs"), self.docs, self.members, self.text, self.size, self.percent)
        if links.isEmpty():
            return False
        self.found = links if self.found is None else self.found.union(links)
        self.roots = components(self.found)
        return True


def link_classes(docs: DataFrame, members: DataFrame, loads: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(node, root): classes that are linked, by whatever chain, with the smallest class of their component.

    Near copies share many keys, so pairs are verified in rounds, and what a round links needs no further pair: first every class
    with the smallest and the largest class of each of its keys (class numbers are hashes, so both are random); then the same with
    two other pivots in the keys that still hold several labels; at last the R-trees.
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(cell_loads(loads))
    window = Window.partitionBy("key")
    shared = stash(class_keys(docs, text, size, percent, order).withColumn("first", F.min("class").over(window)).withColumn("last", F.max("class").over(window))
                   .where("first <> last").distinct(), "keys")
    points = stash(members.join(shared.select("class").distinct(), "class").groupBy("class").agg(F.min("n").alias("n"), F.min("point").alias("point")), "points")
    links = Links(docs, members, points, text, size, percent)
    ends = F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("class").alias("b")), F.struct(F.col("class").alias("a"), F.col("last").alias("b"))))
    stars = stash(shared.select("first", "class", "last").distinct().select(ends.alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "stars")
    links.verify(stars)
    rows = open_rows(links.label(shared.select("key", "class")))
    pivot = F.struct(F.xxhash64("class").alias("mark"), "class", "label")
    pivots = rows.groupBy("key").agg(F.array(F.min(pivot), F.max(pivot)).alias("pivots"))
    pairs = rows.join(pivots, "key").select("class", "label", F.explode("pivots").alias("p")).where("label <> p.label")
    pairs = stash(pairs.select(F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pivots")
    links.verify(pairs)
    rows = unpaired(open_rows(links.label(rows.select("key", "class"))))
    links.verify(survivors(rows, points, percent).join(stars.union(pairs), ["a", "b"], "left_anti"))
    if links.roots is None:
        return spark.createDataFrame([], "node bigint, root bigint")
    return links.roots


def unpaired(rows: DataFrame) -> DataFrame:
    """The rows (key, class, label), stored, without the smallest and largest class and the pivots of each key, which were compared with
    every other class of it; what is left of a key must still hold several labels."""
    mark = F.struct(F.xxhash64("class").alias("mark"), "class")
    ends = rows.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    left = stash(rows.join(ends, "key").where("class not in (first, last, low.class, high.class)").select("key", "class", "label"), "open")
    several = left.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    return left.join(several, "key")


def open_rows(labelled: DataFrame) -> DataFrame:
    """The rows (key, class, label), stored, of keys of more than two classes with several labels; keys with the same classes count once."""
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    rows = stash(labelled.join(several, "key").select("key", "class", "label"), "open")
    mark = F.xxhash64("class")
    once = (rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"), F.min("class").alias("least"), F.max("class").alias("most"))
            .groupBy("n", "sum", "xor", "least", "most").agg(F.min("key").alias("key")).select("key"))
    return stash(rows.join(once, "key").select("key", "class", "label"), "open")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable by links)."""
    members, loads = classes(docs, key, text, size)
    roots = stash(link_classes(docs, members, loads, text, size, percent), "roots")
    first = members.where("class is not null").groupBy("class").agg(F.min("key").alias("first"))
    first = first.join(roots, first["class"] == roots["node"], "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(least, "root").select("class", "component_id")
    return members.join(named, "class", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked ones: that with the smallest key that is not null; of rows with equal keys any one."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, row, text).join(rows.select(row, F.col(key).alias("key")), row)
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)

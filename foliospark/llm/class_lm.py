"""Class-based bigram language model: words belong to classes, found by exchange clustering.

All training texts are counted by Spark.  The `UNITS` most frequent words are the seed; every other word belongs at first to
the unit of its shape (its last two bytes, hashed to `SHAPES` units).  Bigram counts of units are summed over all training texts.
The exchange method then moves one unit after the other to the class where the likelihood of the class bigram model is largest,
until a whole sweep moves none or `sweeps` are done.  Then every further word that occurs `LEAST` times or more leaves its shape
for the class that its own neighbours make most likely, by counts of (word, class of the neighbour) over all training texts; the
words with their classes are a stored table that grows with the vocabulary.  Transitions are counted again with all classes.

P(text) = product of P(class | class before) P(word | class), with the end of the text as the last word; a word below `LEAST`
has P(shape | class) P(word | shape).  Transitions and words are smoothed by additive constants; a word never seen has a share of
its shape's unit, so every text has a finite probability.  Counts and classes are exact for every word: those of the `COMMON`
most frequent words are sent to the tasks, all others are joined.

Defined results: a null or empty text is one end; repeated rows are counted and scored each; with no training texts all words
are unknown; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import slices, stash

UNITS = 800
SHAPES = 150
CLASSES = 48
LEAST = 5                # occurrences from which a word has a class of its own
PAIRS = 1_000_000        # neighbours or pairs that a task counts before it hands the counts on
COMMON = 150_000         # at most
HELD = 300_000           # words that a task counts before it hands the counts on
BETA, DELTA = 0.1, 0.1   # added to transition and word counts
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # separators are the six ASCII ones


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - 2**63


def shape(word: bytes) -> int:
    """The unit of a word that is not a unit of its own; unit 0 is the end of a text."""
    return 1 + UNITS + (xxhash.xxh32_intdigest(word[-2:]) % SHAPES)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, word, shape, count) of all words, a stored table; the end is not among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            words = list(counts)
            out = [pa.array([word_key(w) for w in words], pa.int64()), pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                   pa.array([shape(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["key", "word", "shape", "count"])

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for value in part.column("text").to_pylist():
                    counts.update(tokens(value))
                if len(counts) >= HELD:
                    yield flushed()
        if counts:
            yield flushed()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "key bigint, word string, shape int, count bigint")
    return stash(counted.groupBy("key", "shape").agg(F.min("word").alias("word"), F.sum("count").alias("count")), "words")


class _Units(dict):
    """Unit of a word."""

    def __missing__(self, word: bytes) -> int:
        return shape(word)


def unit_bigrams(docs: DataFrame, units: dict[bytes, int], text: str = "text") -> np.ndarray:
    """Counts of unit after unit over all texts, each with an end before and after: a matrix of fixed size."""
    size = 1 + UNITS + SHAPES
    sent = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(size * size, np.int64), _Units(sent.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                line = [0]
                for value in part.column("text").to_pylist():
                    line += map(known.__getitem__, tokens(value))
                    line.append(0)
                line = np.array(line, np.int64)
                found, n = np.unique(line[:-1] * size + line[1:], return_counts=True)
                counts[found] += n
        rows = counts.reshape(size, size)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["unit", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit, counts in zip(batch.column("unit").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[unit] = sums.get(unit, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["unit", "counts"])

    kind = "unit bigint, counts binary"
    out = np.zeros((size, size), np.int64)
    for row in docs.select(F.col(text).alias("text")).mapInArrow(run, kind).repartition("unit").mapInArrow(add, kind).collect():  # one row for each unit
        out[row["unit"]] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, sweeps: int = 8) -> np.ndarray:
    """The class of each unit, by moving units while the class bigram likelihood grows.  Unit 0 keeps class 0 for itself."""
    size = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != 0]
    cls = np.zeros(size, np.int64)
    cls[order] = 1 + np.arange(size - 1) % (n_classes - 1)
    part = np.zeros((size, n_classes))
    part[np.arange(size), cls] = 1
    table = part.T @ bigrams @ part
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            out, into, own, old = bigrams[w] @ part, bigrams[:, w] @ part, float(bigrams[w, w]), cls[w]
            out[old] -= own
            into[old] -= own
            # the table without w, then the gain of adding w to each class k
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            left, right = table.sum(axis=1) + into, table.sum(axis=0) + out  # what each class counts, transitions with w included
            gain = (xlogx(table + out[None, :]) - xlogx(table)).sum(axis=1) + (xlogx(table + into[:, None]) - xlogx(table)).sum(axis=0)
            both = np.diag(table)
            gain += xlogx(both + out + into + own) - xlogx(both + out) - xlogx(both + into) + xlogx(both)
            gain -= xlogx(left + out.sum() + own) - xlogx(left) + xlogx(right + into.sum() + own) - xlogx(right)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            part[w, old], part[w, new], cls[w] = 0, 1, new
            moved += new != old
        if not moved:
            break
    return cls


@dataclass
class Model:
    """Classes of the units and base-10 logarithms: transition between classes, unit in its class, the sum that a shape's word
    counts are divided by, and all of a class.  common has class and count of each common word, emit its logarithm in its class;
    whole says that no word outside common has a class of its own."""

    common: dict[bytes, tuple[int, int]]
    emit: np.ndarray
    whole: bool
    cls: np.ndarray
    transition: np.ndarray
    unit: np.ndarray
    shape_sum: np.ndarray
    mass: np.ndarray
    total: int
    distinct: int


class _Places(dict):
    """Place of a common word, from 1; another word's shape, negative."""

    def __missing__(self, word: bytes) -> int:
        return -shape(word)


def common_words(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """The words above the lowest count step that leaves at most `most` of them; steps are sixteenths of a doubling.

    A sorted limit would bring that many words of every task to the driver.
    """
    step = F.floor(F.log2("count") * 16).cast("int")
    least, held = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):  # a thousand at most
        held += row["words"]
        if held > most:
            break
        least = row["step"]
    return counts.where(step >= least if least is not None else F.lit(False)).select("key", "word", "shape", "count")


def neighbours(docs: DataFrame, units: dict[bytes, int], cls: np.ndarray, only: set[bytes] | None, text: str = "text") -> DataFrame:
    """(key, codes, counts): how often which class stands before (code: class) and after (CLASSES + class) a word that is no seed,
    as bytes; one word may have several rows.  only: the words that are asked for, or all."""
    sent = docs.sparkSession.sparkContext.broadcast((units, cls, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, cls, only = sent.value
        known, places, held, n_held = _Units(units), {}, [], 0

        def flushed() -> pa.RecordBatch:
            codes, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.uint32)
            words, begin = np.unique(codes // (2 * CLASSES), return_index=True)
            end, code, all_words = [*begin[1:].tolist(), len(codes)], (codes % (2 * CLASSES)).astype(np.uint8), list(places)
            out = [pa.array([word_key(all_words[w]) for w in words.tolist()], pa.int64()), *(pa.array([x[b:e].tobytes() for b, e in zip(begin.tolist(), end, strict=True)], pa.binary()) for x in (code, sums))]
            held.clear()
            places.clear()
            return pa.RecordBatch.from_arrays(out, ["key", "codes", "counts"])

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                line, words = [0], [b""]
                for value in part.column("text").to_pylist():
                    found = tokens(value)
                    line += map(known.__getitem__, found)
                    line.append(0)
                    words += found
                    words.append(b"")
                line = np.array(line, np.int64)
                at = [i for i in np.flatnonzero(line > UNITS).tolist() if only is None or words[i] in only]
                place = np.array([places.setdefault(words[i], len(places)) for i in at], np.int64) * (2 * CLASSES)
                at, classes = np.array(at, np.int64), cls[line]
                if len(at):
                    held.append(np.unique(np.concatenate([place + classes[at - 1], place + CLASSES + classes[at + 1]]), return_counts=True))
                    n_held += len(held[-1][0])
                if n_held >= PAIRS:
                    yield flushed()
                    n_held = 0
        if held:
            yield flushed()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key bigint, codes binary, counts binary")


def assign(words: DataFrame, found: DataFrame, table: np.ndarray) -> DataFrame:
    """(key, shape, count, class), a stored table: the best class of every word (key, shape, count) by its neighbours and the
    class bigrams."""
    ratio = np.log(table) - np.log(table.sum(axis=1, keepdims=True)) - np.log(table.sum(axis=0, keepdims=True))
    gains = np.concatenate([ratio, ratio.T])  # of a class after, then before, each of the neighbours' classes
    gains[:, 0] = -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("found").to_pylist():
                codes = np.concatenate([np.frombuffer(r["codes"], np.uint8) for r in row])
                counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in row]).astype(np.float64)
                out.append(int(np.argmax((counts[:, None] * gains[codes]).sum(axis=0))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "shape", "count")), pa.array(out, pa.int32())], ["key", "shape", "count", "class"])

    grouped = found.join(words.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("codes", "counts")).alias("found"))
    return stash(grouped.join(words, "key").select("key", "shape", "count", "found").mapInArrow(run, "key bigint, shape int, count bigint, class int"), "word-classes")


def _own_class(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (a, b, code, ...) of neighbours, code = 4 (CLASSES x + y) + 2 [a is a word key] + [b is one], x and y their classes
    by shape; x and y become the classes that the words have of their own.  An end that is no key has any number."""
    one = pairs.withColumns({"cell": F.expr("code div 4").cast("int"), "left": F.col("code").bitwiseAND(2) != 0, "right": F.col("code").bitwiseAND(1) != 0})
    for end, asked in (("a", "left"), ("b", "right")):
        known = words.select(F.col("key").alias(f"{end}_key"), F.col("class").alias(f"{end}_class"))
        one = one.join(known, (F.col(end) == F.col(f"{end}_key")) & F.col(asked), "left")
    return one.withColumns({"x": F.coalesce("a_class", F.expr(f"cell div {CLASSES}").cast("int")), "y": F.coalesce("b_class", F.expr(f"cell % {CLASSES}"))})


def _rare_pairs(words: list[bytes], at: np.ndarray, classes: np.ndarray) -> Counter:
    """Counts of (a, b, code) over the neighbours of which one is no common word; words, places and classes of a line."""
    rare = at < 0
    out: Counter = Counter()
    for i in np.flatnonzero(rare[:-1] | rare[1:]).tolist():
        left, right = bool(rare[i]), bool(rare[i + 1])
        a, b = word_key(words[i]) if left else None, word_key(words[i + 1]) if right else None
        out[a if left else b, b if right else a, 4 * (CLASSES * int(classes[i]) + int(classes[i + 1])) + 2 * left + right] += 1
    return out


def class_bigrams(docs: DataFrame, common: dict[bytes, int], cls: np.ndarray, whole: bool, words: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of class after class over all texts, with the classes of all words.  common: the classes of common words."""
    sent = docs.sparkSession.sparkContext.broadcast((common, cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cls = sent.value
        places, class_of = _Places({w: i + 1 for i, w in enumerate(common)}), np.array([0, *common.values()], np.int64)
        counts, pairs = np.zeros(CLASSES * CLASSES, np.int64), Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in pairs], pa.int64()) for i in range(3)), pa.array(list(pairs.values()), pa.int64())], ["a", "b", "code", "n"])
            pairs.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                at, line = [0], [b""]
                for value in part.column("text").to_pylist():
                    found = tokens(value)
                    at += map(places.__getitem__, found)
                    at.append(0)
                    line += found
                    line.append(b"")
                at = np.array(at, np.int64)
                classes = np.where(at >= 0, class_of[np.maximum(at, 0)], cls[np.maximum(-at, 0)])
                cells = classes[:-1] * CLASSES + classes[1:]
                if not whole:
                    pairs.update(_rare_pairs(line, at, classes))
                    cells = cells[(at[:-1] >= 0) & (at[1:] >= 0)]
                counts += np.bincount(cells, minlength=len(counts))
                if len(pairs) >= PAIRS // 4:
                    yield flushed()
        some = np.flatnonzero(counts)
        pairs.update({(0, 0, 4 * int(c)): int(counts[c]) for c in some})
        yield flushed()

    rows = stash(docs.select(F.col(text).alias("text")).mapInArrow(run, "a bigint, b bigint, code bigint, n bigint"), "class-pairs")
    fixed = rows.where("code % 4 = 0").select(F.expr(f"cast(code div 4 div {CLASSES} as int)").alias("x"), F.expr(f"cast(code div 4 % {CLASSES} as int)").alias("y"), "n")
    if not whole:
        fixed = fixed.union(_own_class(rows.where("code % 4 <> 0"), words).select("x", "y", "n"))
    out = np.zeros((CLASSES, CLASSES))
    for row in fixed.groupBy("x", "y").agg(F.sum("n").alias("n")).collect():  # one row for each pair of classes
        out[row["x"], row["y"]] = row["n"]
    return out


def fit_words(docs: DataFrame, counts: DataFrame, text: str = "text", most: int = COMMON) -> tuple[Model, DataFrame]:
    """The model of the training documents, and the stored table (key, shape, count, class) of the words with a class of their own
    besides the seed; counts: their word_counts."""
    ends = docs.count()
    top = sorted(common_words(counts, most).collect(), key=lambda r: (-r["count"], r["word"]))
    encoded = [(r["word"].encode("utf-8", "surrogatepass"), r["shape"], r["count"]) for r in top]
    units = {w: 1 + i for i, (w, _, _) in enumerate(encoded[:UNITS])}
    bigrams = unit_bigrams(docs, units, text)
    cls = exchange(bigrams)
    part = np.zeros((len(cls), CLASSES))
    part[np.arange(len(cls)), cls] = 1
    seed = counts.sparkSession.createDataFrame([(word_key(w),) for w in units] or [(0,)], "key bigint").limit(len(units))
    further = counts.where(F.col("count") >= LEAST).join(F.broadcast(seed), "key", "left_anti").select("key", "shape", "count")
    known = {w for w, _, n in encoded[UNITS:] if n >= LEAST}
    whole = further.count() == len(known)
    words = assign(further, neighbours(docs, units, cls, known if whole else None, text), part.T @ bigrams @ part + BETA)
    # classes of the common words: a seed's, their own, or their shape's
    keys = common_words(counts, most).select("word", "key") if known else None
    own_class = {r["word"]: r["class"] for r in keys.join(words.select("key", "class"), "key").select("word", "class").collect()} if known else {}
    class_of = {w: int(cls[units[w]]) if w in units else own_class.get(w.decode("utf-8", "surrogatepass"), int(cls[kind])) for w, kind, _ in encoded}
    table = class_bigrams(docs, class_of, cls, whole, words, text) + BETA
    transition = np.log10(table / table.sum(axis=1, keepdims=True))
    # a shape's words: those that have no class of their own; one more stands for all that were never seen
    own, weight, more = np.zeros((len(cls), 2)), bigrams.sum(axis=0) + DELTA, np.zeros(CLASSES)
    for row in counts.groupBy("shape").agg(F.sum("count").alias("sum"), F.count("*").alias("words")).collect():  # one row for each shape
        own[row["shape"]] += (row["sum"], row["words"])
    for _, kind, count in encoded[:UNITS]:
        own[kind] -= (count, 1)
    for row in words.groupBy("shape", "class").agg(F.sum("count").alias("sum"), F.count("*").alias("words")).collect():  # one row for each of both
        own[row["shape"]] -= (row["sum"], row["words"])
        weight[row["shape"]] -= row["sum"]
        more[row["class"]] += row["sum"] + DELTA * row["words"]
    mass = part.T @ weight + more
    unit = np.log10(weight / mass[cls])
    shape_sum, mass = np.log10(own[:, 0] + DELTA * (own[:, 1] + 1)), np.log10(np.maximum(mass, DELTA))
    emit = [unit[units[w]] if w in units else np.log10(n + DELTA) - mass[class_of[w]] if n >= LEAST else unit[kind] + np.log10(n + DELTA) - shape_sum[kind] for w, kind, n in encoded]
    total = counts.agg(F.sum("count"), F.count("*")).first()
    common = {w: (class_of[w], count) for w, _, count in encoded}
    return Model(common, np.array(emit), whole, cls, transition, unit, shape_sum, mass, (total[0] or 0) + ends, total[1] + (ends > 0)), words


def fit(docs: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    """The model alone."""
    return fit_words(docs, counts, text)[0]


def score(docs: DataFrame, counts: DataFrame, model: Model, words: DataFrame, ends: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms).  ends: training documents."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "id", "n_tokens", "n_known", "base", "score", "rare", "times", "a", "b", "code", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        m, number = sent.value, TaskContext.get().partitionId() << 40
        places = _Places({w: i + 1 for i, w in enumerate(m.common)})
        class_of = np.array([0, *[c for c, _ in m.common.values()]], np.int64)
        count_of = np.array([ends, *[n for _, n in m.common.values()]], np.float64)
        base_of, emit_of, by_shape = np.log10(count_of + 1), np.array([m.unit[0], *m.emit]), m.unit - m.shape_sum
        less = np.log10(m.total + m.distinct + 1)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows: list[tuple] = []
                for value in part.column("text").to_pylist():
                    found = tokens(value)
                    at = np.array([*map(places.__getitem__, found), 0], np.int64)
                    known = at >= 0
                    classes = np.where(known, class_of[np.maximum(at, 0)], m.cls[np.maximum(-at, 0)])
                    line = np.concatenate([[0], classes])
                    seen = at[known]
                    fixed = m.transition[line[:-1], line[1:]].sum() + emit_of[seen].sum() + by_shape[-at[~known]].sum()
                    rare = Counter([found[i] for i in np.flatnonzero(~known).tolist()])
                    pairs = {} if m.whole or not rare else _rare_pairs([b"", *found, b""], np.concatenate([[0], at]), line)
                    rows.append((len(at), int((count_of[seen] > 0).sum()), base_of[seen].sum() - len(at) * less, fixed, [word_key(w) for w in rare], list(rare.values()),
                                 *([k[i] for k in pairs] for i in range(3)), list(pairs.values())))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 6)
                ids = pa.array(np.arange(number, number + len(rows)))
                number += len(rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    local = stash(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<bigint>, a array<bigint>, b array<bigint>, code array<bigint>, pairs array<bigint>"), "scores")
    rare = local.select("id", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("id", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    # words that were never seen add log10(DELTA) to the score and nothing else; only the rest need the join
    lexicon, change = counts.select("key", "shape", "count"), F.log10(F.col("count") + DELTA) - F.log10(F.lit(DELTA))
    if not model.whole:
        shapes = spark.createDataFrame([(i, float(u - s)) for i, (u, s) in enumerate(zip(model.unit, model.shape_sum, strict=True))], "shape int, by_shape double")
        masses = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.mass)], "class int, mass double")
        lexicon = lexicon.join(words.select("key", "class"), "key", "left").join(F.broadcast(shapes), "shape").join(F.broadcast(masses), "class", "left")
        change = change - F.coalesce(F.col("mass") + F.col("by_shape"), F.lit(0.0))
    lexicon = lexicon.select(F.col("key").alias("word"), "count", change.alias("change"))
    seen = rare.join(lexicon, "word").groupBy("id").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("more_base"), F.sum(F.col("times") * F.col("change")).alias("more_score"))
    out = local.join(seen, "id", "left")
    moves = F.lit(0.0)
    if not model.whole:
        steps = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.transition.ravel())], "step int, log double")
        pairs = local.select("id", F.explode(F.arrays_zip("a", "b", "code", "pairs")).alias("r")).select("id", "r.*")
        moved = _own_class(pairs, words).where("a_class is not null or b_class is not null").withColumn("step", F.col("x") * CLASSES + F.col("y"))
        moved = moved.join(F.broadcast(steps), "step").join(F.broadcast(steps.toDF("cell", "old")), "cell")
        out, moves = out.join(moved.groupBy("id").agg(F.sum(F.col("pairs") * (F.col("log") - F.col("old"))).alias("moves")), "id", "left"), F.coalesce("moves", F.lit(0.0))
    unseen = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x) * F.log10(F.lit(DELTA))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(F.col("key").alias(key), "n_tokens", (F.col("n_known") + zero("known")).cast("bigint").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                      (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + unseen + zero("more_score") + moves).alias("score"))


def score_corpus(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", most: int = COMMON) -> DataFrame:
    """Every document scored by the model of those that `training` allows."""
    learnt = docs.where(training)
    counts = word_counts(learnt, text)
    model, words = fit_words(learnt, counts, text, most)
    return score(docs, counts, model, words, learnt.count(), key, text)

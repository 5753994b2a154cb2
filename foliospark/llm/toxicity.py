"""Toxicity by subword bags: character n-gram vectors averaged into words, words averaged into a linear softmax.

A word's vector is the mean of the vectors of its character 3- to 5-grams, with marks at both ends, so an unseen spelling
shares those of the spellings it resembles.  A bag is a passage of `BAG` words; its mean word vector goes through a softmax
over the two labels, and vectors and softmax are trained together by gradient steps in numpy.  A document's label belongs to
its worst passage: training starts from the passages with the most telling n-grams and then, in rounds, from those the model
itself finds worst; a document's score is that of its worst passage, so long texts do not dilute it.

The classifier is fitted on a bounded sample: at most `most_docs` labelled documents of each label with at most `most_chars`
characters, those with the smallest hash of their id.  Scoring covers every whole text and uses nothing but the text.

Defined results: a null or empty text, or one without letters, gets the score of an empty bag; equal texts get equal scores;
with labels of one kind only, every score is 0 (none toxic) or 1 (all toxic); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import slices

SIZES = (3, 4, 5)
BITS = 17
WIDTH = 8
BAG = 3
STRIDE = 1
RARE = 20.0
CHUNK = 100


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)] + [False])


def words_and_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts at once: the text of each word, then for each n-gram size in turn its bucket and its word; and n-grams per word."""
    joined = ["\n" + (t or "").lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(j) for j in joined])
    letter = _letters()[np.minimum(codes, 1 << 16)]
    codes = np.where(letter, codes, np.uint32(1))
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    word = np.cumsum(letter & ~np.concatenate([[False], letter[:-1]])) - 1  # of each character; a separator has that before it
    buckets, owners = [], []
    n, total = len(codes), codes * np.uint32(0x9E3779B1)
    for size in range(2, max(SIZES) + 1):
        total = total[:n - size + 1] * np.uint32(31) + codes[size - 1:] * np.uint32(0x85EBCA6B) if n >= size else total[:0]
        if size in SIZES and len(total):
            inside = np.ones(len(total), bool)
            for j in range(1, size - 1):
                inside &= letter[j:j + len(total)]
            at = np.flatnonzero(inside)
            h = total[at] + np.uint32(size)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
            buckets.append(h >> np.uint32(32 - BITS))
            owners.append(word[at + 1])
    bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.uint32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return np.searchsorted(ends, starts, "right"), bucket, owner, np.bincount(owner, minlength=len(starts))


@dataclass
class Model:
    """weight: what each n-gram bucket adds to the log odds of the toxic label (vectors times the softmax's difference)."""

    weight: np.ndarray
    bias: float

    def words(self, bucket: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The mean over the n-grams of each word."""
        return np.bincount(owner, self.weight[bucket], minlength=len(count)) / np.maximum(count, 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        text, bucket, owner, count = words_and_grams(texts)
        odds, _ = worst_bags(self.words(bucket, owner, count), text, len(texts))
        return 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(odds), odds, 0.0) + self.bias, -60, 60)))


def worst_bags(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the largest mean of a bag of consecutive words (-inf without words), and where that bag begins."""
    counts = np.bincount(text, minlength=n_texts)
    begin = np.cumsum(counts) - counts
    sums = np.concatenate([[0.0], np.cumsum(values)])
    best, where = np.full(n_texts, -np.inf), np.zeros(n_texts, np.int64)
    place = np.arange(len(values)) - begin[text]
    starts = np.flatnonzero((place % STRIDE == 0) & ((place + BAG <= counts[text]) | (place == 0) | (place == np.maximum(0, (counts[text] - BAG + STRIDE - 1) // STRIDE * STRIDE))))
    stops = np.minimum(starts + BAG, (begin + counts)[text[starts]])
    means = (sums[stops] - sums[starts]) / (stops - starts)
    order = np.lexsort((-means, text[starts]))
    first = order[np.unique(text[starts][order], return_index=True)[1]] if len(order) else order
    best[text[starts[first]]], where[text[starts[first]]] = means[first], starts[first]
    return best, where


def train(texts: list[str], toxic: list[int], rounds: int = 6, epochs: int = 6, rate: float = 0.3, seed: int = 6) -> Model:
    """Vectors and softmax from labelled texts."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 60.0 if len(y) and y[0] else -60.0)
    parts, having = [], np.zeros((2, 1 << BITS))
    for at in range(0, len(texts), CHUNK):  # n-grams in the order of their words, some texts at a time
        text, bucket, owner, count = words_and_grams(texts[at:at + CHUNK])
        seen = np.unique(text[owner] * (1 << BITS) + bucket)
        for k in (0, 1):
            having[k] += np.bincount(seen[y[at + (seen >> BITS)] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        parts.append((text + at, bucket[np.argsort(owner, kind="stable")], count.astype(np.int32)))
    text, bucket, count = (np.concatenate(p) for p in zip(*parts, strict=True))
    lengths = [len(p[1]) for p in parts]
    counts_of = [p[2] for p in parts]
    del parts
    word_start = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])

    def word_values(model: Model) -> np.ndarray:
        return np.concatenate([model.words(bucket[e - n:e], np.repeat(np.arange(len(c)), c), c) for e, n, c in zip(np.cumsum(lengths), lengths, counts_of, strict=True)])

    # the first passages: by the log odds that texts of either label have an n-gram, drawn towards 0 for rare ones
    share = y.mean()
    model = Model(np.log((having[1] + RARE * share) / y.sum()) - np.log((having[0] + RARE * (1 - share)) / (1 - y).sum()), 0.0)
    counts = np.bincount(text, minlength=len(y))
    begin = np.cumsum(counts) - counts
    random = np.random.default_rng(seed)
    # vectors start at 0, so n-grams that were never seen say nothing; the softmax starts with two opposite directions
    vectors, direction = np.zeros((1 << BITS, WIDTH), np.float32), random.normal(0, 1, WIDTH).astype(np.float32)
    softmax, bias = np.stack([-direction, direction], axis=1), np.zeros(2, np.float32)
    past, past_soft = np.full(1 << BITS, 1e-8, np.float32), np.full((WIDTH, 2), 1e-2, np.float32)
    for _ in range(rounds):
        _, worst = worst_bags(word_values(model), text, len(y))
        has = np.flatnonzero(counts > 0)
        other = has[y[has] == 0]  # of clean texts also a passage at random
        bag_start = np.concatenate([worst[has], begin[other] + (random.random(len(other)) * np.maximum(1, counts[other] - BAG)).astype(np.int64)])
        bag_text = np.concatenate([has, other])
        bag_stop = np.minimum(bag_start + BAG, (begin + counts)[bag_text])
        label = y[bag_text]
        for _ in range(epochs):
            shuffled = random.permutation(len(bag_text))
            for some in np.array_split(shuffled, max(1, len(shuffled) // 128)):
                sizes = bag_stop[some] - bag_start[some]
                bag_of_word = np.repeat(np.arange(len(some)), sizes)
                words = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bag_start[some], sizes)
                n = np.maximum(count[words], 1)
                grams = bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(word_start[words], n)]
                part = np.repeat((1.0 / (n * sizes[bag_of_word])).astype(np.float32), n)
                bag = np.repeat(bag_of_word, n)
                first = np.searchsorted(bag, np.arange(len(some)))
                mean = np.add.reduceat(vectors[grams] * part[:, None], first)
                logits = mean @ softmax + bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), label[some]] -= 1
                to_bag = (p @ softmax.T).astype(np.float32)
                order = np.argsort(grams, kind="stable")
                unique, first = np.unique(grams[order], return_index=True)
                step = np.add.reduceat(to_bag[bag[order]] * part[order][:, None], first)
                past[unique] += (step ** 2).mean(axis=1)
                vectors[unique] -= rate * step / np.sqrt(past[unique])[:, None]
                step = mean.T @ p / len(some)
                past_soft += step ** 2
                softmax -= rate * step / np.sqrt(past_soft)
                bias -= rate * p.mean(axis=0)
        model = Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
        most_docs: int = 2000, most_chars: int = 8_000) -> Model:
    """The model of the labelled documents that `learn` (a condition on the key) allows."""
    marked = labels.where(F.col(label).isNotNull() & learn).groupBy(key).agg(F.max(label).alias("toxic"))
    texts = docs.where(learn & F.col(text).isNotNull() & (F.length(text) <= most_chars)).select(F.col(key), F.col(text).alias("text"))
    chosen = marked.union(marked.limit(0))
    rows = []
    for kind in (0, 1):
        some = chosen.where(F.col("toxic") == kind).orderBy(F.xxhash64(key), key).limit(most_docs)
        rows += texts.join(F.broadcast(some), key).select("text", "toxic").collect()  # bounded by most_docs and most_chars
    rows.sort()
    return train([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sent.value.score(part.column("text").to_pylist()), pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score stays below `least`, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                yield part.filter(pa.array(sent.value.score(part.column(text).to_pylist()) < least))

    return docs.mapInArrow(run, docs.schema)

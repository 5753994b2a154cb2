"""Benchmark passages inside documents, found by one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased, everything but digits, letters and characters beyond ASCII separates).
Each benchmark item gives its windows of `window` consecutive words, a shorter item its whole word sequence.  The windows of
all items form one automaton over word numbers; a document is scanned once, whole, and the words inside any occurrence are
hit.  Runs of hit words are mapped back to character offsets of the original text.

The automaton is sent to the tasks only when the items' texts are within `shard_bytes`; a larger benchmark is cut into
shards of that size, scanned one after the other over a stored table that carries the hits found so far.

Defined results: a null or empty text, or one without words, has no hits and is clean; items without words match nothing;
repeated items and repeated windows count once per item id, all items without an id as one item, null and last in the list; an empty benchmark leaves all documents clean; the input's other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import slices, stash

WINDOW = 13
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_STATE = "n_words bigint, hits array<struct<first: bigint, last: bigint>>, items array<string>, spans array<struct<start: bigint, end: bigint>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0  # no window contains it


class Windows:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick
        self.numbers, owners = _Numbers(), {}
        for item, text in items:
            found = words(text)
            for i in range(max(1, len(found) - window + 1) if found else 0):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in found[i:i + window])
                owners.setdefault(key, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), who))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Runs (first, last) of hit words, and the items with an occurring window."""
        runs, items = [], set()
        if not self.any:
            return runs, items
        for end, (length, who) in self.automaton.iter(tuple(map(self.numbers.__getitem__, found))):
            runs.append((end - length + 1, end))
            items |= who
        return runs, items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not runs:
        return []
    at = np.array([m.span() for m in _WORD.finditer(text)])
    return [(int(at[a][0]), int(at[b][1])) for a, b in runs]


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shard_bytes: int = 1 << 20) -> DataFrame:
    """Per document: key, n_words, hits (runs of word numbers), items (sorted ids), spans (character offsets)."""
    items, shards = _items(benchmark, item, item_text, shard_bytes)
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard) if shards > 1 else items
        state = _scan(state, docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()]), window, kind, last=shard == shards - 1)
        if shard < shards - 1:
            state = stash(state, "passages")
    return state.withColumnRenamed("key", key)


def _items(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", shard_bytes: int = 1 << 20) -> tuple[DataFrame, int]:
    """Item ids and texts, and how many shards of bounded size they make."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    return items, max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))


def _scan(state: DataFrame, items, window: int, kind: str, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            made = made or Windows(items.value, window)
            for part in slices(batch, "text"):
                counts, hits, found_items, spans = [], [], [], []
                texts = part.column("text").to_pylist()
                before = ([(h, i) for h, i in zip(part.column("hits").to_pylist(), part.column("items").to_pylist(), strict=True)]
                          if "hits" in part.schema.names else [([], [])] * len(texts))
                for value, (old, old_items) in zip(texts, before, strict=True):
                    found = words(value)
                    runs, who = made.scan(found)
                    runs = _merged(runs + [(h["first"], h["last"]) for h in old])
                    counts.append(len(found))
                    hits.append([{"first": a, "last": b} for a, b in runs])
                    found_items.append(sorted(who | set(old_items), key=lambda i: (i is None, i or "")))
                    spans.append([{"start": a, "end": b} for a, b in _offsets(value, runs)] if last else [])
                columns = [part.column("key")] + [part.column("text")] * (not last) + [
                    pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array(found_items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, ["key"] + ["text"] * (not last) + ["n_words", "hits", "items", "spans"])

    return state.mapInArrow(run, f"key {kind}, " + "text string, " * (not last) + _STATE)


def n_hit() -> Column:
    """Number of hit words, from the runs."""
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, h: total + h["last"] - h["first"] + 1)


def is_contaminated() -> Column:
    """At least one word in twenty lies inside a benchmark window."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that are clean, with all their columns; each row is judged by its own text."""
    items, shards = _items(benchmark)
    if shards > 1:  # the hits of all shards are needed together
        rows = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        bad = find_passages(rows, benchmark, key="__row", text=text, window=window).where(is_contaminated()).select("__row")
        return rows.join(bad, "__row", "left_anti").drop("__row")
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            made = made or Windows(sent.value, window)
            for part in slices(batch, text):
                keep = []
                for value in part.column(text).to_pylist():
                    found = words(value)
                    hit = sum(last - first + 1 for first, last in _merged(made.scan(found)[0]))
                    keep.append(not hit or 20 * hit < len(found))
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Alignment of the token ids that two tokenizers give for the same text, and how usual each linked pair of ids is in the corpus.

The ids of a text become cumulative byte ends, each kept in a dictionary from end to index.  The ends that both dictionaries have,
sorted, slice both id lists into groups.  Inside a slice every two tokens whose byte ranges overlap are linked: as no end inside is
shared, there is one link for each stretch between two neighbouring ends of either side.

A pair's count is the number of rows that hold it linked.  Tasks sum counts before the shuffle.  Rows are scored by the counts of the
most usual pairs, sent to the tasks (at most COMMON pairs), and the links of all other pairs are joined with theirs.

Defined results: a null or empty text, and one whose tokens do not give back the space and the text, has no tokens, groups and links;
strings of special tokens are plain text; equal and repeated rows count as rows each; an id's highest count may be reached by
several pairs, which then all are best; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import Encoder, byte_letters
from .work import slices, stash

COMMON = 1 << 18   # pairs whose counts are sent to tasks
FLUSH = 1 << 22    # links held before a task sums them
SHIFT = 1 << 16    # a pair's number: first id x SHIFT + second id, in 32 bits
NOTHING = (0, 0, 0, "", b"")


class FirstTokens:
    """Ids and bytes of tokens by a byte-level file of the tokenizers library, read as plain text."""

    def __init__(self, path: str, longest: int = 64):
        self.longest = longest
        self.encoder = Encoder(path, 50_000)
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.special = []
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        pattern, words = self.encoder.pattern, self.encoder.words.__getitem__
        if pattern is None or any(map(self.encoder.odd.search, texts)):
            return [array("I", self.encoder.ids(" " + t)[:-4]).tolist() for t in texts]
        return [array("I", b"".join(map(words, pattern.findall(" " + t)))).tolist() if len(t) > self.longest else self._new(pattern.findall(" " + t)) for t in texts]

    def _new(self, words: list[str]) -> list[int]:
        """Ids of words that hardly come again, so that no table keeps them."""
        table = self.encoder.words
        spelt = [w.translate(table.ascii) if w.isascii() else "".join([table.letters[b] for b in w.encode()]) for w in words]
        return [token.id for w in spelt for token in table.model.tokenize(w)]


class SecondTokens:
    """Ids and bytes of tokens by a model file of the sentencepiece library, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = lambda i: bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [piece(i) for i in range(self.model.vocab_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


Aligned = tuple[int, int, int, str, bytes]  # numbers of first ids, second ids and groups, groups as text, sorted numbers of the linked pairs


class Aligner:
    """Both tokenizers.  A text without longer white space is cut before its spaces: there the first one's splitting pattern ends, and
    so does the second if no piece has a space behind another character.  Each different word is aligned once while it is among the
    last `most` to twice as many.  Words and uncut texts are aligned together: written one after the other, all end at shared ends."""

    UNCUT = re.compile("^\\s|\\s$| \\s|[\x1c-\x1f\u2581]")  # also what is white space to one library only, and the mark of a space

    def __init__(self, first: str, second: str, most: int = 300_000, longest: int = 64):
        self.sides = FirstTokens(first, longest), SecondTokens(second)
        if max(len(side.bytes) for side in self.sides) > SHIFT:
            raise ValueError(f"vocabularies of at most {SHIFT} ids")
        self.most, self.longest, self.held, self.old = most, longest, {}, {}
        self.sizes = [np.array([len(b) for b in side.bytes]) for side in self.sides]
        self.written = [np.array([[f"{i}{sign}" for i in range(len(side.bytes))] for sign in signs], object) for side, signs in zip(self.sides, (",|", ",;"), strict=True)]
        self.cuts = self.sides[0].encoder.pattern is not None and not any(b" " in b.lstrip(b" ") for b in self.sides[1].bytes)

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """What the tokens of each text give; nothing for texts whose tokens do not give back the space and the text."""
        parts = [([t] if not self.cuts or self.UNCUT.search(t) else t.split(" ")) if t else [] for t in texts]
        known = self._known({word for words in parts for word in words})
        out = [self._joined([known[word] for word in words]) for words in parts]
        failed = [i for i, words in enumerate(parts) if len(words) > 1 and out[i] is NOTHING]
        for i, found in zip(failed, self.whole([texts[i] for i in failed]), strict=True):
            out[i] = found
        return out

    def _known(self, words: set[str]) -> dict[str, Aligned]:
        """The alignments of some words, of those held or new."""
        known = {w: found for w in words if (found := self.held.get(w) or self.old.get(w))}
        new = [w for w in words if w not in known]
        fresh = dict(zip(new, self.whole(new), strict=True))
        if len(self.held) >= self.most:
            self.held, self.old = {}, self.held
        self.held.update((w, f) for w, f in fresh.items() if len(w) <= self.longest)
        known.update(fresh)
        return known

    def _joined(self, found: list[Aligned]) -> Aligned:
        if not found or NOTHING in found:
            return NOTHING
        if len(found) == 1:
            return found[0]
        a, b, groups, written, pairs = zip(*found, strict=True)
        return sum(a), sum(b), sum(groups), ";".join(written), np.sort(_numbers(b"".join(pairs))).tobytes()

    def whole(self, texts: list[str]) -> list[Aligned]:
        """The same for texts that are not cut."""
        if not texts:
            return []
        spelt = [b" " + t.encode() for t in texts]
        ids = [side.ids(texts) for side in self.sides]
        kept = range(len(texts))
        if not self._same(spelt, ids):  # some tokens do not give their text back: look at each text
            kept = [i for i in kept if self._same([spelt[i]], [[side[i]] for side in ids])]
            ids = [[side[i] for i in kept] for side in ids]
        out = [NOTHING] * len(texts)
        if len(kept):
            for i, a, b, (groups, written, pairs) in zip(kept, *ids, self._groups(*ids), strict=True):
                out[i] = (len(a), len(b), groups, written, pairs)
        return out

    def _same(self, spelt: list[bytes], ids: list[list[list[int]]]) -> bool:
        """Whether the tokens of both sides give back each of the texts."""
        whole, ends = b"".join(spelt), np.cumsum([len(s) for s in spelt])
        for side, size, given in zip(self.sides, self.sizes, ids, strict=True):
            flat = list(chain.from_iterable(given))
            if b"".join(map(side.bytes.__getitem__, flat)) != whole:
                return False
            lasts = np.cumsum([len(i) for i in given]) - 1
            if not flat or (lasts < 0).any() or not np.array_equal(size[flat].cumsum()[lasts], ends):
                return False
        return True

    def _groups(self, left: list[list[int]], right: list[list[int]]) -> Iterator[tuple[int, str, bytes]]:
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (left, right))
        a_ends, b_ends = (size[ids].cumsum() for size, ids in zip(self.sizes, (a, b), strict=True))
        a_at, b_at = (dict(zip(ends.tolist(), range(1, len(ends) + 1), strict=True)) for ends in (a_ends, b_ends))
        common = sorted(a_at.keys() & b_at.keys())
        a_cuts, b_cuts = (np.array([at[end] for end in common]) for at in (a_at, b_at))
        # groups as text: a slice's first ids, then its second ones; the last of each has another sign behind it
        a_sign, b_sign = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sign[a_cuts - 1] = b_sign[b_cuts - 1] = 1
        a_place = np.arange(len(a)) + np.repeat(np.concatenate([[0], b_cuts[:-1]]), np.diff(a_cuts, prepend=0))
        b_place = np.arange(len(b)) + np.repeat(a_cuts, np.diff(b_cuts, prepend=0))
        signs = np.empty(len(a) + len(b), object)
        signs[a_place], signs[b_place] = self.written[0][a_sign, a], self.written[1][b_sign, b]
        # links of a slice: one for each stretch between two ends of either side
        ends = np.sort(np.concatenate([a_ends, b_ends]))
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
        pairs = a[np.searchsorted(a_ends, ends)] * SHIFT + b[np.searchsorted(b_ends, ends)]
        a_lasts, b_lasts = (np.cumsum([len(ids) for ids in side]) for side in (left, right))
        text = np.searchsorted(a_ends[a_lasts - 1], ends)
        links = np.sort((text.astype(np.uint64) << np.uint64(32)) | pairs.astype(np.uint64)).astype(np.uint32)
        counts, groups = np.bincount(text, minlength=len(left)), np.diff(np.searchsorted(a_cuts, a_lasts, "right"), prepend=0)
        begin, link, signs, links = 0, 0, signs.tolist(), links.tobytes()
        for end, last, g in zip((a_lasts + b_lasts).tolist(), (4 * np.cumsum(counts)).tolist(), groups.tolist(), strict=True):
            yield g, "".join(signs[begin:end])[:-1], links[link:last]
            begin, link = end, last


@lru_cache(maxsize=2)
def aligner(first: str, second: str) -> Aligner:
    """One aligner for each worker process and pair of files."""
    return Aligner(first, second)


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`) and pairs, the sorted numbers of the linked pairs of ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = aligner(first, second).align(part.column("text").to_pylist())
                counts = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *counts, pa.array([len(f[4]) // 4 for f in found], pa.int64()), pa.array([f[3] for f in found], pa.string()),
                     pa.array([f[4] for f in found], pa.binary())], ["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary")
    return found.withColumnRenamed("key", key)


def _numbers(row: bytes) -> np.ndarray:
    return np.frombuffer(row, np.uint32)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many rows each pair of ids is linked, and whether that is the highest count of its first id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sums() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for row in batch.column("pairs").to_pylist():
                held.append(np.unique(_numbers(row)))
                n += len(held[-1])
                if n >= FLUSH:
                    yield sums()
                    held, n = [], 0
        if held:
            yield sums()

    counts = stash(aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    first = F.expr(f"pair div {SHIFT}")
    top = counts.groupBy(first.alias("first")).agg(F.max("count").alias("top"))  # at most one row for each id of the first tokenizer
    return stash(counts.withColumn("first", first).join(top, "first").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def common_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most `most` pairs reach in count."""
    by_step = counts.groupBy(F.floor(F.log2("count")).alias("step")).agg(F.count("*").alias("n")).collect()  # at most 63 rows
    total, step = 0, 62
    for r in sorted(by_step, key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        step = r["step"]
    return 1 << step


def score(aligned: DataFrame, counts: DataFrame, row: str, most: int = COMMON) -> DataFrame:
    """The columns of `aligned`, a stored table, without pairs, and n_best and count_sum over its links; `row` names a column that tells rows apart."""
    least = common_from(counts, most)
    usual = counts.where(F.col("count") >= least).toArrow()  # at most `most` rows
    order = np.argsort(usual.column("pair").to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(usual.column(c).to_numpy()[order] for c in ("pair", "count", "best")))
    kind = aligned.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = sent.value
        for batch in batches:
            for part in slices(batch, "pairs", 1 << 22):
                rows = [_numbers(r) for r in part.column("pairs").to_pylist()]
                sizes = np.array([len(r) for r in rows])
                links, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
                at = np.minimum(np.searchsorted(pairs, links), max(0, len(pairs) - 1))
                usual = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
                sums = np.zeros(len(rows), np.int64)
                np.add.at(sums, owner[usual], count[at[usual]])
                good = np.bincount(owner[usual][best[at[usual]]], minlength=len(rows))
                other, who = links[~usual], owner[~usual]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.nulls(len(rows), pa.int64()), pa.array(good), pa.array(sums)], names)
                if len(other):  # sorted inside a row: runs of the same pair
                    begin = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (who[1:] != who[:-1])]))
                    n = np.diff(np.concatenate([begin, [len(other)]]))
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(who[begin])), pa.array(other[begin]), pa.array(n), pa.nulls(len(n), pa.int64())], names)

    names = ["row", "pair", "n", "sum"]
    parts = stash(aligned.select(F.col(row).alias("row"), "pairs").mapInArrow(run, f"row {kind}, pair bigint, n bigint, sum bigint"), "links")
    rare = parts.where("pair is not null").join(counts.where(F.col("count") < least), "pair")
    sums = parts.where("pair is null").select("row", F.col("n").alias("n_best"), F.col("sum").alias("count_sum")).union(
        rare.select("row", F.when(F.col("best"), F.col("n")).otherwise(0), F.col("n") * F.col("count")))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs").join(sums.withColumnRenamed("row", row), row)

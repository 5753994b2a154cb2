"""Token alignment, SimHash classes and the Merkle manifest against plain versions, and on nulls, empty and long texts, ties and extra columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import alignment, merkle, simhash
from foliospark.llm.encoding import byte_letters
from foliospark.llm.work import stash

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(20_000))
NEAR = " ".join(f"tok{i}" for i in range(400))
TEXTS = [None, "", "   \n\t ", "one", "One", "a b", "A b c", LONG, LONG, LONG + " tail", NEAR, NEAR + " end", NEAR + " fin", "Ünïcode ΑΣ ﬁn " * 30, "x" * 3000,
         "don't 's it's", " lead", "trail ", "two  spaces \n and\tmore\r\n", "a\x1cb c", "mark ▁ here", "<s> </s> <|endoftext|> <0x41> z", "emoji \U0001F600 \U0001F600\U0001F600 日本 語", "zero \x00 byte"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, "é"][i % 4], "src", len(t or ""), "k", 1, 2, "p", "c") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "src", 3, None, None, None, None, None)] * 2 + [(None, "no key", None, None, None, None, None, None, None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, point int, part string, node string"
    return spark.createDataFrame(rows, names).repartition(4)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def plain_alignment(texts):
    """Per text (n_a, n_b, groups, links), by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer
    first, second = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    first.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        x = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if not text or not b"".join(x) == (" " + text).encode() == b"".join(y):
            out.append((0, 0, "", []))
            continue
        ends = [np.cumsum([len(v) for v in side]).tolist() for side in (x, y)]
        spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:k], b[j:m], [(a[p], b[q]) for p in range(i, k) for q in range(j, m) if spans[0][p][0] < spans[1][q][1] and spans[1][q][0] < spans[0][p][1]]))
            i, j = k, m
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h, _ in groups)
        out.append((len(a), len(b), written, [link for _, _, links in groups for link in links]))
    return out


def test_alignment_of_texts():
    own, short = alignment.Aligner(BYTE, PIECE), alignment.Aligner(BYTE, PIECE, most=5, longest=3)
    for aligner in (own, short, own):  # a small table of words gives the same
        for text, found, (n_a, n_b, groups, links) in zip(TEXTS, aligner.align(TEXTS), plain_alignment(TEXTS), strict=True):
            assert found[:2] == (n_a, n_b) and found[3] == groups and found[2] == (groups.count(";") + 1 if groups else 0), text
            assert np.frombuffer(found[4], np.uint32).tolist() == sorted(a * alignment.SHIFT + b for a, b in links)
    assert own.align([TEXTS[20]])[0] == alignment.NOTHING  # the mark of a space does not come back


@pytest.mark.parametrize("most", [1 << 18, 50, 0])
def test_alignment_counts(docs, none, most):
    aligned = stash(alignment.align(docs, BYTE, PIECE).withColumn("row", F.monotonically_increasing_id()), "aligned")
    got = sorted((r["groups"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in alignment.score(aligned, alignment.pair_counts(aligned), "row", most).collect())
    plain = plain_alignment([r["text"] for r in docs.collect()])
    counts, top = Counter(), defaultdict(int)
    for *_, links in plain:
        counts.update(set(links))
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    assert got == sorted((g, a, b, g.count(";") + 1 if g else 0, len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links)) for a, b, g, links in plain)
    empty = stash(alignment.align(none, BYTE, PIECE).withColumn("row", F.monotonically_increasing_id()), "aligned")
    assert alignment.score(empty, alignment.pair_counts(empty), "row", most).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    numbers = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(n >> bit & 1 for n in numbers) > len(numbers))


def plain_classes(points, radius=2):
    """For each point the index of the first one that links reach."""
    points, root = np.array(points, np.uint64), list(range(len(points)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= radius):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(points))]


def test_simhash(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    points = [plain_fingerprint(t) for _, t in rows]
    classes = plain_classes(points)
    least = defaultdict(list)
    for (key, _), c in zip(rows, classes, strict=True):
        least[c] += [key] if key is not None else []
    want = sorted((str(k), f"{p:016x}", min(least[c], default=None)) for (k, _), p, c in zip(rows, points, classes, strict=True))
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r[0]), r[1], r[2]) for r in found.collect()) == want
    assert [r["component_id"] for r in found.where("doc_id in (0, 1, 2)").collect()] == [0, 0, 0]  # texts without words are linked
    assert simhash.near_duplicates(none).count() == 0


def test_half_of_the_bits_is_not_set_and_blocks_add_up():
    assert simhash.fingerprint([1, 2]) == 0 and simhash.fingerprint([3, 1, 2]) == 3 and simhash.fingerprint([]) == 0
    numbers = [int(x) for x in np.random.default_rng(1).integers(0, 2**63, 1000)]
    assert simhash.fingerprint(numbers, 7) == simhash.fingerprint(numbers)


@pytest.mark.parametrize("kind", ["random", "balls", "one ball", "chain"])
def test_vantage_point_trees_lose_no_pair(spark, kind):
    rng = np.random.default_rng(3)
    flips = lambda p, n: p ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(p), n)).astype(np.uint64), axis=1)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    points = {"random": base, "balls": np.concatenate([base[:300], flips(np.repeat(base[:300], 4), 3)]), "one ball": flips(np.repeat(base[:1], 2500), 4),
              "chain": np.bitwise_xor.accumulate(np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))}[kind]
    points = np.unique(points)
    want = plain_classes(points)
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point bigint").repartition(3)
    for a, b in ([r["a"], r["b"]] for r in simhash.near_points(table, len(points), shard=200).limit(5).collect()):
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    edges = simhash.near_points(table, len(points), shard=200).collect()
    assert len(edges) <= 12 * len(points)  # forests of buckets, not all pairs
    root = {int(p): int(p) for p in points.view(np.int64)}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for r in edges:
        root[find(r["a"])] = find(r["b"])
    got = [find(int(p)) for p in points.view(np.int64)]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def plain_manifest(rows, altered):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append(r)
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in names:
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[p] = tree([leaf(r) for r in parts[p]])
    top, out = tree([trees[p][-1][0] for p in names]), []
    for k, p in enumerate(names):
        for i, r in enumerate(parts[p]):
            node, proof = leaf(altered(r)), ""
            for levels, at in ((trees[p], i), (top, k)):
                for level in levels[:-1]:
                    run = at - at % 8
                    left, right = "".join(level[run:at]), "".join(level[at + 1:run + 8])
                    node, proof, at = sha(left + node + right), proof + left + right, at // 8
            out.append((str(r[0]), leaf(r), trees[p][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 4])
def test_manifest(spark, docs, none, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "SUPER", 8 ** depth)  # small superblocks: several rounds up and down
    many = spark.range(700).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise(F.concat(F.lit("l"), F.col("id") % 90)).alias("lang"))
    table = docs.unionByName(many, allowMissingColumns=True)
    change = {"text": F.when(F.col("doc_id") % 2 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}
    lower = lambda r: (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4])
    rows = [tuple(r) for r in table.select(*merkle.COLUMNS).collect()]
    got = merkle.manifest(table, change)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect())
    assert got == plain_manifest(rows, lower)
    assert 0 < sum(not r[-1] for r in got) < len(got)
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
    one = docs.where("doc_id = 5")
    assert [(r["leaf"] == r["subroot"] == r["root"], r["proof"]) for r in merkle.manifest(one).collect()] == [(True, "")]  # a lone leaf
    assert merkle.manifest(none).count() == 0

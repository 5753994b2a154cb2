"""Boosted regression trees on quantile-binned features, their predictions and exact attributions.

Cut points of every feature come from one aggregate over all training rows.  Trees are grown leaf by leaf, always where the squared
error falls most, on all training rows: each task of one barrier stage keeps its part of them as one byte a feature, and the tasks
add up the sums of the leaves they are about to cut (``Shared``).  Every round adds one tree to the running predictions; the error
of all validation rows is kept up with it, and training ends ``patience`` rounds after the best one.
The model is a table of nodes.  Predictions and attributions run over Arrow batches of all rows with that table sent along: its
size is bounded by ``rounds`` and ``leaves``.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from uuid import uuid4

import numpy as np
import pandas as pd
from pyarrow.fs import FileType
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import file_system, fresh_path

BINS = 255
PART = 1 << 16  # rows scored together
FIT_ROWS = 50_000  # rows of a fit that one task takes before another one shares them
MOST_TASKS = 64  # of a fit; each reads the sums of all others
JOINT = 4096  # bins counted together
TABLE = 10  # conditions of a leaf up to which all patterns are worked out
STATES = 1 << 11  # of a table for leaves that are looked up together
NODE_SCHEMA = "tree int, node int, feature int, threshold double, lower int, upper int, value double, cover double, gain double"


def cut_points(train: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each column; a value's bin is the number of cut points below it."""
    shares = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [0.0], float)) for i in range(len(cols))]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(feature, row): the number of the feature's cut points below a value, NaN above all; one byte each for up to 255 cut points."""
    kind = np.min_scalar_type(max((len(c) for c in cuts), default=0))
    return np.stack([np.searchsorted(c, x[:, f], "left").astype(kind) for f, c in enumerate(cuts)])


def best_split(sums: np.ndarray, owner: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, feature, place) of the best cut of a leaf from its sums of gradient, weight and rows in each bin; owner: a bin's feature."""
    left = sums.cumsum(axis=1)
    total = left[:, -1] / (owner[-1] + 1)  # every feature sums up to the same
    left -= owner * total[:, None]
    n = left[2]
    fits = np.flatnonzero((n >= least - 0.5) & (n <= total[2] - least + 0.5))
    if not len(fits):
        return 0.0, 0, 0
    (g, w, _), (all_g, all_w, _) = left[:, fits], total
    gain = g * g / w + (all_g - g) ** 2 / (all_w - w)
    at = int(gain.argmax())
    return float(gain[at] - all_g * all_g / all_w), int(owner[fits[at]]), int(fits[at])


def joint_codes(codes: np.ndarray, sizes: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    """Features with few bins as one code of up to ``JOINT`` values: (features, codes), the last feature varies fastest."""
    groups: list[list[int]] = []
    for f in np.argsort(sizes, kind="stable").tolist():
        if groups and np.prod(sizes[[*groups[-1], f]]) <= JOINT:
            groups[-1].append(f)
        else:
            groups.append([f])
    out = []
    for group in groups:
        kind = np.min_scalar_type(int(np.prod(sizes[group])) - 1)
        joint = codes[group[0]].astype(kind)
        for f in group[1:]:
            joint *= kind.type(sizes[f])
            joint += codes[f].astype(kind)
        out.append((group, joint))
    return out


def alone(sums: np.ndarray) -> np.ndarray:
    """The sums over all tasks where one has all rows."""
    return sums


def grow(codes: np.ndarray, owner: np.ndarray, gradient: np.ndarray, weight: np.ndarray, leaves: int, least: int, step: float,
         total: Callable[[np.ndarray], np.ndarray] = alone, joint: Sequence[tuple[list[int], np.ndarray]] | None = None) -> tuple[list[list], list[tuple[int, np.ndarray]]]:
    """One tree: nodes [feature, place, lower, upper, value, cover, gain], and the rows of each leaf.

    ``codes`` holds, for each feature and row, the bin within the feature; places count the bins of all features.  ``total`` adds
    up sums over the tasks that share the rows.  As its calls take time there, leaves are cut before their turn, half as many as may
    still come; the tree is the same.  ``joint`` has the codes by groups of features, for many rows.
    """
    bins = len(owner)
    starts = np.searchsorted(owner, np.arange(len(codes) + 1))
    sizes = np.diff(starts)

    def sums(rows: np.ndarray) -> np.ndarray:
        g, w, out = gradient[rows], weight[rows], np.empty((3, bins))
        if len(rows) < 1000:  # all features at once; more rows feature by feature, which stays in the processor's cache
            flat = (codes[:, rows].astype(np.intp) + starts[:-1, None]).ravel()
            return np.stack([np.bincount(flat, np.tile(v, len(codes)), bins) for v in (g, w)] + [np.bincount(flat, minlength=bins)])
        for features, own in joint or [([f], own) for f, own in enumerate(codes)]:
            places, shape = own[rows].astype(np.intp), sizes[features]
            for line, of in enumerate((g, w, None)):
                counted = np.bincount(places, of, np.prod(shape)).reshape(shape)
                for k, f in enumerate(features):
                    out[line, starts[f]:starts[f + 1]] = counted.sum(axis=tuple(j for j in range(len(features)) if j != k))
        return out

    def facts(rows: np.ndarray) -> list[float]:
        return [float(gradient[rows].sum()), float(weight[rows].sum())]

    def leaf(g: float, w: float) -> list:
        return [-1, 0, -1, -1, -step * g / w, w, 0.0]

    def size(of: np.ndarray, feature: int, end: int) -> float:
        return of[2, starts[feature]:end].sum()

    rows = np.arange(len(gradient))
    whole = total(np.concatenate([sums(rows).ravel(), facts(rows)]))
    nodes, held, queue, parted = [leaf(*whole[-2:].tolist())], {0: (rows, whole[:-2].reshape(3, bins))}, [], {}

    def offer(i: int) -> None:
        gain, feature, place = best_split(held[i][1], owner, least) if size(held[i][1], 0, starts[1]) >= 2 * least else (0.0, 0, 0)
        if gain > 1e-10:
            heapq.heappush(queue, (-gain, i, feature, place))

    def part(some: list[tuple[float, int, int, int]]) -> None:
        """Rows, sums and facts of both parts of these leaves."""
        found, told = [], []
        for _, i, feature, place in some:
            rows, of = held[i]
            below = codes[feature][rows] <= place - starts[feature]
            parts = [rows[below], rows[~below]]
            small = int(2 * size(of, feature, place + 1) > size(of, feature, starts[feature + 1]))
            found.append((i, parts, small))
            told += [sums(parts[small]).ravel(), *map(facts, parts)]
        for (i, parts, small), added in zip(found, total(np.concatenate(told)).reshape(len(found), -1), strict=True):
            fewer = added[:-4].reshape(3, bins)
            more = held[i][1] - fewer
            parted[i] = (parts, [more, fewer] if small else [fewer, more], added[-4:].reshape(2, 2).tolist())

    offer(0)
    while queue and len(held) < leaves:
        if queue[0][1] not in parted:
            ahead = 1 if total is alone else max(1, (leaves - len(held)) // 2)
            part([x for x in heapq.nsmallest(ahead, queue) if x[1] not in parted])
        gain, i, feature, place = heapq.heappop(queue)
        del held[i]
        nodes[i][:4], nodes[i][6] = [feature, place, len(nodes), len(nodes) + 1], -gain
        for own_rows, own, fact in zip(*parted.pop(i), strict=True):
            held[len(nodes)] = (own_rows, own)
            nodes.append(leaf(*fact))
            offer(len(nodes) - 1)
    return nodes, [(i, rows) for i, (rows, _) in held.items()]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, val: np.ndarray, cuts: Sequence[np.ndarray], rounds: int, step: float, patience: int, leaves: int,
          least: int) -> tuple[float, list[list[list]]]:
    """``boost_codes`` of plain rows."""
    return boost_codes(binned(x, cuts), y, weight, val, [len(c) + 1 for c in cuts], rounds, step, patience, leaves, least)


def boost_codes(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, val: np.ndarray, sizes: Sequence[int], rounds: int, step: float, patience: int, leaves: int,
                least: int, total: Callable[[np.ndarray], np.ndarray] = alone) -> tuple[float, list[list[list]]]:
    """(base, trees up to the round with the least validation error); without validation rows all rounds.  A node's place is a bin.

    The rows may be one task's part of them: ``total`` adds up sums over the tasks, which all grow the same trees.
    """
    sizes = np.array(sizes)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)

    def mean(values: np.ndarray, weights: np.ndarray) -> float:
        both = total(np.array([np.multiply(values, weights).sum(), weights.sum()]))
        if not both[1]:
            raise ZeroDivisionError("the weights sum to zero")
        return float(both[0] / both[1])

    train = ~val
    fit_codes, val_codes, fit_y, val_y, fit_weight, val_weight = codes[:, train], codes[:, val], y[train], y[val], weight[train], weight[val]
    base, checked = mean(fit_y, fit_weight), total(np.array([float(len(val_y))]))[0] > 0
    joint = joint_codes(fit_codes, sizes) if len(fit_y) >= FIT_ROWS else None
    now, later = np.full(len(fit_y), base), np.full(len(val_y), base)
    trees, best, lowest = [], 0, mean((later - val_y) ** 2, val_weight) if checked else np.inf
    for i in range(1, rounds + 1):
        nodes, rows = grow(fit_codes, owner, fit_weight * (now - fit_y), fit_weight, leaves, least, step, total, joint)
        if len(nodes) == 1:
            break
        trees.append(nodes)
        for node, own in rows:
            now[own] += nodes[node][4]
        for node, own in fallen(nodes, val_codes, starts):
            later[own] += nodes[node][4]
        error = mean((later - val_y) ** 2, val_weight) if checked else -i
        if error < lowest:
            best, lowest = i, error
        elif i - best >= patience:
            break
    return base, [[[f, p - starts[f] if f >= 0 else 0, *rest] for f, p, *rest in nodes] for nodes in trees[:best]]


def fallen(nodes: list[list], codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that reach each leaf."""
    todo = [(0, np.arange(codes.shape[1]))]
    while todo:
        i, rows = todo.pop()
        feature, place, lower, upper = nodes[i][:4]
        if feature < 0:
            yield i, rows
        else:
            below = codes[feature][rows] <= place - starts[feature]
            todo += [(lower, rows[below]), (upper, rows[~below])]


@dataclass
class Group:
    """Leaves of one subtree.  A row's state is one number for each feature: which of the subtree's intervals its value lies in, or that
    it does not come to the subtree.

    ``states`` has each feature's state by code, times the states of the features after it; ``passed`` whether (leaf, state) passes;
    ``leaves`` value, shares and features of each leaf's conditions, these as places among ``features``.
    """
    features: list[int]
    states: list[np.ndarray]
    passed: list[np.ndarray]
    leaves: list[tuple[float, list[float], list[int]]]

    @staticmethod
    def of(leaves: list[tuple[float, dict]], held: dict, inside: dict, most_code: list[int]) -> Group:
        features = sorted({**held, **inside})
        states, passed, stride = [], [], 1
        kind = np.min_scalar_type(int(np.prod([len(inside.get(f, ())) + 1 + (f in held) for f in features], dtype=object)) - 1)
        for f in reversed(features):
            cuts, (least, most, _) = np.array(sorted(inside.get(f, ())), int), held.get(f, (0, most_code[f], 1.0))
            code = np.arange(most_code[f] + 1)
            states.append((np.where((code < least) | (code > most), len(cuts) + 1, np.searchsorted(cuts, code, "left")) * stride).astype(kind))
            last = np.append(cuts, most)  # of each interval
            ends = [c[f][:2] if f in c else (0, most_code[f]) for _, c in leaves]
            inner = np.array([(low <= last) & (last <= high) for low, high in ends])
            passed.append(np.pad(inner, ((0, 0), (0, f in held))))
            stride *= passed[-1].shape[1]
        places = {f: k for k, f in enumerate(features)}
        return Group(features, states[::-1], passed[::-1], [(v, [c[f][2] for f in c], [places[f] for f in c]) for v, c in leaves])

    def add(self, codes: np.ndarray, out: np.ndarray, tables: dict[int, np.ndarray]) -> None:
        """Add the leaves' shares of all rows to the features' rows of ``out``."""
        state = self.states[0].take(codes[self.features[0]])
        for own, f in zip(self.states[1:], self.features[1:], strict=True):
            state = state + own.take(codes[f])
        if any(id(leaf) not in tables for leaf in self.leaves):  # one of many conditions: only the patterns that occur
            seen, state = np.unique(state, return_inverse=True)
            marks, table = np.unravel_index(seen.astype(np.intp), [p.shape[1] for p in self.passed]), np.zeros((len(self.features), len(seen)))
            for n, (value, shares, places) in enumerate(self.leaves):
                patterns = sum(self.passed[k][n][marks[k]].astype(np.int64) << j for j, k in enumerate(places))
                table[places] += leaf_shares(patterns, np.array([shares]), np.array([value]))[0]
        else:
            table = np.zeros((len(self.features), int(np.prod([p.shape[1] for p in self.passed]))))
            for n, leaf in enumerate(self.leaves):
                pattern, places = np.zeros(1, np.intp), {k: j for j, k in enumerate(leaf[2])}
                for k, p in enumerate(self.passed):
                    pattern = np.add.outer(pattern, p[n].astype(np.intp) << places[k] if k in places else np.zeros(p.shape[1], np.intp)).ravel()
                for k, j in places.items():
                    table[k] += tables[id(leaf)][j].take(pattern)
        state = state.astype(np.intp)
        for k, f in enumerate(self.features):
            out[f] += table[k].take(state)


def bits(rows: np.ndarray) -> np.ndarray:
    """A mask of rows, 64 to a word."""
    packed = np.packbits(rows)
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


@dataclass
class Boosted:
    """Trees as arrays of (tree, node); ``feature`` is -1 in leaves.  A value at most the threshold goes to ``lower``; NaN to ``upper``."""
    cols: list[str]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.feature)

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        """The thresholds of each feature, ascending."""
        return [np.unique(self.threshold[self.feature == f]) for f in range(len(self.cols))]

    @cached_property
    def _splits(self) -> list[tuple[list[tuple[int, int, int, int, int]], list[int], np.ndarray]]:
        """Each tree's inner nodes as (node, feature, place of the threshold, lower, upper), parents first, its leaves and their values."""
        out = []
        for t in range(self.trees):
            inner, leaves, todo = [], [], [0]
            while todo:
                i = todo.pop()
                f = int(self.feature[t, i])
                if f < 0:
                    leaves.append(i)
                else:
                    inner.append((i, f, int(np.searchsorted(self.cuts[f], self.threshold[t, i])), int(self.lower[t, i]), int(self.upper[t, i])))
                    todo += inner[-1][3:]
            out.append((inner, leaves, self.value[t, leaves]))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Every node's rows are kept as bits over all rows of a part, so a node takes a few operations on an eighth of a byte a row.
        The number of a row's leaf is put together from one mask for each of its binary digits."""
        out = np.zeros(len(x))
        for begin in range(0, len(x) if self.trees else 0, PART):
            codes, below = binned(x[begin:begin + PART], self.cuts), {}
            n = codes.shape[1]

            def at_most(f: int, place: int) -> np.ndarray:
                if (f, place) not in below:
                    below[f, place] = bits(codes[f] <= place)
                return below[f, place]
            every = bits(np.ones(n, bool))
            for inner, leaves, values in self._splits:
                reach = {0: every}
                for i, f, place, lower, upper in inner:
                    rows = reach.pop(i)
                    reach[lower] = low = rows & at_most(f, place)
                    reach[upper] = rows ^ low
                digits = np.zeros((max(1, (len(leaves) - 1).bit_length()), len(every)), np.uint64)
                for k, i in enumerate(leaves):
                    for b, digit in enumerate(digits):
                        if k >> b & 1:
                            digit |= reach[i]
                kind = np.min_scalar_type(len(leaves))
                found = np.unpackbits(digits.view(np.uint8), axis=1, count=n).astype(kind, copy=False)
                leaf = found[0]
                for b in range(1, len(digits)):
                    leaf += found[b] << kind.type(b)
                out[begin:begin + PART] += values.take(leaf)
        return self.base + out

    def paths(self) -> Iterator[tuple[float, list[tuple[int, float, float, float]]]]:
        """Each leaf's value and its conditions, one for each feature: (feature, above, at most, share of the cover that passes)."""
        for t in range(self.trees):
            todo = [(0, {})]
            while todo:
                i, held = todo.pop()
                f = int(self.feature[t, i])
                if f < 0:
                    yield float(self.value[t, i]), [(k, *v) for k, v in held.items()]
                    continue
                low, high, share = held.get(f, (-np.inf, np.inf, 1.0))
                cut, cover = float(self.threshold[t, i]), self.cover[t, i]
                todo.append((int(self.lower[t, i]), held | {f: (low, min(high, cut), share * self.cover[t, self.lower[t, i]] / cover)}))
                todo.append((int(self.upper[t, i]), held | {f: (max(low, cut), high, share * self.cover[t, self.upper[t, i]] / cover)}))

    def expected(self) -> float:
        """The prediction without any feature known: leaves weighted by their cover."""
        return self.base + sum(value * float(np.prod([c[3] for c in conditions])) for value, conditions in self.paths())

    @cached_property
    def _groups(self) -> list[Group]:
        """Leaves that share a table: those of the largest subtrees with at most ``STATES`` states, or single leaves."""
        out: list[Group] = []

        def places(t: int, i: int, inside: dict) -> dict[int, set[int]]:
            f = int(self.feature[t, i])
            inside[i] = {}
            if f >= 0:
                for child in (int(self.lower[t, i]), int(self.upper[t, i])):
                    for k, own in places(t, child, inside).items():
                        inside[i].setdefault(k, set()).update(own)
                inside[i].setdefault(f, set()).add(int(np.searchsorted(self.cuts[f], self.threshold[t, i])))
            return inside[i]

        def leaves(t: int, i: int, held: dict) -> Iterator[tuple[float, dict]]:
            f = int(self.feature[t, i])
            if f < 0:
                yield float(self.value[t, i]), held
                return
            least, most, share = held.get(f, (0, len(self.cuts[f]), 1.0))
            at, cover = int(np.searchsorted(self.cuts[f], self.threshold[t, i])), self.cover[t, i]
            for child, low, high in ((int(self.lower[t, i]), least, min(most, at)), (int(self.upper[t, i]), max(least, at + 1), most)):
                yield from leaves(t, child, held | {f: (low, high, share * self.cover[t, child] / cover)})

        def divide(t: int, i: int, held: dict, inside: dict) -> None:
            states = {f: len(inside[i].get(f, ())) + 1 + (f in held) for f in {**held, **inside[i]}}
            if self.feature[t, i] < 0 or (len(states) <= TABLE and np.prod(list(states.values())) <= STATES):
                out.append(Group.of(list(leaves(t, i, held)), held, inside[i], [len(c) for c in self.cuts]))
                return
            f = int(self.feature[t, i])
            least, most, share = held.get(f, (0, len(self.cuts[f]), 1.0))
            at, cover = int(np.searchsorted(self.cuts[f], self.threshold[t, i])), self.cover[t, i]
            for child, low, high in ((int(self.lower[t, i]), least, min(most, at)), (int(self.upper[t, i]), max(least, at + 1), most)):
                divide(t, child, held | {f: (low, high, share * self.cover[t, child] / cover)}, inside)

        for t in range(self.trees):
            inside: dict = {}
            places(t, 0, inside)
            divide(t, 0, {}, inside)
        return [g for g in out if g.features]

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Exact Shapley values of the trees, features not known following the cover: rows add up to prediction - expected().

        A leaf's share depends only on which of its conditions a row passes.  It is worked out for all patterns of many leaves at once,
        summed up for the leaves of a subtree by the states of its features, and looked up by row; for a leaf with more than ``TABLE``
        conditions only for the patterns that occur.
        """
        out, codes = np.zeros((len(self.cols), len(x))), binned(x, self.cuts).astype(np.intp)
        todo, begin = self._groups, 0
        while begin < len(todo):
            end, entries = begin, 0
            while end < len(todo) and (end == begin or entries < 1 << 20):
                entries += sum(len(s) << min(len(s), TABLE) for _, s, _ in todo[end].leaves)
                end += 1
            part = todo[begin:end]
            tables = {}
            for d in {len(s) for g in part for _, s, _ in g.leaves if len(s) <= TABLE}:
                own = [leaf for g in part for leaf in g.leaves if len(leaf[1]) == d]
                made = leaf_shares(np.arange(1 << d), np.array([s for _, s, _ in own]), np.array([v for v, _, _ in own]))
                tables |= {id(leaf): t for leaf, t in zip(own, made, strict=True)}
            for g in part:
                g.add(codes, out, tables)
            begin = end
        return out.T

    # Spark ------------------------------------------------------------------------------------------------
    def _sent(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self)  # at most rounds x (2 leaves - 1) nodes

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` from a ``features`` column (vector or array)."""
        kind = df.schema["features"].dataType.simpleString()
        sent = self._sent(df.sparkSession)

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for some in gathered(batches, PART):
                found = sent.value.predict(np.concatenate([np.stack(x.to_numpy()) for x in some]).astype(float))
                yield from map(pd.Series, np.split(found, np.cumsum([len(x) for x in some])[:-1]))

        return df.withColumn("prediction", predict(vector_to_array("features") if kind == "vector" else F.col("features")))

    def score(self, df: DataFrame) -> DataFrame:
        return self.transform(spread(df, 200_000).withColumn("features", F.array(*[F.col(c).cast("double") for c in self.cols]))).drop("features")

    def explain_rows(self, df: DataFrame, key: str) -> DataFrame:
        """(key, x, attributions): one row for each row, both arrays in the order of ``cols``."""
        sent, cols = self._sent(df.sparkSession), self.cols

        @F.pandas_udf("array<double>")
        def explained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for some in gathered(batches, PART):  # the tables of the trees are made once for all of them
                found = sent.value.attributions(np.concatenate([np.stack(x.to_numpy()) for x in some]).astype(float))
                yield from (pd.Series(list(part), dtype=object) for part in np.split(found, np.cumsum([len(x) for x in some])[:-1]))

        return spread(df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x")), PART).withColumn("attributions", explained("x"))

    def explain(self, df: DataFrame, key: str) -> DataFrame:
        """(key, feature, value, attribution), one row for each feature."""
        return self.explain_rows(df, key).select(key, F.posexplode("attributions").alias("at", "attribution"), "x").select(
            key, F.get(F.array(*[F.lit(c) for c in self.cols]), F.col("at")).alias("feature"), F.get("x", F.col("at")).alias("value"), "attribution")

    def importance(self) -> dict[str, float]:
        """Share of each feature in the fall of the error."""
        inner = self.feature >= 0
        sums = np.bincount(self.feature[inner], self.gain[inner], len(self.cols))
        return dict(zip(self.cols, (sums / (sums.sum() or 1.0)).tolist(), strict=True))

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, int(self.feature[t, i]), float(self.threshold[t, i]), int(self.lower[t, i]), int(self.upper[t, i]), float(self.value[t, i]), float(self.cover[t, i]), float(self.gain[t, i]))
                for t, i in product(range(self.trees), range(self.feature.shape[1]))]
        return spark.createDataFrame(rows, NODE_SCHEMA)


def gathered(batches: Iterator[pd.Series], rows: int) -> Iterator[list[pd.Series]]:
    """Batches until they have so many rows."""
    some, n = [], 0
    for batch in batches:
        if len(batch):
            some.append(batch)
            n += len(batch)
        if n >= rows:
            yield some
            some, n = [], 0
    if some:
        yield some


def spread(df: DataFrame, most: int) -> DataFrame:
    """The rows evenly over tasks of at most ``most`` rows, or of fewer to occupy the cores: a small file is read by one task, however
    long its rows take.  The rows are counted first."""
    n = df.count()
    return df.repartition(max(1, -(-n // most), min(df.sparkSession.sparkContext.defaultParallelism, -(-20 * n // most))))


def leaf_shares(patterns: np.ndarray, shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(leaf, condition, pattern): what each condition adds to a leaf, for rows that pass the conditions of a pattern.

    With o = 1 where a row passes, a set S of known conditions gives the product of o inside S and of the shares outside.  The
    weight of a set of k among d conditions is the integral of t^k (1 - t)^(d - 1 - k) over 0..1, so the sum over all sets is that of
    the product of t o + (1 - t) share over the other conditions: a polynomial of degree d - 1, which (d + 1) // 2 Gauss points give exactly.
    """
    n, d = shares.shape
    passed, own = (patterns >> np.arange(d)[:, None] & 1).astype(float), shares[:, :, None]
    total = np.zeros((n, d, len(patterns)))
    for point, weight in zip(*np.polynomial.legendre.leggauss((d + 1) // 2), strict=True):
        t = (point + 1) / 2
        factor = t * passed + (1 - t) * own
        others, after = np.ones_like(factor), np.full((n, len(patterns)), weight / 2)
        for k in range(1, d):
            np.multiply(others[:, k - 1], factor[:, k - 1], out=others[:, k])
        for k in range(d - 1, -1, -1):
            others[:, k] *= after
            after *= factor[:, k]
        total += others
    return total * (passed - own) * values[:, None, None]


def from_nodes(rows: pd.DataFrame, cols: Sequence[str], base: float) -> Boosted:
    """The model of a table of nodes."""
    trees, wide = int(rows["tree"].max()) + 1 if len(rows) else 0, int(rows["node"].max()) + 1 if len(rows) else 1
    at = (rows["tree"].to_numpy(int), rows["node"].to_numpy(int))
    made = {}
    for name, kind, empty in (("feature", np.int32, -1), ("threshold", float, 0), ("lower", np.int32, 0), ("upper", np.int32, 0), ("value", float, 0), ("cover", float, 0), ("gain", float, 0)):
        made[name] = np.full((trees, wide), empty, kind)
        made[name][at] = rows[name].to_numpy()
    return Boosted(list(cols), base, **made)


class Shared:
    """Sums of arrays over the tasks of a barrier stage, by files in the shared folder: a task writes its own and reads those of all
    others, in the same order, so that all get the same sums.  (Spark's own gathering takes a second a call.)"""

    def __init__(self, uri: str):
        stage = BarrierTaskContext.get()
        self.me, self.turn = stage.partitionId(), 0
        attempt = stage.allGather(uuid4().hex)  # a repeated stage has a folder of its own
        self.tasks = len(attempt)
        self.fs, root = file_system(uri)
        self.root = f"{root}/{attempt[0]}"
        self.fs.create_dir(self.root, recursive=True)

    def read(self, path: str) -> bytes:
        wait = 0.0005
        while self.fs.get_file_info(path).type == FileType.NotFound:  # if its task fails, Spark ends this one
            time.sleep(wait)
            wait = min(2 * wait, 0.02)
        with self.fs.open_input_stream(path) as found:
            return found.read()

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        own = f"{self.root}/{self.turn}-{self.me}"
        with self.fs.open_output_stream(f"{own}.part") as out:
            out.write(sums.astype(float).tobytes())
        self.fs.move(f"{own}.part", own)
        found = np.zeros(len(sums))
        for k in range(self.tasks):
            found += sums if k == self.me else np.frombuffer(self.read(f"{self.root}/{self.turn}-{k}"))
        if self.turn:  # all have written this turn's sums, so they have read those of the last
            self.fs.delete_file(f"{self.root}/{self.turn - 1}-{self.me}")
        self.turn += 1
        return found


def slots(spark: SparkSession) -> int:
    """Tasks that run at once for sure; one where executors come and go, as a barrier stage does not run there."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def fit(df: DataFrame, cols: Sequence[str], label: str, rounds: int = 2000, step: float = 0.05, patience: int = 50, leaves: int = 31, least: int = 20) -> Boosted:
    """Train on all rows with ``split`` train, stop by all with val; ``weight`` counts in both."""
    spark = df.sparkSession
    rows = df.filter("split <> 'test'").filter(F.col(label).isNotNull())
    cuts = cut_points(rows.filter("split = 'train'"), cols)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    rows = rows.select((F.col("split") == "val").alias("val"), F.col(label).cast("double").alias("y"), F.col("weight").cast("double").alias("w"), *x)
    tasks = max(1, min(slots(spark), MOST_TASKS, -(-rows.count() // FIT_ROWS)))
    uri = fresh_path(spark, "sums") if tasks > 1 else None

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(binned(b.iloc[:, 3:].to_numpy(float), cuts), b["y"].to_numpy(), b["w"].to_numpy(), b["val"].to_numpy(bool)) for b in batches if len(b)]
        if not parts:
            return
        codes, *facts = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        del parts
        total = Shared(uri) if uri else alone
        base, trees = boost_codes(codes, *facts, [len(c) + 1 for c in cuts], rounds, step, patience, leaves, least, total)
        if uri and total.me:
            return
        out = [(t, i, n[0], float(cuts[n[0]][n[1]]) if n[0] >= 0 else 0.0, n[2], n[3], n[4], n[5], n[6]) for t, nodes in enumerate(trees) for i, n in enumerate(nodes)]
        out.append((-1, 0, -1, 0.0, 0, 0, base, 0.0, 0.0))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    dealt = rows.repartition(tasks).sortWithinPartitions(*rows.columns)  # evenly, so no task is without rows
    nodes = dealt.mapInPandas(train, NODE_SCHEMA, barrier=tasks > 1).repartition(1).toPandas()  # Spark repeats a barrier stage only before a shuffle
    base = float(nodes.loc[nodes["tree"] < 0, "value"].iloc[0]) if len(nodes) else 0.0
    return from_nodes(nodes[nodes["tree"] >= 0], cols, base)

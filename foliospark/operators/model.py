"""The ESG regression model and explanations of its scores.

A model is trained once for its inputs and parameters and kept in the shared folder (``stored_model``).  Trees are explained
exactly (``Boosted.explain``).  For any other model, explanations build every perturbed input as rows and score them in one
``transform``; the sums that follow are grouped, spread over all tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.storage import cut_lineage, shared_dir
from .boosting import PART, Boosted, fit, from_nodes, spread
from .features import EncodeCategories, ImputeScale, key_digest


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def train_esg(df: DataFrame, cols: Sequence[str], label: str = "total_esg", rounds: int = 2000, leaves: int = 31, step: float = 0.05,
              patience: int = 50) -> Boosted:
    """Boosted trees with weights, up to the round with the least error on the validation part (``split`` = val).

    Training ends after ``patience`` rounds without a smaller error, or at ``rounds``.  Every round continues the one before, so
    no tree is grown twice.  All rows of both parts count.
    """
    return fit(df, cols, label, rounds, step, patience, leaves)


@dataclass
class EsgModel:
    """A fitted pipeline: median fill and scaling of numbers, 0/1 columns of a category, and trees on both."""
    scaler: ImputeScale
    encoder: EncodeCategories
    trees: Boosted

    @property
    def cols(self) -> list[str]:
        return self.trees.cols

    def prepare(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(self.scaler.transform(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_esg(self.prepare(df), self.trees, self.cols)

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as a table; the rest as one JSON value, written last, so that a folder with it is whole."""
        facts = {"base": self.trees.base, "cols": self.cols, "numbers": self.scaler.cols, "median": self.scaler.median, "mean": self.scaler.mean, "std": self.scaler.std,
                 "category": self.encoder.column, "values": self.encoder.values}
        self.trees.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def saved(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load_model(spark: SparkSession, path: str) -> EsgModel:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
    scaler, encoder = ImputeScale(), EncodeCategories()
    scaler.cols, scaler.median, scaler.mean, scaler.std = facts["numbers"], facts["median"], facts["mean"], facts["std"]
    encoder.column, encoder.values = facts["category"], facts["values"]
    encoder.names = [f"{encoder.column}_{v}" for v in encoder.values]
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # at most rounds x (2 leaves - 1) rows
    return EsgModel(scaler, encoder, from_nodes(nodes, facts["cols"], facts["base"]))


def train_model(df: DataFrame, numbers: Sequence[str], category: str, label: str = "total_esg", **how) -> EsgModel:
    """Fit the whole pipeline on the rows with ``split`` train (and val, which only ends the training)."""
    train = df.filter("split = 'train'")
    scaler, encoder = ImputeScale().fit(train, numbers), EncodeCategories().fit(train, category)
    x = encoder.transform(scaler.transform(df))
    return EsgModel(scaler, encoder, train_esg(x, [*numbers, *encoder.names], label, **how))


def input_digest(df: DataFrame, cols: Sequence[str], *more) -> str:
    """A name for these columns of these rows, whatever their order, and for the given parameters."""
    mark = F.xxhash64(*cols)
    facts = df.agg(F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark), F.sum(F.xxhash64(mark, F.lit(1)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((list(cols), tuple(map(str, facts)), more)).encode()).hexdigest()[:32]


def stored_model(df: DataFrame, numbers: Sequence[str], category: str, label: str = "total_esg", **how) -> EsgModel:
    """The model of these rows and parameters: loaded from the shared folder if it was trained before, else trained and kept there."""
    spark = df.sparkSession
    # "all rows": models that were fitted on a sample have other names
    path = f"{shared_dir(spark)}/esg-model-{input_digest(df, [*numbers, category, label, 'weight', 'split'], sorted(how.items()), 'all rows')}"
    if not saved(spark, path):
        train_model(df, numbers, category, label, **how).save(spark, path)
    return load_model(spark, path)


def predict_esg(df: DataFrame, model: Model | Boosted, cols: Sequence[str]) -> DataFrame:
    """Add ``prediction`` within 0..100."""
    y = model.transform(assemble(spread(df, 200_000), cols)).drop("features")
    return y.withColumn("prediction", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("prediction"))))


def feature_importance(spark: SparkSession, model: Boosted) -> DataFrame:
    """Features by their share in the fall of the training error."""
    rows = sorted(model.importance().items(), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def shap_sample(df: DataFrame, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """A fixed random sample of n rows: those with the smallest hash."""
    return df.orderBy(key_digest(key, seed), key).limit(n)


# attributions -------------------------------------------------------------------------------------------
def shapley_linear(df: DataFrame, key: str, coef: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Exact attributions of a linear model: coefficient x (value - mean), one row per feature."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                              (F.lit(float(b)) * (F.col(c) - F.lit(float(means[c])))).alias("attribution")) for c, b in coef.items()])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.feature", "r.value", "r.attribution")


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()


def shapley_sampled(df: DataFrame, key: str, model: Model, cols: Sequence[str], background: DataFrame,
                    permutations: int = 8, seed: int = 42) -> DataFrame:
    """Sampled Shapley values: for m random feature orders, features change one by one from a background
    row's value to the row's own, and each change of the prediction belongs to the feature changed.

    Per row the attributions add up to f(row) - mean f(background rows used).  ``background`` is a small
    sample (it becomes a literal); orders and choices come from hashes, so a rerun gives the same result.
    """
    back = [[float(r[c]) for c in cols] for r in background.select(*cols).collect()]
    d = len(cols)
    x = df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    p = x.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in r) + ")" for r in back) + ")")
    pick = F.pmod(F.xxhash64(key, "m", F.lit(seed)), F.lit(len(back))).cast("int")
    p = p.withColumn("z", F.get(table, pick))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                                                 lambda i: F.struct(F.xxhash64(F.col(key), F.col("m"), i, F.lit(seed)).alias("h"), i.alias("i")))),
                        lambda s: s["i"])
    p = p.withColumn("o", order)
    s = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(
        F.array_position(F.col("o"), i) <= F.col("k"), F.get("x", i)).otherwise(F.get("z", i)))
    scored = model.transform(s.withColumn("features", array_to_vector(mixed))).select(key, "o", "k", "prediction")
    # the step's prediction counts for the feature just set and against the one set next
    parts = F.array(F.struct(F.get("o", F.col("k") - 1).alias("f"), F.lit(1.0).alias("sign")),
                    F.struct(F.get("o", F.col("k")).alias("f"), F.lit(-1.0).alias("sign")))
    parts = F.filter(parts, lambda q: q["f"].isNotNull())
    e = scored.select(key, "prediction", F.explode(parts).alias("q"))
    g = e.groupBy(key, F.col("q.f").alias("f")).agg((F.sum(F.col("q.sign") * F.col("prediction")) / permutations).alias("attribution"))
    return g.select(key, F.get(F.array(*[F.lit(c) for c in cols]), F.col("f")).alias("feature"), "attribution")


def solve(matrix: Column, d: int) -> Column:
    """The solution of d equations, given as rows of d + 1 numbers with a positive definite left side, by elimination."""
    def eliminate(m: Column, k: Column) -> Column:
        scaled = F.transform(F.get(m, k), lambda v: v / F.get(F.get(m, k), k))
        others = lambda p: F.transform(m, lambda r, i: F.when(i == k, p).otherwise(F.zip_with(r, p, lambda v, q: v - F.get(r, k) * q)))
        return F.get(F.transform(F.array(scaled), others), 0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), matrix, eliminate, lambda m: F.transform(m, lambda r: F.get(r, d)))


def weighted_ridge(rows: DataFrame, key: str, x: str, y: str, weight: str, d: int, ridge: float = 1.0) -> DataFrame:
    """Per key ``beta``, the d weights of a ridge fit of ``y`` on the array ``x`` with an intercept.

    The weighted sums of all products are combined in the tasks that make the rows, so one row per key and task is shuffled,
    and a key may have any number of rows.  Rows without ``y`` do not count; a null key is a key; a key without any weight has nulls.
    """
    sums = {"sw": "w", "sy": "w * y"} | {f"x{i}": f"w * get(x, {i})" for i in range(d)} | {f"y{i}": f"w * get(x, {i}) * y" for i in range(d)}
    sums |= {f"x{i}_{j}": f"w * get(x, {i}) * get(x, {j})" for i in range(d) for j in range(i, d)}
    total = rows.where(F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(weight).alias("w"))
    total = total.groupBy("key").agg(*[F.expr(f"sum({v}) AS {c}") for c, v in sums.items()])
    centred = lambda both, one, other: f"{both} - try_divide({one} * {other}, sw)"
    lines = [[centred(f"x{min(i, j)}_{max(i, j)}", f"x{i}", f"x{j}") + (f" + double({ridge})" if i == j else "") for j in range(d)] + [centred(f"y{i}", f"x{i}", "sy")]
             for i in range(d)]
    matrix = F.expr(f"array({', '.join(f'array({", ".join(line)})' for line in lines)})")  # as text: thousands of column calls take the driver seconds
    return total.select(F.col("key").alias(key), F.when(F.col("sw") > 0, solve(matrix, d)).alias("beta"))


# Multipliers of the 64-bit hash.
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one int, going on from the hash of the columns before it."""
    u = np.uint64
    h = (seed + (_P5 + u(4))) ^ (np.asarray(value, np.uint64) * _P1)
    h = (h << u(23) | h >> u(41)) * _P2 + _P3
    h = (h ^ h >> u(33)) * _P2
    h = (h ^ h >> u(29)) * _P3
    return h ^ h >> u(32)


def perturbed_sums(model: Boosted, hashes: np.ndarray, x: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """For each row its ``samples`` perturbations, scored: the sums that a weighted ridge fit needs, as (weights, weighted scores,
    weighted inputs, weighted inputs x scores, upper triangle of weighted input products)."""
    d = x.shape[1]
    upper = np.triu_indices(d)
    out, at_once = np.empty((len(x), 2 + 2 * d + len(upper[0]))), max(1, PART // samples)
    with np.errstate(over="ignore"):
        for begin in range(0, len(x), at_once):
            own = x[begin:begin + at_once]
            h = hash_int(np.arange(samples)[:, None], hashes[begin:begin + at_once].view(np.uint64)[:, None, None])
            h = hash_int(seed, hash_int(np.arange(d), h))
            u = [((hash_int(t, h) & np.uint64((1 << 30) - 1)) + 0.5) / (1 << 30) for t in (1, 2)]
            n = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
            n[:, 0] = 0.0
            scale = np.where(own != 0, np.abs(own) * 0.5, 0.5)
            y = model.predict((own[:, None] + n * scale[:, None]).reshape(-1, d)).reshape(len(own), samples)
            w = np.exp(-(n * n).sum(axis=2) / (2 * (0.75 * np.sqrt(d)) ** 2))
            wn = n * w[:, :, None]
            part = out[begin:begin + at_once]
            part[:, 0], part[:, 1] = w.sum(axis=1), (w * y).sum(axis=1)
            part[:, 2:2 + d] = wn.sum(axis=1)
            part[:, 2 + d:2 + 2 * d] = np.matmul(y[:, None], wn)[:, 0]
            part[:, 2 + 2 * d:] = np.matmul(n.transpose(0, 2, 1), wn)[:, *upper]
    return out


def ridge_weights(sums: np.ndarray, d: int, ridge: float = 1.0) -> np.ndarray:
    """The weights of ``weighted_ridge`` from sums as ``perturbed_sums`` has them, a fit a row."""
    upper = np.triu_indices(d)
    sw, sy, sx, sxy = sums[:, 0], sums[:, 1], sums[:, 2:2 + d], sums[:, 2 + d:2 + 2 * d]
    left = np.empty((len(sums), d, d))
    left[:, *upper] = sums[:, 2 + 2 * d:]
    left[:, upper[1], upper[0]] = sums[:, 2 + 2 * d:]
    left += ridge * np.eye(d) - sx[:, :, None] * sx[:, None] / sw[:, None, None]
    return np.linalg.solve(left, (sxy - sx * (sy / sw)[:, None])[:, :, None])[:, :, 0]


def surrogate_of_trees(x: DataFrame, key: str, model: Boosted, d: int, samples: int, seed: int) -> DataFrame:
    """(key, beta) by sums that each row's own task works out; the rows of one key are one fit, however many they are."""
    sent, size = x.sparkSession.sparkContext.broadcast(model), 2 + 2 * d + d * (d + 1) // 2

    @F.pandas_udf("array<double>")
    def summed(h: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(list(perturbed_sums(sent.value, h.to_numpy(np.int64), np.stack(rows.to_numpy()).astype(float), samples, seed)) if len(h) else [], dtype=object)

    @F.pandas_udf("array<double>")
    def solved(sums: pd.Series) -> pd.Series:
        return pd.Series(list(ridge_weights(np.stack(sums.to_numpy()), d)) if len(sums) else [], dtype=object)

    sums = x.select(key, summed(F.xxhash64(key), "x").alias("s")).groupBy(key).agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(size)])
    return sums.select(key, solved(F.array(*[f"s{i}" for i in range(size)])).alias("beta"))


def local_surrogate(df: DataFrame, key: str, model: Model | Boosted, cols: Sequence[str], samples: int = 200, top: int = 3,
                    seed: int = 42) -> DataFrame:
    """Weights of a linear model fitted around each row: noise on the inputs, one scoring pass, then a weighted ridge fit
    over the ``samples`` perturbations of each key.  Of equal weights the earlier column comes first.

    Trees score the perturbations where they are made; other models score them as rows, fitted by column expressions."""
    d = len(cols)
    x = df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    if isinstance(model, Boosted):
        fitted = surrogate_of_trees(spread(x, 5_000), key, model, d, samples, seed)
    else:
        s = spread(x, 1_000).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        u = lambda i, t: (F.pmod(F.xxhash64(F.col(key), F.col("j"), i, F.lit(seed), F.lit(t)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        noise = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.col("j") == 0, 0.0).otherwise(
            F.sqrt(-2 * F.log(u(i, 1))) * F.cos(2 * np.pi * u(i, 2))))
        s = s.withColumn("n", noise)
        scale = lambda v: F.when(v != 0, F.abs(v) * 0.5).otherwise(0.5)
        inputs = F.zip_with("x", "n", lambda v, n: v + n * scale(v))
        width = 0.75 * np.sqrt(d)
        near = F.exp(-F.aggregate("n", F.lit(0.0), lambda a, n: a + n * n) / (2 * width ** 2))
        scored = model.transform(s.withColumn("features", array_to_vector(inputs))).select(key, "n", "prediction", near.alias("w"))
        fitted = weighted_ridge(scored, key, "n", "prediction", "w", d)
    names = F.array(*[F.lit(c) for c in cols])
    ranked = F.slice(F.sort_array(F.transform("beta", lambda b, i: F.struct((-F.abs(b)).alias("a"), i.alias("i"), b.alias("b")))), 1, top)
    return fitted.select(key, F.posexplode(ranked)).select(
        key, F.get(names, F.col("col.i")).alias("feature"), F.col("col.b").alias("weight"), (F.col("pos") + 1).alias("rank"))


def global_importance(attr: DataFrame) -> DataFrame:
    return attr.groupBy("feature").agg(F.round(F.avg(F.abs("attribution")), 6).alias("mean_abs"))


def top_features(attr: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("attribution"), 9)), "feature")
    return attr.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def attribution_record(attr: DataFrame, key: str, base: float) -> DataFrame:
    """One JSON record per row: base and features by size (a row has a fixed, small number of features)."""
    f = F.struct((-F.abs("attribution")).alias("neg"), "feature", "value", F.round("attribution", 8).alias("shap"),
                 F.abs("attribution").alias("abs_shap"))
    g = attr.groupBy(key).agg(F.array_sort(F.collect_list(f)).alias("l"))
    items = F.transform("l", lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), s["shap"].alias("shap"),
                                                s["abs_shap"].alias("abs_shap")))
    return g.select(key, F.to_json(F.struct(F.lit(float(base)).alias("base"), items.alias("features"))).alias("record"))


def portfolio_attribution(h: DataFrame, attr: DataFrame, base: float, features: Sequence[str] | None = None) -> DataFrame:
    """Weighted sums of attributions per portfolio and feature, all features ranked by size.

    ``h``: portfolio_id, security_id, weight (fraction).  ``attr``: security_id, feature, attribution; or, with ``features`` given,
    one array ``attributions`` in their order.  A security's attributions are one array (a fixed, small number of features), written
    once and joined whatever the skew; only a few are broadcast.  A portfolio's sums are one row with a column a feature, so a task
    shuffles one row for each portfolio, and features become rows only after that.
    """
    if features is None:
        features = sorted(r["feature"] for r in attr.select("feature").where("feature IS NOT NULL").distinct().collect())
        own = [F.when(F.col("feature") == f, F.col("attribution")) for f in features]
    else:
        own = [F.get("attributions", F.lit(i)) for i in range(len(features))]
    per = cut_lineage(attr.groupBy("security_id").agg(F.array(*[F.sum(a) for a in own]).cast("array<double>").alias("entries")))
    x = skew.join_dimension(h.select("portfolio_id", "security_id", "weight"), per, "security_id", ["portfolio_id"], max_rows=20_000).filter("entries IS NOT NULL")
    g = x.groupBy("portfolio_id").agg(F.sum("weight").alias("coverage"), *[F.sum(F.col("weight") * F.get("entries", F.lit(i))).alias(f"c{i}") for i in range(len(features))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("contribution")) for i, f in enumerate(features)])
    g = g.select("portfolio_id", "coverage", F.filter(rows, lambda r: r["contribution"].isNotNull()).alias("rows"))
    total = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["contribution"])
    g = g.select("portfolio_id", "coverage", total.alias("total"), F.explode("rows").alias("r")).select("portfolio_id", "coverage", "total", "r.*")
    rank = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc(F.round(F.abs("contribution"), 9)), "feature"))  # one row per feature
    return g.select("portfolio_id", "feature", F.round("contribution", 6).alias("contribution"), rank.alias("rank"),
                    F.round(F.col("coverage") * base, 6).alias("base"),
                    F.round(F.col("coverage") * base + F.col("total"), 6).alias("prediction"),
                    F.round("coverage", 6).alias("coverage_weight"))


# Feature groups, the first one with a word in the feature's name wins.
FEATURE_GROUPS = [
    ("ESG Components", "environment|social|governance|esg"), ("Sector", "sector"), ("Market Cap", "marketcap|market_cap"),
    ("Financial Metrics", "pe|trailingpe|revenue|ebitda"), ("Market Behavior", "beta|vol|ret|volatility|return"),
]


def attribution_groups(contributions: DataFrame) -> DataFrame:
    low = F.lower("feature")
    grp = F
    for name, words in FEATURE_GROUPS:
        grp = grp.when(low.rlike(words), F.lit(name))
    names = [n for n, _ in FEATURE_GROUPS] + ["Other"]
    x = contributions.withColumn("grp", grp.otherwise("Other"))
    g = x.groupBy("portfolio_id").agg(*[F.coalesce(F.sum(F.when(F.col("grp") == n, F.col("contribution"))), F.lit(0.0)).alias(f"g{i}")
                                        for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("grp"), F.round(f"g{i}", 6).alias("contribution")) for i, n in enumerate(names)])
    return g.select("portfolio_id", F.explode(rows).alias("r")).select("portfolio_id", F.col("r.grp").alias("feature_group"), "r.contribution")

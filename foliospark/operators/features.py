"""Training features, splits, baselines and model reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.quantiles import exact_medians, to_long
from ..functions.storage import cut_lineage

# Model inputs and the columns that never are.
RAW_NUMERIC = ["marketCap", "trailingPE", "beta", "vol_30d", "ret_1m", "environment_score", "social_score", "governance_score"]
PILLARS = ["environment_score", "social_score", "governance_score"]
NOT_FEATURES = {"symbol", "yf_symbol", "company", "source", "imputed", "label_note", "sector_esg_proxy"}
UNKNOWN = "__UNKNOWN__"
HUGE = 1e18
_NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def detect_features(df: DataFrame, label: str, max_categories: int = 200) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns from the schema and one pass over the text columns."""
    cand = [(c, t) for c, t in df.dtypes if c not in NOT_FEATURES and c != label]
    numeric = [c for c, t in cand if t in _NUMERIC_TYPES or t.startswith("decimal")]
    text = [c for c, _ in cand if c not in numeric]
    other = [c for c in text if c.lower() != "sector"]
    if not other:
        return numeric, text
    facts = df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in other],
                   *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"words_{c}") for c in other]).first()
    numeric += [c for c in other if facts[f"n_{c}"] >= max_categories and not facts[f"words_{c}"]]
    return numeric, [c for c in text if c not in numeric]


def sanitize(c: Column) -> Column:
    """Double, with text that is no number, infinities and absurd sizes as null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) <= HUGE), x)


def sanitize_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sanitize(F.col(c)) for c in cols})


def market_cap_log(df: DataFrame) -> DataFrame:
    return df.withColumn("marketCap_log", F.when(F.col("marketCap") > 0, F.log1p("marketCap")))


class ImputeScale:
    """Median fill, then (x - mean) / population deviation; two numbers per column are kept."""

    def fit(self, train: DataFrame, cols: Sequence[str]) -> ImputeScale:
        self.cols = list(cols)
        self.median = {r["feature"]: r["median"] for r in exact_medians(train, [], cols).collect()}
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.median.get(c))) for c in self.cols]
        row = train.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
                        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
        self.mean = {c: row[f"m{i}"] for i, c in enumerate(self.cols)}
        self.std = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(self.cols)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(self.median.get(c))) - F.lit(self.mean[c]))
                               / F.lit(self.std[c]) for c in self.cols})


class EncodeCategories:
    """One 0/1 column per training category; blank is a category of its own, unseen values give all zeros."""

    def fit(self, train: DataFrame, column: str) -> EncodeCategories:
        values = train.select(F.coalesce(column, F.lit(UNKNOWN)).alias("v")).distinct().collect()  # becomes that many columns
        self.column, self.values = column, sorted(r["v"] for r in values)
        self.names = [f"{column}_{v}" for v in self.values]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        v = F.coalesce(self.column, F.lit(UNKNOWN))
        return df.withColumns({n: F.when(v == x, 1).otherwise(0) for n, x in zip(self.names, self.values)})


class CategoryIndex:
    """One-hot encoding for any number of categories: an index table, joined, and a sparse vector per row.

    ``table`` is (value, index) over the distinct training values in their order, blanks as a category of their own.  It is
    sorted by ranges; a task numbers its own values, and only the number of values per task is summed over tasks.
    """

    def fit(self, train: DataFrame, column: str) -> CategoryIndex:
        self.column = column
        values = train.groupBy(F.coalesce(column, F.lit(UNKNOWN)).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
        part = (values.repartitionByRange("value").sortWithinPartitions("value")
                .select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
        part = cut_lineage(part)
        per_part = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per task
        before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        start = per_part.select("part", F.coalesce(before, F.lit(0)).alias("start"))
        self.table = cut_lineage(part.join(F.broadcast(start), "part").select("value", (F.col("start") + F.col("place")).cast("int").alias("index")))
        self.size = self.table.count()
        return self

    def transform(self, df: DataFrame, out: str, spread: Sequence[str], offset: int = 0, size: int | None = None) -> DataFrame:
        """Add ``out``: struct(size, indices, values); unseen values have no index.  ``offset`` and ``size`` place it in a wider layout."""
        x = df.withColumn("_value", F.coalesce(self.column, F.lit(UNKNOWN)))
        index = self.table.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        j = skew.join_dimension(x, index, "_value", spread, dim_rows=self.size)
        indices = F.array_compact(F.array(F.col("_index") + offset))
        vector = F.struct(F.lit(self.size if size is None else size).alias("size"), indices.alias("indices"),
                          F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
        return j.select(*df.columns, vector.alias(out))


def align_sparse(df: DataFrame, encoders: Sequence[CategoryIndex], numbers: Sequence[str], out: str, spread: Sequence[str]) -> DataFrame:
    """One sparse vector in the training layout: the numbers first, then each encoder's categories; missing ones and zeros have no index."""
    size = len(numbers) + sum(e.size for e in encoders)
    offset, x = len(numbers), df
    for i, e in enumerate(encoders):
        x = e.transform(x, f"_part{i}", spread, offset, size)
        offset += e.size
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    filled = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), number(c).alias("v")) for i, c in enumerate(numbers)]), lambda p: p["v"] != 0) if numbers else None
    parts = [F.col(f"_part{i}") for i in range(len(encoders))]
    joined = lambda field, own: F.concat(*([F.transform(filled, lambda p: p[own])] if numbers else []), *[p[field] for p in parts])
    return x.select(*df.columns, F.struct(F.lit(size).alias("size"), joined("indices", "i").alias("indices"), joined("values", "v").alias("values")).alias(out))


def target_column(columns: Sequence[str]) -> str:
    return next((c for c in ("Approval_Status", "target", "label", "class", "y") if c in columns), columns[-1])


def align_dummies(df: DataFrame, encoders: Sequence[EncodeCategories], columns: Sequence[str]) -> DataFrame:
    """Exactly the training columns in their order: missing ones 0, others dropped."""
    x = reduce(lambda d, e: e.transform(d), encoders, df)
    return x.select(*[F.col(f"`{c}`") if c in x.columns else F.lit(0).alias(c) for c in columns])


def key_digest(key: str, seed: int) -> Column:
    """MD5 of key and seed as text: the same in every engine."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def split_rows(df: DataFrame, key: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """train / val / test from a hash of the key: the same row always falls in the same part."""
    b = F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("bigint") % 10000
    return df.withColumn("split", F.when(b < round(10000 * (1 - test - val)), "train").when(b < round(10000 * (1 - test)), "val").otherwise("test"))


def sample_weight(df: DataFrame, label: str = "total_esg", imputed_weight: float = 0.5, drop_imputed: bool = False) -> DataFrame:
    x = df.filter(F.col(label).isNotNull())
    if drop_imputed:
        x = x.filter(~F.coalesce("imputed", F.lit(False)))
    return x.withColumn("weight", F.when(F.coalesce("imputed", F.lit(False)), imputed_weight).otherwise(1.0))


# sector baselines -------------------------------------------------------------------------------------
def sector_medians(df: DataFrame, cols: Sequence[str] = RAW_NUMERIC) -> DataFrame:
    """Exact medians per sector, and over all rows as sector Other."""
    # every row counts for its sector and for the group of all rows, so the input is read for both at once
    groups = F.array_compact(F.array_distinct(F.array(F.col("sector"), F.lit("Other"))))
    both = df.select(F.explode(groups).alias("sector"), *cols)
    return exact_medians(both, ["sector"], cols).groupBy("sector").pivot("feature", list(cols)).agg(F.first("median"))


def sector_mean_baseline(df: DataFrame, label: str = "total_esg") -> DataFrame:
    """Add ``y_proxy``: the mean label of the sector's real rows, else of all real rows, else 0."""
    real = df.filter(~F.coalesce("imputed", F.lit(False)))
    means = cut_lineage(real.groupBy("sector").agg(F.avg(label).alias("_m"), F.count(label).alias("_n")))  # one row per sector
    overall = means.agg(F.try_divide(F.sum(F.col("_m") * F.col("_n")), F.sum("_n"))).first()[0]
    means = means.drop("_n")
    return df.join(skew.small_side(means), "sector", "left").withColumn(
        "y_proxy", F.coalesce("_m", F.lit(overall).cast("double"), F.lit(0.0))).drop("_m")


# reports ------------------------------------------------------------------------------------------------
def label_stats(df: DataFrame, label: str = "total_esg") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(label).alias("n"), F.round(F.avg(label), 6).alias("mean"), F.round(F.stddev_pop(label), 6).alias("std"),
        F.min(label).alias("min"), F.max(label).alias("max"))


def regression_metrics(df: DataFrame, label: str, prediction: str, prefix: str = "") -> DataFrame:
    y, e = F.col(label), F.col(label) - F.col(prediction)
    g = df.filter(y.isNotNull() & F.col(prediction).isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("var"))
    return g.select("split", F.col("n").alias(prefix + "n"), F.round("mae", 6).alias(prefix + "mae"),
                    F.round(F.sqrt("mse"), 6).alias(prefix + "rmse"), F.round(1 - F.col("mse") / F.col("var"), 6).alias(prefix + "r2"))


def model_vs_baseline(df: DataFrame, label: str, prediction: str, baseline: str) -> DataFrame:
    m, b = regression_metrics(df, label, prediction, "model_"), regression_metrics(df, label, baseline, "baseline_")
    j = m.join(b, "split")
    return j.select("split", "model_mae", "model_rmse", "baseline_mae", "baseline_rmse",
                    F.round(F.col("baseline_mae") - F.col("model_mae"), 6).alias("mae_gain"),
                    F.round(F.col("baseline_rmse") - F.col("model_rmse"), 6).alias("rmse_gain"))


def prediction_diagnostics(df: DataFrame, prediction: str, baseline: str, tol: float = 1e-3) -> DataFrame:
    p = F.col(prediction)
    near = F.abs(p - 50) <= tol + 50 * 1e-5
    return df.agg(F.count(p).alias("n"), F.round(F.avg(p), 6).alias("pred_mean"), F.round(F.stddev_pop(p), 6).alias("pred_std"),
                  F.count_distinct(F.round(p, 6)).alias("unique_predictions"), F.count_if(near).alias("near_50"),
                  F.round(F.avg(F.when(near, 1.0).otherwise(0.0)), 6).alias("near_50_share"),
                  F.round(F.corr(p, F.col(baseline)), 6).alias("corr_with_baseline"))


def feature_variance(df: DataFrame, cols: Sequence[str], low: float = 1e-6, k: int = 30) -> DataFrame:
    """The k features of least variance (a report of at most one row per feature)."""
    v = to_long(df, [], cols).groupBy("feature").agg(F.var_pop("value").alias("v"))
    return v.orderBy("v", "feature").limit(k).select(
        "feature", F.round("v", 9).alias("variance"), (F.col("v") == 0).alias("zero_variance"), (F.col("v") < low).alias("low_variance"))


# filling inputs for scoring -----------------------------------------------------------------------------
def fill_features(base: DataFrame, cached: DataFrame, provider: DataFrame, defaults: DataFrame,
                  cols: Sequence[str] = RAW_NUMERIC) -> DataFrame:
    """Inputs per symbol from the cached row, else the provider row (either only with a market cap), else
    the sector default (sector row, else Other); ``imputed_columns`` lists what came from defaults.

    ``defaults`` is ``sector_medians`` output: one row per sector.
    """
    pack = lambda d, n: d.filter("marketCap IS NOT NULL").select("symbol", F.struct(*cols).alias(n))
    defaults = cut_lineage(defaults)  # used three times below
    side = skew.small_side(defaults)
    own = side.select("sector", F.struct(*cols).alias("_own"))
    other = defaults.filter("sector = 'Other'").select(*cols).first()
    lit_other = lambda c: F.lit(other[c] if other else None).cast("double")
    j = (base.join(pack(cached, "_c"), "symbol", "left").join(pack(provider, "_p"), "symbol", "left")
         .join(own, "sector", "left"))
    raw = F.coalesce("_c", "_p")
    has_own = F.col("_own").isNotNull()
    filled = {c: F.coalesce(raw[c], F.when(has_own, F.col("_own")[c]).otherwise(lit_other(c))) for c in cols}
    missing = F.array_compact(F.array(*[F.when(raw[c].isNull(), F.lit(c)) for c in cols]))
    all_pillars = reduce(lambda a, b: a & b, [raw[c].isNull() for c in PILLARS])
    source = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_p").isNotNull(), "yahoo").otherwise("sector_defaults_complete")
    return j.select(*base.columns, *[x.alias(c) for c, x in filled.items()], missing.alias("imputed_columns"),
                    F.when((source != "sector_defaults_complete") & all_pillars, F.concat(source, F.lit(",sector_defaults_esg")))
                    .otherwise(source).alias("sources"))


def imputation_guard(filled: DataFrame, max_ratio: float = 0.45, cols: Sequence[str] = RAW_NUMERIC) -> DataFrame:
    """Whether a prediction may be made, and the warnings to go with it.

    The ratio counts against all raw inputs: the numeric ones, the log cap and the sector.
    """
    n_raw = len(cols) + 2
    ratio = F.size("imputed_columns") / F.lit(n_raw)
    values = F.filter(F.array(*cols), lambda x: x.isNotNull())
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    x = filled.withColumn("_v", values).withColumn("_m", mean(F.col("_v")))
    var = F.aggregate("_v", F.lit(0.0), lambda s, v: s + (v - F.col("_m")) * (v - F.col("_m"))) / F.size("_v")
    pillars = reduce(lambda a, b: a & b, [F.array_contains("imputed_columns", p) for p in PILLARS])
    return x.withColumns({
        "imputation_ratio": F.round(ratio, 6), "predictable": F.round(ratio, 6) <= max_ratio, "all_pillars_imputed": pillars,
        "low_variance": F.coalesce((F.size("_v") > 1) & (var < 1e-6), F.lit(False)),
        "reason": F.when(F.round(ratio, 6) > max_ratio, "model_failed_too_many_imputed").otherwise("predicted_by_model"),
    }).drop("_v", "_m")

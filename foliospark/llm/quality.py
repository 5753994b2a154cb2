"""Quality rules with risk-controlled cutoffs.

Base measurements come from whole texts by column expressions.  Beyond the fixed base rule, each rule compares one ratio with
a cutoff.  Cutoffs are chosen on labelled documents, for every stratum (band of document length) by itself.  Step i of a fixed
sequence takes every rule at its i-th loosest cutoff; the good documents that any of them would reject are counted, and the
exact binomial tail P(X <= rejected | n, limit) tests whether the joint rate of false rejection exceeds `limit`.  Steps are
tested from the loosest to the strictest until the first one fails, which needs no correction within a stratum; the strata share
`error` equally.  So with probability 1 - `error` at least, no stratum loses more than `limit` of its good documents.  The last
step before a failure is taken; a stratum without one stays off, however few labels there are.  `certify` is the stricter
choice of each rule by itself, with Bonferroni's correction over all candidates (`joint=False`).

Defined results: a null or empty text has no words and fails the base rule; repeated rows are measured row by row; documents
without labels and labels without documents do not enter the choice; extra columns are not read; with no labels only the
base rule rejects; a ratio equal to its cutoff is kept, and documents of equal ratios are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, total
from .work import stash

SPACE = r"[\x20\x09-\x0D]+"
BANDS = (100, 300, 1000)  # words; strata by document length
CUTOFFS = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "duplicate_line_ratio": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "capital_ratio": (0.1, 0.2, 0.3, 0.5, 0.7),
    "mark_ratio": (0.1, 0.15, 0.2, 0.3, 0.5),
    "mean_word": (7.0, 8.0, 10.0, 12.0, 15.0),
}


def _repeated(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more: windows by hash, sorted, neighbours compared."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 8), lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(8))))
    def twice(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])), lambda x: x["i"])))
    covered = lambda p: total(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(8), F.get(p, j + 1) - x), F.lit(8)).cast("bigint")))
    return F.when(F.size(hashes) < 8, F.lit(0).cast("bigint")).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(twice(w), covered))))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(value, SPACE), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                                           let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words")))
    lines = F.filter(F.split(value, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("bigint")
    return (docs.select(F.col(key), counts.alias("words"), line_counts.alias("lines"), count(r"[#*$%&|<>]").alias("n_symbols"),
                        count(r"[A-Z]").alias("n_capitals"), count(r"[!-/:-@\[-`{-~]").alias("n_marks"))
            .select(key, "words.n_words", "words.word_chars", "n_symbols", "lines.n_dup_lines", "words.n_repeat_words", "lines.n_lines", "n_capitals", "n_marks"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The measured ratio of each rule; null (never rejected) where it has no meaning."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return {"symbol_ratio": share("n_symbols", "n_words"), "duplicate_line_ratio": share("n_dup_lines", "n_lines"),
            "repeat_ratio": share("n_repeat_words", "n_words"), "capital_ratio": share("n_capitals", "word_chars"),
            "mark_ratio": share("n_marks", "word_chars"), "mean_word": share("word_chars", "n_words")}


def stratum() -> Column:
    band = F.lit(0)
    for i, least in enumerate(BANDS):
        band = F.when(F.col("n_words") >= least, i + 1).otherwise(band)
    return band


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed from the term of k downwards until terms vanish.

    The term of k comes from the sum of logarithms, at most `k` steps; a k beyond the mean is no evidence, so 1 stands for it.
    """
    import math
    odds = math.log(rate / (1 - rate))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    state = F.struct((n * math.log1p(-rate)).alias("term"), F.exp(n * math.log1p(-rate)).alias("sum"))
    grown = F.aggregate(steps, state, lambda s, i: let(s["term"] + F.log((n - i + 1) / i) + odds, lambda t: F.struct(t.alias("term"), (s["sum"] + F.exp(t)).alias("sum"))), lambda s: s["sum"])
    return F.when(k > n * rate, F.lit(1.0)).otherwise(grown)


def certify(measured: DataFrame, labels: DataFrame, key: str = "doc_id", good: Column | None = None, limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """The certified candidates: stratum, rule, cutoff, n (good labelled documents), rejected, p."""
    good = F.col("quality") == 1 if good is None else good
    chosen = labels.where(good).select(F.col(key)).distinct()
    value, tests = ratios(), (len(BANDS) + 1) * sum(map(len, CUTOFFS.values()))
    counts = [F.sum((value[r] > c).cast("bigint")).alias(f"{r}_{j}") for r, cs in CUTOFFS.items() for j, c in enumerate(cs)]
    per_stratum = measured.where(~base_failed()).join(chosen, key).groupBy(stratum().alias("stratum")).agg(F.count("*").alias("n"), *counts)
    candidates = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.coalesce(F.col(f"{r}_{j}"), F.lit(0).cast("bigint")).alias("rejected"))
                           for r, cs in CUTOFFS.items() for j, c in enumerate(cs)])
    rows = per_stratum.select("stratum", "n", F.explode(candidates).alias("c")).select("stratum", "n", "c.*")
    return rows.withColumn("p", binomial_tail(F.col("rejected"), F.col("n"), limit / len(CUTOFFS))).where(F.col("p") <= error / tests)


def steps() -> list[dict[str, float]]:
    """The cutoffs of each step: the i-th loosest of every rule, or its strictest where it has fewer."""
    loosest = {r: sorted(cs, reverse=True) for r, cs in CUTOFFS.items()}
    return [{r: cs[min(i, len(cs) - 1)] for r, cs in loosest.items()} for i in range(max(map(len, CUTOFFS.values())))]


def rejected_by(step: dict[str, float]) -> Column:
    """Any rule's ratio lies above its cutoff."""
    value, fires = ratios(), F.lit(False)
    for r, cutoff in step.items():
        fires = fires | F.coalesce(value[r] > cutoff, F.lit(False))
    return fires


def certify_steps(measured: DataFrame, labels: DataFrame, key: str = "doc_id", good: Column | None = None, limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """All certified steps: stratum, step (from 0), n (good labelled documents), rejected, p."""
    good = F.col("quality") == 1 if good is None else good
    chosen, sequence = labels.where(good).select(F.col(key)).distinct(), steps()
    counts = [F.count_if(rejected_by(s)).alias(f"s{i}") for i, s in enumerate(sequence)]
    per_stratum = measured.where(~base_failed()).join(chosen, key).groupBy(stratum().alias("stratum")).agg(F.count("*").alias("n"), *counts)
    tested = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"s{i}").alias("rejected"), binomial_tail(F.col(f"s{i}"), F.col("n"), limit).alias("p")) for i in range(len(sequence))])
    level = error / (len(BANDS) + 1)
    passed = let(tested, lambda t: F.filter(t, lambda x, i: F.forall(F.slice(t, 1, i + 1), lambda y: y["p"] <= level)))
    return per_stratum.select("stratum", "n", F.explode(passed).alias("c")).select("stratum", "c.step", "n", "c.rejected", "c.p")


def fires(measured: DataFrame, labels: DataFrame, key: str, limit: float, error: float, joint: bool) -> Column:
    """The certified cutoffs as one condition on the measurements."""
    out = F.lit(False)
    if joint:
        last = certify_steps(measured, labels, key, limit=limit, error=error).groupBy("stratum").agg(F.max("step").alias("step"))
        for row in last.collect():  # at most one row for each stratum
            out = out | ((stratum() == row["stratum"]) & rejected_by(steps()[row["step"]]))
        return out
    lowest = certify(measured, labels, key, limit=limit, error=error).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    for row in lowest.collect():  # at most one for each of the few strata and rules
        out = out | ((stratum() == row["stratum"]) & rejected_by({row["rule"]: row["cutoff"]}))
    return out


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.02, error: float = 0.05, joint: bool = True) -> DataFrame:
    """Measurements of every document with base_failed and kept."""
    measured = stash(measure(docs, key, text), "quality")
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fires(measured, labels, key, limit, error, joint))

"""Secrets in text: fixed patterns, and tokens that pass a battery of randomness tests.

Every run of token characters gets the alphabet it seems to be written in (hexadecimal, base 32, lower-case or mixed letters
and digits, base 64) and three tests against the hypothesis that it is a random string over it: chi-squared uniformity of its
characters, the runs test about the middle of the alphabet, and the serial correlation of neighbours.  Fisher's method
joins the three p values.  Rejecting the hypothesis clears a token as structured text.  The Benjamini-Hochberg procedure, by
band of length, since short strings reject less easily, bounds the share of random strings among the cleared
tokens of each band by `rate`; p values are counted in fine steps, so its threshold needs one small table and no global
sort.  Tokens that stay are secrets, in addition to the fixed patterns, if they hold letters and digits.

Defined results: a null or empty text has no spans; copies and repeated rows have their own spans; offsets are code points
with exclusive ends; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, matches, total, upper_tail
from .work import stash

# Pattern, group whose length counts, least length.
KINDS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # the leftmost longest runs of at least 16 are the runs of `[0-9a-f]+` that stay
}
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
# Alphabets in their natural order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=",
}
BANDS = (24, 32, 48)  # token lengths that begin a new band
STEPS = 20            # counted steps of p for each power of ten
LEAST = 18            # powers of ten that are told apart


def encoding(token: Column) -> Column:
    """The alphabet a token seems to be written in."""
    return (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32")
            .when(token.rlike("^[a-z0-9]+$"), "lower").when(token.rlike("^[A-Za-z0-9]+$"), "mixed").otherwise("base64"))


def _alphabet(kind: Column) -> Column:
    out = F.lit(ALPHABETS["base64"])
    for name, letters in ALPHABETS.items():
        out = F.when(kind == name, letters).otherwise(out)
    return out


def randomness(token: Column) -> Column:
    """The joint p value of the battery: small means structured."""
    def battery(text: Column, letters: Column) -> Column:
        size, wide = F.length(text).cast("double"), F.length(letters).cast("double")
        codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.position(F.substr(text, i, F.lit(1)), letters).cast("double"))
        each = F.transform(F.sequence(F.lit(1), F.length(letters)), lambda i: (F.length(text) - F.length(F.replace(text, F.substr(letters, i, F.lit(1)), F.lit("")))).cast("double"))
        squares = F.aggregate(each, F.lit(0.0), lambda a, n: a + n * n)
        chi = squares * wide / size - size
        uniform = upper_tail((chi - (wide - 1)) / F.sqrt(2 * (wide - 1) * (1 - 1 / size)))

        def runs(x: Column) -> Column:
            high = total(F.transform(x, lambda v: (v > wide / 2).cast("bigint"))).cast("double")
            low, turns = size - high, F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(1.0), lambda a, i: a + (((F.get(x, i) > wide / 2) != (F.get(x, i - 1) > wide / 2)).cast("double")))
            mean = 2 * high * low / size + 1
            spread = F.sqrt((mean - 1) * (mean - 2) / (size - 1))
            return F.when((high == 0) | (low == 0) | (mean <= 2), F.lit(1e-6)).otherwise(F.least(F.lit(1.0), 2 * upper_tail(F.abs(turns - mean) / spread)))

        def serial(x: Column) -> Column:
            mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / size
            return let(mean, lambda m: let(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), lambda var: F.when(var == 0, F.lit(1e-6)).otherwise(
                F.least(F.lit(1.0), 2 * upper_tail(F.abs(F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + (F.get(x, i) - m) * (F.get(x, i - 1) - m)) / var + 1 / size) * F.sqrt(size))))))

        half = let(codes, lambda x: -(F.log(uniform) + F.log(F.greatest(runs(x), F.lit(1e-18))) + F.log(F.greatest(serial(x), F.lit(1e-18)))))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # Fisher's statistic has six degrees of freedom

    lowered = F.when(token.rlike("^[0-9A-F]+$"), F.lower(token)).otherwise(token)
    return let(lowered, lambda t: let(_alphabet(encoding(t)), lambda a: battery(t, a)))


def band(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(length >= least, i + 1).otherwise(out)
    return out


def step(p: Column) -> Column:
    """Number of the counted step of a p value; the step's upper edge is 10 ** (-step / STEPS)."""
    return F.floor(-F.log10(F.greatest(p, F.lit(10.0 ** -LEAST))) * STEPS).cast("int")


def scan(docs: DataFrame, kept: Column, text: str = "text") -> DataFrame:
    """Base spans and tested tokens of every document: kept, base (start, rank, kind, end), tokens (start, end, band, step)."""
    value = F.coalesce(F.col(text), F.lit(""))
    def base(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(matches(value, pattern, group), lambda m: F.length(m["part"]) >= least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    kinds = [base(order, kind, *rule) for order, (kind, rule) in enumerate(KINDS.items())]
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    tokens = F.transform(F.filter(matches(value, TOKEN), lambda m: mixed(m["part"])), lambda m: F.struct(
        m["start"], m["end"], band(F.length(m["part"])).alias("band"), step(randomness(m["part"])).alias("step")))
    return docs.select(kept, F.sort_array(F.concat(*kinds)).alias("base"), tokens.alias("tokens"))


def thresholds(scanned: DataFrame, rate: float = 0.1) -> dict[int, int]:
    """For each band, the least step at which tokens are cleared as structured (Benjamini-Hochberg); bands without one are absent."""
    from pyspark.sql import Window
    counted = scanned.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.step").count()
    below = counted.withColumn("up_to", F.sum("count").over(Window.partitionBy("band").orderBy(F.desc("step")))).withColumn("all", F.sum("count").over(Window.partitionBy("band")))
    edge = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    return {r["band"]: r["least"] for r in below.where(edge <= rate * F.col("up_to") / F.col("all")).groupBy("band").agg(F.min("step").alias("least")).collect()}


def spans(cleared: dict[int, int]) -> Column:
    """All spans of a scanned row: the base ones, and tokens that stay random and lie in no base span."""
    def structured(t: Column) -> Column:
        out = F.lit(False)
        for number, least in cleared.items():
            out = out | ((t["band"] == number) & (t["step"] >= least))
        return out

    added = F.filter("tokens", lambda t: ~structured(t) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = F.transform(added, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("random").alias("kind"), t["end"].alias("end")))
    return F.sort_array(F.concat("base", added))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.1) -> DataFrame:
    """Per document: key, base and spans, arrays of (start, rank, kind, end) in order."""
    scanned = stash(scan(docs, F.col(key), text), "secrets")
    return scanned.select(key, "base", spans(thresholds(scanned, rate)).alias("spans"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", rate: float = 0.1, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by `mask` and n_chars brought up to date where a text changed."""
    scanned = stash(scan(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text), "secrets")
    joined = lambda s: F.aggregate(s, F.array().cast("array<struct<start: bigint, end: bigint>>"), lambda a, x: F.when(  # noqa: E731  overlapping spans become one
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(
                F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    value = F.col("row")[text]
    cut = lambda s: F.concat(F.array_join(F.transform(s, lambda x, i: F.concat(
        F.substr(value, (F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0) + 1).cast("int"), (x["start"] - F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0)).cast("int")), F.lit(mask))), ""),
        F.substr(value, (F.element_at(s, -1)["end"] + 1).cast("int")))
    changed = scanned.withColumn("spans", spans(thresholds(scanned, rate)))
    new = F.when(F.size("spans") > 0, let(joined(F.col("spans")), cut)).otherwise(value)
    done = changed.select("row", F.size("spans").alias("found"), new.alias("new"))
    chars = F.when(F.col("found") > 0, F.length("new")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return done.select(*[(F.col("new") if c == text else chars if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])

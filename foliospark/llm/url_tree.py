"""URL verdicts from rules and from a tree of path templates.

Rules name a host with its subdomains and a path prefix; the longest fitting rule decides.  For other URLs a tree of path
templates is learnt per host.  Digits and long hexadecimal runs of a segment become placeholders, and equal shapes are
counted first, so that the tree grows on counts and not on URLs.  Then the tree is built level by level: below a node, the
branches of a segment with many different values, and labelled branches whose share of blocked pages does not
differ significantly from that of their siblings, are merged into a wildcard; others keep their text.  Unlabelled branches share the
wildcard of labelled ones only when at least `SIBLINGS` labelled branches, and the share `AGREE` of all labelled ones, were
merged into it; else they have a wildcard of their own.  A template is rejected when its share
of blocked labelled pages, smoothed towards `prior`, reaches `least`; templates without labels are therefore allowed.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is judged with the empty host;
repeated rows count each; an empty table gives no rows; columns other than the key and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import stash

LEVELS = 6          # segments that get a tree level of their own; the rest of a longer path is one last segment
MANY = 20           # different values of a segment that make it variable
SIMILAR = 1.96      # standard errors
SIBLINGS = 5        # labelled branches that must agree before unlabelled ones are judged by them
AGREE = 0.8
WEIGHT = 4.0        # pages that the prior counts for
PRIOR = 0.25
LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rule (host and path) and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), rule).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of a path with digits and long hexadecimal runs replaced, at most one more than the levels."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}"))
    return F.when(F.size(general) > LEVELS, F.concat(F.slice(general, 1, LEVELS), F.array(F.lit("**")))).otherwise(general)


def templates(pages: DataFrame, prior: float = PRIOR, weight: float = WEIGHT) -> DataFrame:
    """From pages with host, shape and blocked (0, 1, null: not labelled): host, shape, template, n, labelled, blocked, purity."""
    counted = stash(pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("bigint").alias("blocked")), "shapes")
    longest = counted.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = counted.withColumn("template", F.lit(""))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    for level in range(longest):
        tree = tree.withColumn("segment", F.get("shape", F.lit(level)))
        branches = tree.where("segment is not null").groupBy("host", "template", "segment").agg(*sums)
        nodes = branches.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        rest, pooled = F.col("all_labelled") - F.col("labelled"), (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
        gap = F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - F.try_divide(F.col("all_blocked") - F.col("blocked"), rest))
        similar = F.coalesce(gap <= SIMILAR * F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest))), F.lit(False))
        marked = branches.join(nodes, ["host", "template"]).withColumn("similar", similar)
        agreed = marked.groupBy("host", "template").agg(F.count_if("similar").alias("agreeing"), F.count_if(F.col("labelled") > 0).alias("tagged"))
        evident = (F.col("agreeing") >= SIBLINGS) & (F.col("agreeing") >= AGREE * F.col("tagged"))
        wild = F.when(F.col("similar") & (F.col("branches") > 1), "*").when((F.col("branches") > MANY) & (F.col("labelled") == 0), F.when(evident, "*").otherwise("?"))
        named = marked.join(agreed, ["host", "template"]).select("host", "template", "segment", F.coalesce(wild, "segment").alias("named"))
        tree = (tree.join(named, ["host", "template", "segment"], "left")
                .withColumn("template", F.when(F.col("named").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "named"))).drop("segment", "named"))
        tree = stash(tree, "templates")
    whole = tree.groupBy("host", "template").agg(*sums).withColumn("purity", (F.col("blocked") + weight * prior) / (F.col("labelled") + weight))
    return tree.select("host", "shape", "template").join(whole, ["host", "template"])


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, least: float = LEAST) -> DataFrame:
    """Per page: key, host, path, rule, verdict.  The rules' own verdicts are the labels of the template tree."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    labelled = parsed.withColumn("by_rule", by_rule).withColumn("blocked", (F.col("by_rule") == "block").cast("int"))
    rejected = templates(labelled).where(F.col("purity") >= least).select("host", "shape", F.lit("block").alias("by_template"))
    return (labelled.join(rejected, ["host", "shape"], "left")
            .select(key, "host", "path", "rule", F.coalesce("by_rule", "by_template", F.lit("allow")).alias("verdict")))

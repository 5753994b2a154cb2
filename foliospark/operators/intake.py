"""Broker files and raw holdings to clean, valued holdings.

A file is data, not schema: every line of every file is a row ``(file_id, pos, line)`` with ``pos``
giving the order within the file, and header, section and column mapping of a file are columns too, so one
job handles any number of files.  Per-file facts are numeric min / max / count aggregates (combined
map-side); no line list of a file is ever gathered, so one huge file is no special case.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import skew
from ..functions import text as T
from ..functions.storage import cut_lineage


def _any_in(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _alternation(words) -> str:
    """Regex for any of the words, grouped by first letter so that few branches are tried per position."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?:" + "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in groups.items()) + ")"


def _in_list(values) -> str:
    return "array(" + ", ".join(L.sql_literal(v) for v in values) + ")"


# one line at a time --------------------------------------------------------------------------------
def line_facts(lines: DataFrame, strict_totals: bool = True) -> DataFrame:
    """Everything about a line that needs only that line."""
    low = F.lower("line")
    cells = F.transform(F.split("line", ","), lambda c: F.trim(c))
    x = lines.select("file_id", "pos", "line", low.alias("low"), cells.alias("cells"),
                     (F.trim("line") == "").alias("blank"))
    full = F.size(F.filter("cells", lambda c: c != ""))
    commas = F.size("cells") - 1
    un = _any_in(F.col("low"), ["unrealised", "unrealized"])
    unreal = un & _any_in(F.col("low"), ["trades", "holdings", "as on"])
    real = _any_in(F.col("low"), ["realised", "realized"]) & F.col("low").contains("trades") & ~unreal
    title = ~F.col("blank") & (full <= 3)
    # a match starts where a cell starts, so this counts the cells that hold a word; most data lines hold
    # none, which plain substring tests find out faster than the pattern
    score = F.when(_any_in(F.col("low"), L.HEADER_WORDS),
                   F.regexp_count("low", F.lit("(?:^|,)[^,]*?" + _alternation(L.HEADER_WORDS)))).otherwise(0)
    skip = (F.col("blank") | _any_in(F.col("low"), L.PREAMBLE_WORDS)
            | (_any_in(F.col("low"), L.SECTION_TITLES) & (commas < 2)) | (F.size("cells") < 3))
    # cells that are not empty and not a number
    texty = F.regexp_count("line", F.lit(r"(?:^|,) *(?=[^, ])(?! *[.\-]*[0-9][0-9.\-]* *(?:,|$))"))
    first = F.lower(F.get("cells", F.lit(0)))
    total = (first.rlike("^(" + "|".join(L.TOTAL_WORDS) + ")") if strict_totals else _any_in(F.col("low"), L.TOTAL_WORDS))
    return x.select(
        "file_id", "pos", "line", "cells", "blank",
        F.when(title & unreal, "unrealised").when(title & real, "realised").alias("section"),
        commas.alias("commas"), F.when(~skip, score).otherwise(0).alias("score"),
        (~skip & (F.size("cells") >= 4) & (texty >= 2)).alias("wide_text"),
        (~F.col("blank") & ~total & ~first.isin("", "na", "n/a", "null")).alias("is_row"))


# sections and headers, per file --------------------------------------------------------------------
def find_sections(facts: DataFrame, prefer_holdings: bool = True) -> DataFrame:
    """Per file: n_rows, and start, end and drop_title of the preferred section (null if it has none).

    The last unrealised section, else the last one (the first one without ``prefer_holdings``); it ends at the
    next section title.
    """
    titles = facts.filter("section IS NOT NULL").select("file_id", "pos", "section", "commas")
    start = titles.groupBy("file_id").agg(
        F.coalesce(F.max(F.when(F.col("section") == "unrealised", F.col("pos"))), F.max("pos") if prefer_holdings else F.min("pos")).alias("start"))
    chosen = titles.join(start, "file_id").groupBy("file_id", "start").agg(
        F.min(F.when(F.col("pos") > F.col("start"), F.col("pos"))).alias("end"),
        F.max(F.when(F.col("pos") == F.col("start"), F.col("commas"))).alias("c")
    ).select("file_id", "start", "end", F.col("c").between(1, 2).alias("drop_title"))
    return facts.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows")).join(chosen, "file_id", "left")


def _in_section() -> Column:
    """The line belongs to the part of the file that is read first: needs pos, start, end and drop_title."""
    inside = (F.col("pos") >= F.col("start")) & (F.col("end").isNull() | (F.col("pos") < F.col("end"))) & ~(
        F.col("drop_title") & (F.col("pos") == F.col("start")))
    return F.coalesce(inside, F.lit(True))


def mark_section(facts: DataFrame, sections: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Add ``in_section``: the line belongs to the part of the file that is read first."""
    j = skew.attach(facts, sections, ["file_id"], ["pos"], hot_rows=hot_rows)
    return j.select(*facts.columns, _in_section().alias("in_section"))


_FAR = "cast('100000000000000000000' AS decimal(21,0))"  # more than any position


def find_header(marked: DataFrame) -> DataFrame:
    """file_id, header_pos, whole_file, status, n_rows.

    Header: first line with three or more cells holding a finance word; else the first with most such
    cells; else the first wide line with two text cells.  The section is used unless it has under three
    lines or no data rows.  Status is ok, too short, no header or no data rows.
    """
    def part(name, cond):
        when = lambda c, v: F.when(cond & c, v)
        pos, sc = F.col("pos"), F.col("score")
        best = sc.cast("decimal(18,0)") * F.expr(_FAR) - pos
        return [F.count_if(cond).alias(f"{name}_n"),
                F.min(when(sc >= 3, pos)).alias(f"{name}_h1"),
                F.max_by(when(sc >= 1, pos), when(sc >= 1, best)).alias(f"{name}_h2"),
                F.min(when(F.col("wide_text"), pos)).alias(f"{name}_h3"),
                F.max(when(F.col("is_row"), pos)).alias(f"{name}_last")]
    span = marked.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.when(~F.col("blank"), F.col("pos"))).alias("lo"),
        F.max(F.when(~F.col("blank"), F.col("pos"))).alias("hi"), *part("s", F.col("in_section")), *part("w", F.lit(True)))
    h = {k: F.coalesce(f"{k}_h1", f"{k}_h2", f"{k}_h3") for k in "sw"}
    x = span.select("*", (F.col("s_n") < 3).alias("short"), h["s"].alias("s_h"), h["w"].alias("w_h"))
    head1 = F.when(F.col("short"), F.col("w_h")).otherwise(F.col("s_h"))
    last1 = F.when(F.col("short"), F.col("w_last")).otherwise(F.col("s_last"))
    x = x.withColumn("head1", head1).withColumn("ok1", F.coalesce(last1 > head1, F.lit(False)))
    retry = ~F.col("ok1") & ~F.col("short") & (F.col("s_n") < F.col("w_n")) & F.col("head1").isNotNull()
    ok2 = retry & F.coalesce(F.col("w_last") > F.col("w_h"), F.lit(False))
    status = (F.when(F.col("n_rows") < 2, "too short").when(F.col("lo").isNull() | (F.col("lo") == F.col("hi")), "too short")
              .when(F.col("head1").isNull(), "no header").when(F.col("ok1") | ok2, "ok").otherwise("no data rows"))
    return x.select("file_id", "n_rows", F.when(F.col("ok1"), F.col("head1")).when(ok2, F.col("w_h")).otherwise(F.col("head1")).alias("header_pos"),
                    F.when(F.col("ok1"), F.col("short")).otherwise(F.lit(True)).alias("whole_file"), status.alias("status"))


# header text ----------------------------------------------------------------------------------------
def detect_broker(cells: Column) -> Column:
    """First broker with 60 percent of its marks in the header text, else Generic."""
    groups: dict[str, list[str]] = {}
    for _, broker, token in L.TABLES["broker_signature"][1]:
        groups.setdefault(broker, []).append(token.lower())
    table = "array(" + ", ".join(f"named_struct('broker', {L.sql_literal(b)}, 'tokens', {_in_list(t)})" for b, t in groups.items()) + ")"
    text = F.lower(F.array_join(cells, " "))
    hit = F.filter(F.expr(table), lambda b: F.size(F.filter(b["tokens"], lambda t: F.contains(text, t)))
                   >= F.size(b["tokens"]) * 0.6)
    return F.coalesce(F.get(hit, F.lit(0))["broker"], F.lit("Generic"))


FIELDS = [f for f, _ in L.COLUMN_ALIAS]
NUMERIC_FIELDS = [f for f in FIELDS if f != "stock_name"]


def map_columns(cells: Column) -> dict[str, Column]:
    """Per canonical field the index of the first header cell spelled like one of its aliases (null if none)."""
    out = {}
    for field, aliases in L.COLUMN_ALIAS:
        table = F.expr(_in_list(aliases))
        known = F.transform(cells, lambda c: F.array_contains(table, c))  # noqa: B023 (used at once)
        pos = F.array_position(known, True)
        out[field] = F.when(pos > 0, (pos - 1).cast("int"))
    return out


def read_headers(facts: DataFrame, headers: DataFrame) -> DataFrame:
    """Per good file: broker, header cells and the column index of each field.

    Only lines that can be a header meet the headers, by file and position, so no file is a hot key.
    """
    at = headers.filter("status = 'ok'").select(F.col("file_id").alias("_file"), F.col("header_pos").alias("_pos"))
    can_be = facts.filter("score >= 1 OR wide_text").select("file_id", "pos", "cells")
    # a header is a single line; max() only guards against repeated positions
    line = (can_be.join(at, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("pos") == F.col("_pos")))
            .groupBy("file_id").agg(F.max("cells").alias("header")))
    m = map_columns(F.col("header"))
    return line.select("file_id", "header", detect_broker(F.col("header")).alias("broker"),
                       *[c.alias("i_" + f) for f, c in m.items()])


def extract_rows(facts: DataFrame, sections: DataFrame, headers: DataFrame, mapping: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Data rows of all files with canonical fields; missing cells of short rows count as empty.

    What is known of a file (section, header, mapping) is put together first, so its lines are joined once.
    """
    info = (headers.filter("status = 'ok'").select("file_id", "n_rows", "header_pos", "whole_file").join(mapping.drop("header"), "file_id")
            .join(sections.select("file_id", "start", "end", "drop_title"), "file_id", "left"))
    j = skew.attach(facts.filter("is_row").select("file_id", "pos", "cells"), info, ["file_id"], ["pos"], hot_rows=hot_rows)
    rows = j.filter(F.col("header_pos").isNotNull() & (F.col("pos") > F.col("header_pos")) & (F.col("whole_file") | _in_section()))
    cell = lambda f: F.when(F.col("i_" + f).isNotNull(), F.coalesce(F.get("cells", F.col("i_" + f)), F.lit("")))
    return rows.select("file_id", "pos", "broker", cell("stock_name").alias("stock_name"),
                       *[F.when(F.col("i_" + f).isNotNull(), T.clean_numeric(cell(f))).alias(f) for f in NUMERIC_FIELDS])


class BrokerFiles:
    """The steps over one set of lines.

    Line facts and the small per-file tables are written to the shared folder when first used: every step
    then reads plain tables instead of repeating the ones before it.
    """

    def __init__(self, lines: DataFrame, strict_totals: bool = True, hot_rows: int = skew.HOT_ROWS, prefer_holdings: bool = True):
        self.lines, self.strict_totals, self.hot_rows, self.prefer_holdings = lines, strict_totals, hot_rows, prefer_holdings

    @cached_property
    def facts(self) -> DataFrame:
        return cut_lineage(line_facts(self.lines, self.strict_totals))

    @cached_property
    def sections(self) -> DataFrame:
        return cut_lineage(find_sections(self.facts, self.prefer_holdings))

    @cached_property
    def marked(self) -> DataFrame:
        return mark_section(self.facts, self.sections, self.hot_rows)

    @cached_property
    def headers(self) -> DataFrame:
        return cut_lineage(find_header(self.marked))

    @cached_property
    def mapping(self) -> DataFrame:
        return cut_lineage(read_headers(self.facts, self.headers))

    @cached_property
    def rows(self) -> DataFrame:
        return extract_rows(self.facts, self.sections, self.headers, self.mapping, self.hot_rows)


def upload_report(files: BrokerFiles) -> DataFrame:
    """Broker, mapped columns, row count and three sample names per file (or why it could not be read)."""
    w = Window.partitionBy("file_id").orderBy("pos", "stock_name")
    rows = cut_lineage(files.rows.select("file_id", "pos", "stock_name"))  # read for the sample and for the count
    sample = (rows.select("file_id", "pos", "stock_name", F.row_number().over(w).alias("rn")).filter("rn <= 3")
              .groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rn", "stock_name"))).alias("s")))
    n = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows_parsed"))
    mapped = F.concat_ws(", ", *[F.when(F.col("i_" + f).isNotNull(), F.concat(F.lit(f + "="), F.get("header", F.col("i_" + f))))
                                 for f in FIELDS])
    m = files.mapping.select("file_id", "broker", mapped.alias("columns_mapped"))
    return (files.headers.select("file_id", "status").join(m, "file_id", "left").join(n, "file_id", "left")
            .join(sample, "file_id", "left")
            .select("file_id", "status", "broker", "columns_mapped", F.coalesce("rows_parsed", F.lit(0)).cast("bigint").alias("rows_parsed"),
                    F.concat_ws(" | ", F.transform("s", lambda x: x["stock_name"])).alias("sample"))
            .withColumn("columns_mapped", F.coalesce("columns_mapped", F.lit(""))))


# columns of wide holdings tables ----------------------------------------------------------------------
_DATE_HEADER = re.compile(r"^\s*(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|\w{3,9}\s+\d{1,2},?\s*\d{4})\s*$")
# Formats a date header may have.
_DATE_FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%Y/%m/%d", "%b %d, %Y", "%d %b %Y", "%d-%b-%Y", "%d %B %Y"]


def header_date(text: str) -> dt.date | None:
    for fmt in _DATE_FORMATS:
        try:
            return dt.datetime.strptime(text.strip(), fmt).date()
        except ValueError:
            pass
    return None


def date_price_columns(columns: list[str]) -> list[tuple[str, dt.date | None]]:
    """Headers that are dates or previous prices: dated ones newest first, then the rest as found."""
    found = [c for c in columns if _DATE_HEADER.match(c.strip())
             or ("prev" in c.lower() and ("close" in c.lower() or "price" in c.lower()))]
    dated = sorted(((c, header_date(c)) for c in found if header_date(c)), key=lambda x: x[1])
    return dated[::-1] + [(c, None) for c in found if not header_date(c)]


def newest_price(df: DataFrame) -> Column:
    """First positive price in ``date_price_columns`` order."""
    cols = [F.when(F.col(f"`{c}`") > 0, F.col(f"`{c}`")) for c, _ in date_price_columns(df.columns)]
    return F.coalesce(*cols) if cols else F.lit(None).cast("double")


def unpivot_date_prices(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header, dt, price) with one row per positive price."""
    cols = date_price_columns(df.columns)
    long = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c, _ in cols]).unpivot(
        keys, [f"`{c}`" for c, _ in cols], "header", "price").filter("price > 0")
    date = F
    for c, d in cols:
        if d:
            date = date.when(F.col("header") == c, F.lit(d))
    return long.withColumn("dt", date.otherwise(F.lit(None).cast("date")) if date is not F else F.lit(None).cast("date"))


# Spellings by role, in order of preference.
ROLE_PATTERNS = {
    "stock_name": ["company", "stock name", "security name", "name", "scrip", "security"],
    "symbol": ["symbol", "ticker", "scrip code", "nse symbol", "bse symbol", "trading symbol"],
    "isin": ["isin", "isin code", "isin number"],
    "sector": ["sector", "industry", "sector name"],
    "quantity": ["qty", "quantity", "shares", "units"],
    "current_price": ["ltp", "last traded price", "cmp", "current market price", "current price", "price"],
    "current_value": ["current value", "market value", "current_value", "market_value"],
    "invested_value": ["invested value", "invested", "cost", "invested_value"],
    "avg_price": ["avg cost", "avg. cost", "average cost", "avg_cost", "buy price"],
    "pnl": ["p&l", "pnl", "profit loss", "gain loss", "profit/loss", "unrealized p&l", "unrealized profit/loss",
            "unrealized profit / loss", "unrealised profit/loss", "unrealised p&l", "realized profit/loss",
            "realised profit/loss", "profit & loss", "gain/loss", "profit / loss"],
    "change_pct": ["%chg", "% chg", "change%", "change %", "day change%", "% change"],
}
# Headers of value and of name columns, in order of preference.
VALUE_COLUMNS = [
    "Invested Value", "Current Value", "Closing value", "Closing Value", "closing value", "CLOSING VALUE", "Buy value",
    "Buy Value", "buy value", "BUY VALUE", "Market Value as of last trading day", "Overall Gain/Loss", "Sell Value",
    "Market Value", "Market value", "market value", "Investment Value", "Cur. val", "Investment", "Holdings Value",
    "Total Value", "Present Value", "Value", "value", "VALUE", "Amount", "Current Market Value",
]
NAME_COLUMNS = [
    "Stock Name", "stock name", "Stock name", "STOCK NAME", "Scrip/Contract", "Company Name", "Scrip", "Contract",
    "Symbol", "symbol", "SYMBOL", "Security Name", "security name", "Security name", "SECURITY NAME", "Name", "name",
    "NAME", "ISIN", "Name of Security", "Script Name", "CompanyName", "StockName", "SecurityName", "Instrument", "Ticker",
]


def find_column(columns: list[str], patterns: list[str], fuzzy: bool = True) -> str | None:
    """First pattern found: exactly, else contained in a header or containing it (ignoring case)."""
    low = {c.strip().lstrip("﻿").lower(): c for c in columns}
    for p in patterns:
        if p in low:
            return low[p]
        if fuzzy:
            for key, c in low.items():
                if p in key or key in p:
                    return c
    return None


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Role -> header. The exact alias spellings come first; the fuzzy rule only fills what is left."""
    out = {}
    for field, aliases in L.COLUMN_ALIAS:
        hit = next((c for c in columns if c in aliases), None)
        if hit:
            out[field] = hit
    for role, patterns in ROLE_PATTERNS.items():
        if role not in out:
            left = [c for c in columns if c not in out.values()]
            hit = find_column(left, patterns)
            if hit:
                out[role] = hit
    return out


def value_and_name_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """The value and name columns of a table: by preference, skipping all-null ones (one aggregate)."""
    cands = [c for c in df.columns if c in VALUE_COLUMNS or c in NAME_COLUMNS]
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") or t.startswith("decimal")]
    more = [c for c in numeric if re.search("val|investment|amount|price", c.lower()) and c not in cands]
    names = [c for c, t in df.dtypes if t == "string" and c not in cands]
    # a name is text that is not just a number
    counts = df.agg(*[F.count_if((F.length(F.col(f"`{c}`").cast("string")) > 1)
                                 & ~F.col(f"`{c}`").cast("string").rlike(r"^[0-9.]+$")).alias(f"t{i}")
                      for i, c in enumerate(cands + names)],
                    *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cands + more)]).first()
    filled = {c: counts[f"n{i}"] > 0 for i, c in enumerate(cands + more)}
    texts = {c: counts[f"t{i}"] > 0 for i, c in enumerate(cands + names)}
    value = next((c for c in VALUE_COLUMNS if filled.get(c)), None) or next((c for c in more if filled[c]), None)
    name = next((c for c in NAME_COLUMNS if texts.get(c)), None) or next((c for c in names if texts[c]), None)
    return value, name


def to_canonical(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rename a table's headers to canonical names and turn number text into numbers (blank is null)."""
    roles = resolve_columns([c for c in df.columns if c not in keep])
    cols = []
    for role, c in roles.items():
        x = F.col(f"`{c}`")
        if role in ROLE_PATTERNS and role not in ("stock_name", "symbol", "isin", "sector"):
            x = T.safe_float(x, None) if dict(df.dtypes)[c] == "string" else x.cast("double")
        cols.append(x.alias(role))
    return df.select(*keep, *cols)


# cleaning -----------------------------------------------------------------------------------------------
def derive_values(h: DataFrame) -> DataFrame:
    """Fill current and invested value from quantity times price where they are missing."""
    return (h.withColumn("current_value", F.coalesce("current_value", F.col("current_price") * F.col("quantity")))
            .withColumn("invested_value", F.coalesce("invested_value", F.col("avg_price") * F.col("quantity"))))


def _has_name() -> Column:
    return F.coalesce(F.trim("stock_name") != "", F.lit(False))


def drop_unnamed(h: DataFrame) -> DataFrame:
    return h.filter(_has_name())


def repair_values(h: DataFrame) -> DataFrame:
    """Fill missing prices and values from the others, in a fixed order; adds ``repairs``, what was filled."""
    q, prev, pnl, price = F.col("quantity"), F.col("prev_close"), F.col("pnl"), F.col("current_price")
    cv0, inv0, avg0 = F.col("current_value"), F.col("invested_value"), F.col("avg_price")
    active = q.isNotNull() & (q != 0)
    by_prev = active & (prev > 0) & price.isNull()
    cv1 = F.coalesce(cv0, F.when(by_prev, prev * q))
    # only one of these two can fill: the first needs a current value, the second that there is none
    inv = F.coalesce(inv0, F.when(active & (cv1 - pnl > 0), cv1 - pnl))
    cv = F.coalesce(cv1, F.when(active & (inv0 + pnl > 0), inv0 + pnl))
    new = {"current_value": cv, "invested_value": inv,
           "avg_price": F.coalesce(avg0, F.when(active & (inv > 0), inv / q)),
           "current_price": F.coalesce(price, F.when(active & (cv > 0), cv / q), F.when(by_prev, prev))}
    log = F.array_compact(F.array(
        F.when(by_prev, "Calculated Missing Sell Prices"),
        F.when(by_prev & cv0.isNull(), "Calculated Missing Current Values"),
        F.when(inv0.isNull() & inv.isNotNull(), "Calculated Missing Invested Values"),
        F.when(cv1.isNull() & cv.isNotNull(), "Calculated Missing Current Values"),
        F.when(active & avg0.isNull() & (inv > 0), "Calculated Missing Buy Prices"),
        F.when(active & price.isNull() & (cv > 0), "Calculated Missing Sell Prices")))
    return h.select(*[new.get(c, F.col(c)).alias(c) for c in h.columns], log.alias("repairs"))


def _worth() -> Column:
    return F.coalesce(F.col("current_value") > 0, F.lit(False)) | F.coalesce(F.col("invested_value") > 0, F.lit(False))


def drop_worthless(h: DataFrame) -> DataFrame:
    return h.filter(_worth())


def clean(h: DataFrame) -> DataFrame:
    return drop_worthless(repair_values(drop_unnamed(h)))


def cleaning_audit(h: DataFrame) -> DataFrame:
    """One row per change: portfolio, holding, category."""
    unnamed = h.filter(~_has_name()).select("portfolio_id", "holding_id", F.lit("Removed Rows (Missing Stock Name)").alias("category"))
    fixed = repair_values(drop_unnamed(h))
    log = F.when(_worth(), F.col("repairs")).otherwise(F.array_append("repairs", F.lit("Rows Removed (Insufficient Data)")))
    return unnamed.unionByName(fixed.select("portfolio_id", "holding_id", F.explode(log).alias("category")))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("portfolio_id", "category").agg(F.count(F.lit(1)).alias("changes"))


def salvage_identity(h: DataFrame, numeric: list[str]) -> DataFrame:
    """A name for every row that has one, a symbol, an ISIN or any non-zero number; ``salvage_reason`` tells.

    Rows with none of these keep a null name; ``drop_unsalvaged`` removes them.
    """
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    named = text(F.col("stock_name"))
    named = F.when(~F.lower(named).isin("nan", "none", "null", "na"), named)
    number = F.lit(False)
    for c in numeric:
        number = number | F.coalesce(F.col(c) != 0, F.lit(False))
    sym, isin = text(F.col("symbol")), text(F.col("isin"))
    name = F.coalesce(named, sym, isin, F.when(number, "Unknown (salvaged row)"))
    reason = (F.when(named.isNotNull(), "normal").when(sym.isNotNull(), "used_symbol").when(isin.isNotNull(), "used_isin")
              .when(number, "salvaged_numeric"))
    return h.withColumn("salvage_reason", reason).withColumn("stock_name", name)


def value_holding(h: DataFrame) -> DataFrame:
    """Add ``value`` and ``value_method``: the first method that works on the row."""
    c = lambda n: F.col(n)
    q, price, date, inv, avg = c("quantity"), c("current_price"), c("date_price"), c("invested_value"), c("avg_price")
    chg = F.when(F.abs(c("change_pct")) > 1, c("change_pct") / 100).otherwise(c("change_pct"))
    steps = [
        ("direct_current_value", c("current_value") > 0, c("current_value")),
        ("qty_x_price", (q > 0) & (price > 0), q * price),
        ("qty_x_date_price", (q > 0) & (date > 0), q * date),
        ("estimated_qty_x_date_price", (date > 0) & (inv > 0) & (avg > 0), inv / avg * date),
        ("invested_plus_pnl", (inv > 0) & c("pnl").isNotNull(), inv + c("pnl")),
        ("invested_x_change_pct", (inv > 0) & chg.isNotNull(), inv * (1 + chg)),
        ("qty_x_avg_cost_with_change", (q > 0) & (avg > 0) & chg.isNotNull(), q * avg * (1 + chg)),
        ("qty_x_avg_cost", (q > 0) & (avg > 0), q * avg),
        ("invested_fallback", inv > 0, inv),
    ]
    value, method = F, F
    for name, ok, v in steps:
        value, method = value.when(ok, v), method.when(ok, F.lit(name))
    return h.withColumn("value", value.otherwise(0.0)).withColumn("value_method", method.otherwise("no_calculation_possible"))


def intake_diagnostics(valued: DataFrame) -> DataFrame:
    """Rows read, processed, salvaged and skipped per portfolio (over salvaged and valued rows)."""
    ok = F.col("stock_name").isNotNull() & (F.col("value") != 0)
    return valued.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(ok).alias("rows_processed"),
        F.count_if(ok & (F.col("salvage_reason") != "normal")).alias("rows_salvaged"), F.count_if(~ok).alias("rows_skipped"))


def intake_breakdown(valued: DataFrame) -> DataFrame:
    """Counts by salvage reason, value method and skip reason."""
    named, worth = F.col("stock_name").isNotNull(), F.col("value") != 0
    item = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("item"))
    items = F.when(named & worth, F.array(item("salvage", F.col("salvage_reason")), item("value_source", F.col("value_method")))).otherwise(
        F.array(item("skipped", F.when(~named, "No valid name/symbol/ISIN and no meaningful numeric data")
                     .otherwise("Zero value after trying all calculation methods"))))
    return (valued.select("portfolio_id", F.explode(items).alias("x"))
            .groupBy("portfolio_id", "x.kind", "x.item").agg(F.count(F.lit(1)).alias("rows")))

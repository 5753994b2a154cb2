"""Cut-point classifiers and small formulas. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(x: Column, cuts, default, strict: bool = False) -> Column:
    """First label whose lower cut is reached (``>=``, or ``>`` when strict), else the default."""
    out = None
    for cut, label in cuts:
        hit = (x > F.lit(cut)) if strict else (x >= F.lit(cut))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def round_half_up(x: Column, digits: int) -> Column:
    """Half away from zero on the decimal value: a sum taken in another order does not flip a tie.

    Plain double arithmetic (``round`` on doubles goes through BigDecimal for every row).
    """
    scale = 10.0 ** digits
    return F.signum(x) * F.floor(F.abs(x) * scale + (0.5 + 5e-10 * scale)) / scale


def amount(x: Column, digits: int) -> Column:
    """Fixed-point text without grouping."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


# market capitalisation -------------------------------------------------------------------------
def cap_class_crore(cap_crore: Column, large: float = 20000, mid: float = 5000) -> Column:
    return _bands(cap_crore, [(large, "Large Cap"), (mid, "Mid Cap")], "Small Cap")


def cap_class_inr(cap_usd: Column) -> Column:
    """Class by Indian cut points, from USD at 83 rupees and 1e7 rupees per crore."""
    return cap_class_crore(cap_usd * 83 / 10_000_000)


def cap_class_usd(cap_usd: Column) -> Column:
    return _bands(cap_usd, [(1e10, "Large Cap"), (2e9, "Mid Cap")], "Small Cap")


def esg_cap_band(cap: Column) -> Column:
    return _bands(cap, [(5e10, "Large"), (5e9, "Mid")], "Small")


def esg_cap_factor(cap: Column) -> Column:
    return _bands(cap, [(5e10, 1.1), (5e9, 1.0)], 0.9)


def format_cap(cap: Column) -> Column:
    return (F.when(cap >= 1e12, _text("$", amount(cap / 1e12, 2), "T"))
            .when(cap >= 1e9, _text("$", amount(cap / 1e9, 2), "B"))
            .when(cap > 0, _text("$", amount(cap / 1e6, 2), "M")))


# ESG -------------------------------------------------------------------------------------------
def star_rating(score: Column) -> Column:
    return _bands(score, [(80, 5), (60, 4), (40, 3), (20, 2)], 1)


def rating_label(stars: Column) -> Column:
    return (F.when(stars == 5, "Leader").when(stars == 4, "Strong").when(stars == 3, "Average")
            .when(stars == 2, "Below Average").when(stars == 1, "Laggard").otherwise("Unrated"))


def esg_risk_multiplier(score: Column) -> Column:
    return _bands(score, [(80, 0.80), (60, 0.90), (40, 1.00), (20, 1.15)], 1.30)


def esg_risk_level(score: Column) -> Column:
    return _bands(score, [(80, "Low Risk"), (60, "Medium Risk"), (40, "High Risk")], "Extreme Risk")


LETTER_SCHEMES = {
    6: ([(80, "AAA"), (70, "AA"), (60, "A"), (50, "BBB"), (40, "BB")], "B"),
    7: ([(90, "AAA"), (80, "AA"), (70, "A"), (60, "BBB"), (50, "BB"), (40, "B")], "CCC"),
}


def letter_rating(score: Column, scheme: int = 6) -> Column:
    cuts, default = LETTER_SCHEMES[scheme]
    return _bands(score, cuts, default)


def improvement_areas(e: Column, s: Column, g: Column) -> Column:
    """Array of messages for pillars under 60."""
    found = F.array_compact(F.array(
        F.when(e < 60, "Environmental practices need improvement"),
        F.when(s < 60, "Social responsibility initiatives required"),
        F.when(g < 60, "Governance structures need strengthening")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Maintain current ESG standards")))


def msci_to_100(x: Column) -> Column:
    """Provider risk scale (0 best, 50 worst) to 0..100 with 100 best."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - x * 1.8)))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


# stress ----------------------------------------------------------------------------------------
def stress_risk_level(abs_impact: Column) -> Column:
    """Level from an absolute impact fraction; a value on a cut point belongs to the lower level."""
    return _bands(abs_impact, [(0.25, "Extreme"), (0.15, "High"), (0.08, "Medium")], "Low", strict=True)


def gauge_risk_level(impact_pct: Column) -> Column:
    """Level shown on gauges: percent, and a value on a cut point belongs to the higher level."""
    return _bands(F.abs(impact_pct), [(25, "Extreme Risk"), (15, "High Risk"), (8, "Medium Risk")], "Low Risk")


def impact_band(impact_pct: Column) -> Column:
    return _bands(F.abs(impact_pct), [(30, "SEVERE"), (20, "HIGH"), (10, "MODERATE")], "LOW")


def concentration_level(hhi: Column) -> Column:
    return _bands(hhi, [(5000, "Extreme (concentrated)"), (2500, "High"), (1500, "Moderate")],
                  "Low (well-diversified)")


def concentration_penalty_pct(hhi: Column) -> Column:
    return _bands(hhi, [(5000, 20), (2500, 10), (1500, 5)], 0)


def hhi_grade(hhi: Column) -> Column:
    return _bands(hhi, [(2500, "Moderate"), (1500, "Good")], "Excellent")


def diversification_label(factor: Column) -> Column:
    return F.when(factor > 0.7, "Well Diversified").when(factor < 0.4, "Concentrated").otherwise("Moderate")


def recovery_months(abs_impact: Column, annual_return: float = 0.125) -> Column:
    return F.greatest(abs_impact / annual_return * 12, F.lit(1.0))


def var95_proxy(impact: Column) -> Column:
    return impact * 1.5

"""Stress of valuations: sensitivities, grids, scenarios and the growth that a price implies.

The pricer is a function of columns. The one given here discounts explicit cash flows and a
growing perpetuity; any other that maps (wacc, growth) columns to a price column will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import dependence, messages
from tailframe.plans import settings as S

Pricer = Callable[[Column, Column], Column]


def _present_value(wacc: Column) -> Column:
    flows = F.transform("fcff", lambda x, i: x / F.pow(wacc + 1, (i + 1).cast("double")))
    return F.aggregate(flows, F.lit(0.0), lambda a, x: a + x)


def _terminal(wacc: Column, growth: Column) -> Column:
    last, n = F.element_at("fcff", -1), F.size("fcff").cast("double")
    return last * (growth + 1) / F.nullif(wacc - growth, F.lit(0.0)) / F.pow(wacc + 1, n)


def dcf_price(wacc: Column, growth: Column) -> Column:
    """Price of a share from columns fcff (array), net_debt and shares."""
    return (_present_value(wacc) + _terminal(wacc, growth) - F.col("net_debt")) / F.nullif("shares", F.lit(0.0))


def terminal_share(wacc: Column, growth: Column) -> Column:
    t = _terminal(wacc, growth)
    return t / F.nullif(_present_value(wacc) + t, F.lit(0.0))


def revalue(wacc: Column, growth: Column, pricer: Pricer = dcf_price) -> Column:
    """NULL where growth is too close to the discount rate for a perpetuity."""
    return F.when(growth < wacc - 0.005, pricer(wacc, growth))


def grid(base: DataFrame, pricer: Pricer = dcf_price, by: str = "entity") -> DataFrame:
    """Prices for five discount rates and five growth rates around the base. The steps are
    exploded literals, so there is no join."""
    steps = lambda: F.explode(F.array(*map(F.lit, S.GRID_STEPS)))
    g = base.withColumn("d_wacc", steps()).withColumn("d_growth", steps())
    w, t = F.col("wacc") + F.col("d_wacc"), F.col("terminal_growth") + F.col("d_growth")
    return g.select(by, "d_wacc", "d_growth", revalue(w, t, pricer).alias("price"))


def stress(base: DataFrame, scenarios=S.SCENARIOS, pricer: Pricer = dcf_price, by: str = "entity") -> DataFrame:
    """Each named shock: price, and its distance from the base and from the market."""
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(float(w)).alias("dw"), F.lit(float(g)).alias("dg")) for n, w, g in scenarios)))
    s = base.withColumn("_s", named)
    w, g = F.col("wacc") + F.col("_s.dw"), F.col("terminal_growth") + F.col("_s.dg")
    s = s.withColumn("_base", revalue(F.col("wacc"), F.col("terminal_growth"), pricer)).withColumn("_price", revalue(w, g, pricer))
    return s.select(
        by,
        "_s.scenario",
        w.alias("scenario_wacc"),
        g.alias("scenario_growth"),
        F.col("_price").alias("implied_price"),
        F.when(F.col("_base") > 0, F.col("_price") / F.nullif("_base", F.lit(0.0)) - 1).alias("vs_base"),
        F.when(F.col("share_price") > 0, F.col("_price") / F.nullif("share_price", F.lit(0.0)) - 1).alias("vs_market"),
    )


def implied_growth(wacc: Column, price: Column, pricer: Pricer = dcf_price, rounds: int = 60) -> Column:
    """The growth at which the pricer meets the price, by bisection inside one expression; NULL if
    no growth between -5% and the discount rate less 0.6% does. The top of the range comes down in
    steps of half a point until it can be priced."""
    low, top = F.lit(-0.05), wacc - 0.006
    at = lambda g: revalue(wacc, g, pricer)
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((top - low) / 0.005)).cast("int")), lambda k: top - k * F.lit(0.005))
    high = F.element_at(F.filter(steps, lambda h: at(h).isNotNull()), 1) if pricer is not dcf_price else F.when(at(top).isNotNull(), top)
    start = F.struct(low.alias("lo"), high.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = F.coalesce(at(mid) < price, F.lit(False))
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    bracketed = (top > low) & (at(low) <= price) & (price <= at(high))
    return F.when(bracketed, found)


def assess(base: DataFrame, pricer: Pricer = dcf_price, share: Pricer = terminal_share, by: str = "entity") -> DataFrame:
    """base: entity, fcff, net_debt, shares, share_price, wacc, terminal_growth and optionally
    market_implied_wacc. Sensitivities are re-pricings, two-sided, in shares of the price."""
    w, g = F.col("wacc"), F.col("terminal_growth")
    b = base if "market_implied_wacc" in base.columns else base.withColumn("market_implied_wacc", F.lit(None).cast("double"))
    # A market-implied rate of exactly 0 counts as unknown.
    b = b.withColumn("market_implied_wacc", F.nullif("market_implied_wacc", F.lit(0.0)))
    b = b.withColumn("implied_price", revalue(w, g, pricer))
    two_sided = lambda down, up: F.when(F.col("implied_price") > 0, (down - up) / F.nullif(F.col("implied_price") * 2, F.lit(0.0)))
    b = b.withColumn("wacc_sensitivity", two_sided(revalue(w - S.WACC_SHOCK, g, pricer), revalue(w + S.WACC_SHOCK, g, pricer)))
    b = b.withColumn("growth_sensitivity", two_sided(revalue(w, g + S.GROWTH_SHOCK, pricer), revalue(w, g - S.GROWTH_SHOCK, pricer)))
    b = b.withColumn("terminal_share", share(w, g)).withColumn("market_implied_growth", implied_growth(w, F.col("share_price"), pricer))
    t, fragile = F.col("terminal_share"), F.coalesce(F.abs("wacc_sensitivity") > 0.05, F.lit(False))
    flags = messages(
        (t >= 0.85, "nearly all value is beyond the forecast"),
        ((t >= 0.70) & (t < 0.85), "most value is beyond the forecast"),
        (fragile, "25 basis points move the price a lot"),
        (F.abs(w - F.col("market_implied_wacc")) > 0.02, "the market implies another discount rate"),
        (F.col("market_implied_growth") > 0.05, "the market implies growth above the economy's"),
    )
    return b.select(
        by, "share_price", "implied_price", (F.col("implied_price") / F.nullif("share_price", F.lit(0.0)) - 1).alias("upside"), "wacc", "terminal_growth", "terminal_share",
        dependence("terminal_share").alias("assumption_dependence"), "market_implied_wacc", "market_implied_growth", "wacc_sensitivity", "growth_sensitivity", fragile.alias("is_fragile"), flags.alias("flags"),
    )

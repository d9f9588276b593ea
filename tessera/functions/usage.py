"""Column expressions for model families, prices, cost and footprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for a million input and output tokens, in the order in which names are looked for (fixed values).
PRICES = (("opus", 5.0, 25.0), ("sonnet", 3.0, 15.0), ("haiku", 1.0, 5.0), ("fable", 10.0, 50.0))
DEFAULT_PRICE = (5.0, 25.0)
CACHE_READ, CACHE_WRITE = 0.10, 1.25
#: Energy of a token, water and carbon of a watt-hour (fixed values).
WH_OUTPUT, WH_INPUT, ML_PER_WH, CO2_G_PER_WH = 0.0005, 0.00005, 0.95, 0.4
BASELINE, MILESTONE = 2.5, 5.0
#: Equivalents: watt-hours of a phone charge, millilitres of a glass, grams of a mile, watt-hours of an LED hour (fixed values).
PHONE_WH, GLASS_ML, MILE_G, LED_WH = 12.2, 250.0, 404.0, 10.0
#: Families from the least to the most capable (fixed values); names are looked for in this order.
FAMILIES = ("haiku", "sonnet", "opus", "fable")


def family(model: Column) -> Column:
    """The model family named in an id, or null."""
    m = F.lower(model)
    return F.coalesce(*[F.when(F.contains(m, F.lit(f)), F.lit(f)) for f in FAMILIES])


def family_rank(fam: Column) -> Column:
    return F.coalesce(*[F.when(fam == f, F.lit(i + 1)) for i, f in enumerate(FAMILIES)])


def price_in(model: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.coalesce(*[F.when(F.contains(m, F.lit(k)), F.lit(a)) for k, a, _ in PRICES], F.lit(DEFAULT_PRICE[0]))


def price_out(model: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.coalesce(*[F.when(F.contains(m, F.lit(k)), F.lit(b)) for k, _, b in PRICES], F.lit(DEFAULT_PRICE[1]))


def cost(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column) -> Column:
    """Dollars of one model's tokens."""
    i, o = price_in(model), price_out(model)
    return tokens_in / 1e6 * i + tokens_out / 1e6 * o + cache_read / 1e6 * i * CACHE_READ + cache_write / 1e6 * i * CACHE_WRITE


def energy_wh(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.lit(WH_INPUT) + tokens_out * F.lit(WH_OUTPUT)


def milestone(saved: Column, step: float = MILESTONE) -> Column:
    """The largest multiple of ``step`` (at least a cent) that isn't above the sum."""
    s = max(0.01, step)
    return F.floor(saved / s) * F.lit(s)


def window_seconds(since: str) -> float | None:
    """Seconds of a window given in days; 'all' has none, what can't be read counts as 30 days."""
    if since == "all":
        return None
    try:
        return float(since) * 86400.0
    except ValueError:
        return 30.0 * 86400.0

"""Scores and quantitative functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def clip(x: Column, low: float = -100, high: float = 100) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the parts that are known, by their weights; NULL if none is."""
    top = reduce(lambda a, b: a + b, [F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in parts])
    low = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts])
    return F.when(low > 0, top / low)


def technical_score(price: Column, sma50: Column, sma200: Column, rsi: Column, month: Column, stretch: Column) -> Column:
    """Stack of averages, momentum, oscillator extremes and stretch, within ±100."""
    stack = F.when((price > sma50) & (sma50 > sma200), 40.0).when((price < sma50) & (sma50 < sma200), -40.0).when(price > sma200, 15.0).otherwise(-15.0)
    momentum = clip(F.coalesce(month, F.lit(0.0)) * 3, -25, 25)
    swing = F.when(rsi > 72, -15.0).when(rsi < 28, 15.0).otherwise(0.0)
    return clip(stack + momentum + swing + F.when(stretch > 30, -15.0).otherwise(0.0))


def index_score(price: Column, sma20: Column, sma50: Column, sma200: Column, month: Column, rsi: Column, mfi: Column) -> Column:
    """An index's stack of averages, its place over the short one, momentum, oscillator extremes and
    money flow, within ±100; what is not known adds nothing."""
    stack = F.when((price > sma50) & (sma50 > sma200), 40.0).when((price < sma50) & (sma50 < sma200), -40.0).when(price > sma200, 15.0).otherwise(-15.0)
    place = F.when(price > sma20, 18.0).otherwise(-18.0)
    swing = F.when(rsi > 72, -12.0).when(rsi < 28, 12.0).otherwise(0.0)
    return clip(stack + place + clip(F.coalesce(month, F.lit(0.0)) * 3, -18, 18) + swing + F.when(mfi.isNotNull(), clip((mfi - 50) * 0.5, -12, 12)).otherwise(0.0))


def trend_label(score: Column) -> Column:
    return F.when(score >= 30, "ALTA").when(score <= -30, "BAIXA").otherwise("NEUTRO")


def valuation_score(month_place: Column, year_place: Column, mfi: Column, stretch: Column) -> Column:
    return clip(weighted([(0.40, month_place * 2 - 100), (0.25, year_place * 2 - 100), (0.20, (mfi - 50) * 2), (0.15, clip(F.coalesce(stretch, F.lit(0.0)) * 3))]))


def valuation_tag(score: Column) -> Column:
    return F.when(score >= 25, "CARO").when(score > -25, "JUSTO").otherwise("BARATO")


#: The signal of each trend and valuation.
SIGNALS = {
    ("ALTA", "BARATO"): "FORTE_COMPRA",
    ("ALTA", "JUSTO"): "COMPRA",
    ("ALTA", "CARO"): "CAUTELA",
    ("NEUTRO", "BARATO"): "COMPRA",
    ("NEUTRO", "JUSTO"): "NEUTRO",
    ("NEUTRO", "CARO"): "CAUTELA",
    ("BAIXA", "BARATO"): "OBSERVAR",
    ("BAIXA", "JUSTO"): "EVITAR",
    ("BAIXA", "CARO"): "EVITAR",
}


def signal(trend: Column, tag: Column) -> Column:
    chosen = F.lit("NEUTRO")
    for (t, v), name in SIGNALS.items():
        chosen = F.when((trend == t) & (tag == v), name).otherwise(chosen)
    return chosen


def opportunity(score: Column, valuation: Column, mfi: Column) -> Column:
    flow = F.coalesce((mfi - 50) * 2, F.lit(0.0))
    return F.bround((clip(-0.45 * valuation + 0.35 * score + 0.20 * flow) + 100) / 2)


def flow_label(mfi: Column) -> Column:
    return F.when(mfi.isNull(), "sem dados").when(mfi >= 60, "comprador forte").when(mfi >= 52, "comprador").when(mfi <= 40, "vendedor forte").when(mfi <= 48, "vendedor").otherwise("equilibrado")


def candle(o: Column, h: Column, low: Column, c: Column) -> Column:
    """Shape of one bar; the shares of body and shadows and the names are fixed values."""
    size, body = h - low, F.abs(c - o)
    above, below, up = h - F.greatest(o, c), F.least(o, c) - low, c >= o
    return (
        F.when(size <= 0, "sem amplitude")
        .when(body / size < 0.12, "doji (indecisao)")
        .when(body / size > 0.68, F.when(up, "marubozu de alta").otherwise("marubozu de baixa"))
        .when((below >= 2 * body) & (above <= 0.25 * size), "martelo (sombra inferior)")
        .when((above >= 2 * body) & (below <= 0.25 * size), "estrela cadente (sombra superior)")
        .otherwise(F.when(up, "corpo de alta").otherwise("corpo de baixa"))
    )


#: Abramowitz and Stegun 26.2.17.
_CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """Within 7.5e-8 of the normal distribution function; Spark has none of its own."""
    return _cdf(x, lambda v, f: f(v))


def _cdf(x: Column, bound: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    def of(t: Column) -> Column:
        poly = reduce(lambda acc, b: (acc + F.lit(b)) * t, reversed(_CDF), F.lit(0.0))
        tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
        return F.when(x >= 0, 1 - tail).otherwise(tail)

    return bound(1 / (1 + 0.2316419 * F.abs(x)), of)


def black_scholes(call: Column, spot: Column, strike: Column, years: Column, rate: Column, sigma: Column) -> Column:
    """Price; the intrinsic value where time or volatility is not positive."""
    return _price(call, spot, strike, years, rate, sigma, lambda v, f: f(v))


def _spotless(strike: Column, years: Column, rate: Column, sigma: Column) -> tuple[Column, ...]:
    """The terms of a price that do not depend on the spot."""
    return sigma * F.sqrt(F.greatest(years, F.lit(1e-12))), (rate + sigma * sigma / 2) * years, strike * F.exp(-rate * years)


def _price(call: Column, spot: Column, strike: Column, years: Column, rate: Column, sigma: Column, bound: Callable[[Column, Callable[[Column], Column]], Column], terms: tuple[Column, ...] | None = None) -> Column:
    """``black_scholes``.  A lambda of Spark works out a term as often as it is written, so inside one
    ``bound`` is ``let``; elsewhere Spark finds the common terms.  ``terms`` has the spotless ones
    where they were worked out before."""
    root, carry, paid = terms or _spotless(strike, years, rate, sigma)
    live = (years > 0) & (sigma > 0) & (spot > 0) & (strike > 0)

    def worth(d1: Column) -> Column:
        cdf = lambda x: bound(x, lambda v: _cdf(v, bound))
        d2 = d1 - root
        return F.when(call, spot * cdf(d1) - paid * cdf(d2)).otherwise(paid * cdf(-d2) - spot * cdf(-d1))

    price = bound((F.ln(spot / strike) + carry) / root, worth)
    return F.when(live, price).otherwise(F.greatest(F.lit(0.0), F.when(call, spot - strike).otherwise(strike - spot)))


def _halved(low: Column, high: Column, steps: int, rises: Callable[[Column], Column]) -> Column:
    """Bisection inside one expression: where ``rises`` of the middle holds, the lower half goes.

    A step in which no number lies between the bounds any more changes nothing and is left out."""

    def step(s: Column, _: Column) -> Column:
        half = lambda m: F.when(rises(m), F.struct(m.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high")))
        return let((s["low"] + s["high"]) / 2, lambda m: F.when((m != s["low"]) & (m != s["high"]), half(m)).otherwise(s))

    start = F.struct(low.alias("low"), high.cast("double").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["low"] + s["high"]) / 2)


def _inside(args: list[Column], found: Callable[..., Column]) -> Column:
    """``found`` of the arguments, each worked out once, before it goes into lambdas."""
    packed = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)])
    return let(packed, lambda p: found(*[p[f"a{i}"] for i in range(len(args))]))


def implied_volatility(call: Column, premium: Column, spot: Column, strike: Column, years: Column, rate: Column, most: float = 5.0, steps: int = 60) -> Column:
    """The volatility at which the option is worth ``premium``, by bisection inside one expression
    (a price rises with volatility); null where none up to ``most`` is, or an argument is not
    positive."""
    return _inside([call, premium, spot, strike, years, rate], lambda *given: _implied_volatility(*given, most, steps))


def _implied_volatility(call: Column, premium: Column, spot: Column, strike: Column, years: Column, rate: Column, most: float, steps: int) -> Column:
    worth = lambda v: _price(call, spot, strike, years, rate, v, let)
    least = F.lit(1e-6)
    found = _halved(least, F.lit(most), steps, lambda v: worth(v) < premium)
    inside = (worth(least) <= premium) & (worth(F.lit(most)) >= premium)
    return F.when((premium > 0) & (years > 0) & (spot > 0) & (strike > 0) & inside, found)


def implied_spot(call: Column, premium: Column, strike: Column, years: Column, rate: Column, sigma: Column, steps: int = 80) -> Column:
    """The spot at which the option is worth ``premium``, by bisection inside one expression;
    null where no spot between 0.01 and ten strikes is, or an argument is not positive."""
    args = [call, premium, strike, years, rate, sigma]
    return _inside([*args, *_spotless(strike, years, rate, sigma)], lambda *given: _implied_spot(*given[: len(args)], given[len(args) :], steps))


def _implied_spot(call: Column, premium: Column, strike: Column, years: Column, rate: Column, sigma: Column, terms: tuple[Column, ...], steps: int) -> Column:
    worth = lambda spot: _price(call, spot, strike, years, rate, sigma, let, terms)
    least, most = F.lit(0.01), strike * 10
    found = _halved(least, most, steps, lambda x: let(worth(x), lambda w: F.when(call, w < premium).otherwise(w > premium)))
    inside = F.when(call, worth(most) >= premium).otherwise((worth(least) >= premium) & (worth(most) <= premium))
    return F.when((premium > 0) & (sigma > 0) & (years > 0) & inside, found)


def place_in_range(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.bround((x - low) / (high - low) * 100))


def fundamentals(pl: Column, pvp: Column, ev_ebitda: Column, dy: Column, roe: Column, margin: Column, revenue: Column, profit: Column, debt: Column, bank: Column) -> Column:
    """(valor, qualidade, crescimento, saude, score, tag): parts by their weights, as far as known;
    without any the score is 0.  Banks have neither enterprise value nor debt.  The score is a
    whole number, and the tag is that of the number.  The weights and slopes are fixed values."""
    value = weighted([(0.40, F.when(pl > 0, clip((14 - pl) * 8))), (0.30, F.when(pvp > 0, clip((2.2 - pvp) * 45))), (0.20, F.when((ev_ebitda > 0) & ~bank, clip((8 - ev_ebitda) * 12))), (0.10, clip_known(dy * 8))])
    quality = weighted([(0.55, clip_known((roe - 12) * 5)), (0.45, clip_known((margin - 10) * 3))])
    growth = weighted([(0.55, clip_known(revenue * 4)), (0.45, clip_known(profit * 3))])
    health = F.when(~bank, clip_known((1.0 - debt / 100.0) * 70))
    score = F.bround(clip(F.coalesce(weighted([(0.30, value), (0.35, quality), (0.20, growth), (0.15, health)]), F.lit(0.0))), 0)
    tag = strength(score)
    return F.struct(value.alias("valor"), quality.alias("qualidade"), growth.alias("crescimento"), health.alias("saude"), score.alias("score"), tag.alias("tag"))


def strength(score: Column) -> Column:
    """What a fundamental score is called."""
    return F.when(score >= 45, "FORTE").when(score >= 15, "SÓLIDA").when(score > -15, "NEUTRA").when(score > -45, "ATENÇÃO").otherwise("FRÁGIL")


def real_estate(pvp: Column, dy: Column) -> Column:
    """(valor, qualidade, score, tag) of a real-estate fund, by price over book value and yield (a
    share below 1 or percent).  The weights and slopes are fixed values."""
    yearly = F.when(dy < 1, dy * 100).otherwise(dy)
    value = weighted([(0.55, F.when(pvp > 0, clip((1.05 - pvp) * 70))), (0.45, clip_known(yearly * 6))])
    price = F.when(pvp > 1.3, clip((pvp - 0.7) * -30)).when((pvp <= 1.0) & (pvp != 0), 10.0).otherwise(0.0)
    paid = F.when(yearly >= 8, 15.0).when(yearly.isNull(), 0.0).otherwise(clip_known(yearly * 2))
    quality = 0.60 * price + 0.40 * paid
    score = F.bround(clip(F.coalesce(weighted([(0.55, value), (0.45, quality)]), F.lit(0.0))), 0)
    return F.struct(value.alias("valor"), quality.alias("qualidade"), score.alias("score"), strength(score).alias("tag"))


def clip_known(x: Column) -> Column:
    """``clip``, but null stays null (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), clip(x))


def analyst_score(mean: Column, upside: Column) -> Column:
    """Recommendation (1 to 5, 3 is neutral) and upside in percent, by what is known."""
    return clip_known(weighted([(0.6, (3 - mean) / 2 * 100), (0.4, clip_known(upside * 3))]))


def rounded_by_size(x: Column) -> Column:
    """One, two or four decimals, the fewer the larger."""
    size = F.abs(x)
    return F.when(size >= 100, F.bround(x, 1)).when(size >= 1, F.bround(x, 2)).otherwise(F.bround(x, 4))


def greeks(call: Column, spot: Column, strike: Column, years: Column, rate: Column, sigma: Column) -> Column:
    """(delta, theta a day) of an option; the slope of the intrinsic value and 0 where it has expired."""
    live = (years > 0) & (sigma > 0) & (spot > 0) & (strike > 0)
    root = F.sqrt(F.greatest(years, F.lit(1e-12)))
    d1 = (F.ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * root)
    d2, paid = d1 - sigma * root, strike * F.exp(-rate * years)
    delta = F.when(call, normal_cdf(d1)).otherwise(normal_cdf(d1) - 1)
    decay = -spot * F.exp(-d1 * d1 / 2) / 2.5066282746310002 * sigma / (2 * root)
    theta = (decay - F.when(call, rate * paid * normal_cdf(d2)).otherwise(-rate * paid * normal_cdf(-d2))) / 365
    slope = F.when(call, (spot > strike).cast("double")).otherwise(-(spot < strike).cast("double"))
    return F.struct(F.when(live, delta).otherwise(slope).alias("delta"), F.when(live, theta).otherwise(0.0).alias("theta"))

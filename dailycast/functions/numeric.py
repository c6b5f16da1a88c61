"""Numeric expressions whose edge cases matter to the forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the forecasts depend on.
CLIP_LOG = 20.0
MARGIN_CAP = 0.995

# Amounts are added digit by digit: balanced digits of 26 bits, of which ``BELOW`` lie below the point.
BITS, DIGITS, BELOW = 26, 8, 4
BASE = 1 << BITS
#: From here on amounts are added as plain doubles, beside the digits.
HUGE = f"pow(2D, {BITS * BELOW - 1})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: str, den: str) -> Column:
    """IEEE-style division of two SQL expressions that ANSI mode accepts.

    x/0 is +-inf, 0/0 is NULL, and a NULL on either side stays NULL.
    """
    n, d = f"cast({num} as double)", f"cast({den} as double)"
    return F.expr(
        f"case when {d} <> 0 then {n} / {d} "
        f"when {d} = 0 and {n} <> 0 then {n} * double('inf') end"
    )


def is_finite(x: Column | str) -> Column:
    """False for NULL, NaN and infinities. NaN sorts above every number in Spark."""
    return F.coalesce(F.abs(_c(x)) < F.lit(math.inf), F.lit(False))


def finite_or_null(x: Column | str) -> Column:
    c = _c(x)
    return F.when(is_finite(c), c)


def nan_to_null(x: Column | str) -> Column:
    c = _c(x)
    return F.when(~F.isnan(c), c)


def _digits(x: str) -> list[str]:
    """SQL for the digits of an amount, lowest first, as BIGINT; NULL unless finite.

    Digit k counts 2^(26 (k - 4)). All steps are exact in doubles, so the digits of an amount from
    2e-16 to 1e31 add up to it exactly; smaller ones are rounded to a multiple of 5e-32.
    """
    fine = f"abs({x}) < {HUGE}"
    step = lambda k: f"rint(({x}) * {2.0 ** (BITS * (BELOW - k))!r}D)"
    return [f"if({fine}, cast({step(k)} - {BASE}D * {step(k + 1)} as bigint), null)" for k in range(DIGITS)]


def _huge(x: str) -> str:
    return f"coalesce(sum(if(abs({x}) >= {HUGE} and abs({x}) < double('inf'), {x}, null)), 0D)"


def _value(digits: list[str], huge: str) -> str:
    """SQL for the double that sums of digits make, whatever they have grown to.

    Carries go up until each digit is balanced again; then the digits are added from the lowest
    on, with what each addition rounds away kept beside, so that the result is rounded once.
    """
    sums = ", ".join(f"cast({d} as decimal(38, 0))" for d in [*digits, "0", "0", "0"])
    carry = f"cast(floor((t + a.c + {BASE // 2}) / {BASE}) as decimal(38, 0))"
    digit = f"cast(t + a.c - {carry} * {BASE} as double)"
    lost = f"(a.v / {BASE}D - (({digit} + a.v / {BASE}D) - {digit}))"
    step = f"named_struct('c', {carry}, 'v', {digit} + a.v / {BASE}D, 'e', {lost} + a.e / {BASE}D)"
    start = "named_struct('c', cast(0 as decimal(38, 0)), 'v', 0D, 'e', 0D)"
    top = 2.0 ** (BITS * (DIGITS + 2 - BELOW))
    return f"(aggregate(array({sums}), {start}, (a, t) -> {step}, a -> (a.v + a.e) * {top!r}D) + {huge})"


def part_columns(x: str, name: str) -> list[Column]:
    """An amount's exact parts as columns ``name_0`` and so on; NULL unless it is finite."""
    digits = [F.expr(d).alias(f"{name}_{k}") for k, d in enumerate(_digits(x))]
    return [*digits, F.expr(f"if(abs({x}) >= {HUGE} and abs({x}) < double('inf'), {x}, null)").alias(f"{name}_huge")]


def part_sums(name: str) -> list[Column]:
    """Aggregates that add parts up, digit by digit, under the same names; 0 if there are none.

    Sums of parts can be added up again (``parts_total``), in any order and grouping, with the
    same result.
    """
    *digits, huge = part_names(name)
    return [*[F.expr(f"coalesce(sum({d}), 0L)").alias(d) for d in digits], F.expr(f"coalesce(sum({huge}), 0D)").alias(huge)]


def part_names(name: str) -> list[str]:
    return [*(f"{name}_{k}" for k in range(DIGITS)), f"{name}_huge"]


def parts_value(name: str) -> str:
    """SQL for the amount that one row's parts make."""
    *digits, huge = part_names(name)
    return _value(digits, huge)


def parts_total(name: str) -> str:
    """SQL aggregate: the exact sum of rows of parts as an amount, 0 for none.

    High and low halves are summed apart in BIGINT, so no number of rows overflows them.
    """
    *digits, huge = part_names(name)
    half = 1 << 30
    sums = [
        f"cast(coalesce(sum({d} div {half}), 0L) as decimal(38, 0)) * {half} + coalesce(sum({d} % {half}), 0L)" for d in digits
    ]
    return _value(sums, f"coalesce(sum({huge}), 0D)")


def _total(x: str) -> str:
    return _value([f"coalesce(sum({d}), 0L)" for d in _digits(x)], _huge(x))


def money_sum(x: str) -> Column:
    """Sum of the finite values of the SQL expression ``x``, the same in any order; 0 if there are none."""
    return F.expr(_total(x))


def money_mean(x: str) -> Column:
    """Mean of the finite values of the SQL expression ``x``; NULL if there are none."""
    return F.expr(f"try_divide({_total(x)}, count(if(abs({x}) < double('inf'), 1, null)))")


def log_target(x: Column | str) -> Column:
    return F.log1p(_c(x))


def clipped_expm1(x: Column | str, clip: float = CLIP_LOG) -> Column:
    """``expm1`` after clipping the log; NULL stays NULL (greatest/least skip NULLs)."""
    c = _c(x)
    return F.when(
        c.isNotNull(), F.expm1(F.greatest(F.least(c, F.lit(clip)), F.lit(-clip)))
    )


def floor_zero(x: Column | str) -> Column:
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def unlog(x: Column | str) -> Column:
    """Predicted log back to a non-negative amount."""
    return floor_zero(clipped_expm1(x))


def cap_to_margin(
    cogs: Column | str, revenue: Column | str, cap: float = MARGIN_CAP
) -> Column:
    """Cost held at or below a share of revenue, both floored at zero first."""
    c, r = floor_zero(cogs), floor_zero(revenue)
    return F.when(c.isNotNull() & r.isNotNull(), F.least(c, r * F.lit(cap)))


def round_cents(x: Column | str) -> Column:
    """Two decimals: hundredths rounded half to even in binary, as array libraries do."""
    return F.rint(_c(x) * 100) / 100


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns of one row, skipping NULLs."""
    cs = [_c(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return F.try_divide(total, present)

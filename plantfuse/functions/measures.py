"""Row-level measures. Every one is a built-in expression, so it stays in codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, so that a sum of it is a count.

    As a sum it has the form that Spark can send to a JDBC source, unlike
    ``COUNT(CASE ... END)``; no database is started here to show it.
    """
    return F.when(condition, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


#: Bits of a limb, and the power of two that each limb of an amount counts.
LIMB = 20
POWERS = (44, 24, 4, -16, -36, -56, -76)


def exact_sum(amount: Column) -> Column:
    """The sum of a floating amount, with the same bits whatever the order of tasks.

    An amount is split into whole multiples of falling powers of two, and each
    limb is summed as a BIGINT, which no order changes: 2^43 rows fit, and the
    sums stay in generated code. The limbs are joined once they are complete.
    What an amount holds below 2^-77 is rounded off. NULLs are passed over; NaN,
    infinity and amounts of 2^64 or more, which have no limbs, are added beside.
    """
    x = amount.cast("double")
    in_range = F.abs(x) < 2.0 ** (POWERS[0] + LIMB)
    held = F.when(in_range, x)

    def multiples(power: int) -> Column:
        return F.rint(held * 2.0**-power)

    limbs = [multiples(POWERS[0])] + [
        multiples(power) - multiples(power + LIMB) * 2.0**LIMB for power in POWERS[1:]
    ]
    sums = [F.sum(limb.cast("long")) for limb in limbs]
    # From the last limb on, what passes half a limb is carried to the one
    # before. The first that is left then outweighs all after it.
    total = carry = None
    for power, limb in zip(reversed(POWERS), reversed(sums)):
        limb = limb if carry is None else limb + carry
        if power != POWERS[0]:
            carry = F.shiftright(limb + 2 ** (LIMB - 1), LIMB)
            limb = limb - F.shiftleft(carry, LIMB)
        part = limb.cast("double") * 2.0**power
        total = part if total is None else total + part
    beside = F.sum(F.when(~in_range, x))
    return F.when(beside.isNull(), total).otherwise(beside + zero_if_null(total))


def rounded_sum(amount: Column, places: int = 4) -> Column:
    """The sum of a floating amount, rounded once it is complete.

    Nothing is cut from the amounts, and NULL, NaN and infinity count as in any SUM.
    """
    return F.round(exact_sum(amount), places)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def pass_rate(passed: Column, total: Column) -> Column:
    """Percentage to one place; NULL where nothing was inspected."""
    return F.round(passed * F.lit(Decimal("100.0")) / F.nullif(total, F.lit(0)), 1)

"""Per-pixel rules: mask classes and colour stretch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import MASK_CLASSES


def mask_class(value: Column, valid: Column) -> Column:
    """Class of a quality-mask pixel: the first set bit in the fixed order; null when invalid."""
    bits = F.when(valid, value.cast("int")).otherwise(0)
    rule = None
    for name, bit, *_ in MASK_CLASSES:
        if bit:
            hit = bits.bitwiseAND(bit) != 0
            rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return F.when(valid, rule.otherwise("clear"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with the product unrounded, by error-free halves of the factors; plain where these would overflow."""

    def halves(x: Column) -> tuple[Column, Column]:
        scaled = x * F.lit(134217729.0)  # 2^27 + 1
        upper = scaled - (scaled - x)
        return upper, x - upper

    (ah, al), (bh, bl), product = halves(a), halves(b), a * b
    lost = al * bl - (((product - ah * bh) - al * bh) - ah * bl)
    total = product + c
    other = total - product
    rest = (product - (total - other)) + (c - other)
    return F.when((F.abs(a) < 1e290) & (F.abs(b) < 1e290), total + (rest + lost)).otherwise(total)


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Linear stretch between the bounds to a byte, cut off, not rounded."""
    scaled = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.coalesce((scaled * 255).cast("int"), F.lit(0))


def has_bit(value: Column, bit: Column | int) -> Column:
    return F.shiftright(value, bit).bitwiseAND(1) == 1 if isinstance(bit, int) else F.getbit(value, bit) == 1

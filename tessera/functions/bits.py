"""Bit functions as Spark columns: slices, permutations, symmetries, codes and ranks.

Words are LONG columns holding 64 bits.  All functions are built-in expressions, so they stay within
generated code; permutations go through chains of masked shifts or one aggregate over bit positions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def word(value: int) -> Column:
    """A 64-bit constant, given unsigned or signed."""
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def bit_slice(value: Column, low: int, width: int) -> Column:
    """Bits low .. low + width - 1 as a number."""
    return F.shiftrightunsigned(value, low).bitwiseAND(word((1 << width) - 1))


def bit_concat(parts: list[tuple[Column, int]]) -> Column:
    """Join fields, the first highest; each comes with its width."""
    out, shift = F.lit(0).cast("long"), sum(w for _, w in parts)
    for part, width in parts:
        shift -= width
        out = out.bitwiseOR(F.shiftleft(part, shift))
    return out


def unsigned_order(value: Column) -> Column:
    """A key whose signed order is the unsigned order of the words."""
    return value.bitwiseXOR(F.lit(SIGN).cast("long"))


def gather_bits(value: Column, order: list[int]) -> Column:
    """Bit k of the result, from the top, is bit order[k] of the value, from the top of the same width."""
    n = len(order)
    source = F.array(*(F.lit(n - 1 - p) for p in order))
    return F.aggregate(source, F.lit(0).cast("long"), lambda out, p: F.shiftleft(out, 1).bitwiseOR(F.call_function("shiftrightunsigned", value, p).bitwiseAND(F.lit(1).cast("long"))))


def inverse_order(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for k, p in enumerate(order):
        out[p] = k
    return out


def ring_order(side: int = 8) -> list[int]:
    """Cells of a square, outermost ring first, each ring clockwise from its top left cell (row-major numbers)."""
    cells, low, high = [], 0, side - 1
    while low < high:
        cells += [(low, c) for c in range(low, high)] + [(r, high) for r in range(low, high)]
        cells += [(high, c) for c in range(high, low, -1)] + [(r, low) for r in range(high, low, -1)]
        low, high = low + 1, high - 1
    if low == high:
        cells.append((low, low))
    return [r * side + c for r, c in cells]


def classify(mine: Column, theirs: Column) -> Column:
    """BLACK, WHITE or TIE by the number of set bits."""
    a, b = F.bit_count(mine), F.bit_count(theirs)
    return F.when(a > b, "BLACK").when(a < b, "WHITE").otherwise("TIE")


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def varint_length(value: Column) -> Column:
    """Bytes of the 7-bit code of an unsigned word."""
    longer = [(F.shiftrightunsigned(value, 7 * k) != 0).cast("long") for k in range(1, 10)]
    return reduce(lambda a, b: a + b, longer, F.lit(1).cast("long"))


def combinadic_rank(pattern: Column, width: int = 16) -> Column:
    """Place of a pattern among those of its population, in colexicographic order."""
    terms = []
    for position in range(width):
        below = F.bit_count(pattern.bitwiseAND(word((1 << (position + 1)) - 1)))
        table = F.array(*(F.lit(math.comb(position, k)).cast("long") for k in range(width + 1)))
        terms.append(F.when(bit_slice(pattern, position, 1) == 1, F.element_at(table, below + 1)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a + b, terms)


def combinadic_unrank(rank: Column, population: Column, width: int = 16) -> Column:
    """The pattern with that rank: from the top, each position is taken where its binomial still fits."""
    start = F.struct(rank.cast("long").alias("rank"), population.cast("int").alias("left"), F.lit(0).cast("long").alias("out"))
    rows = [F.array(*(F.lit(math.comb(p, k)).cast("long") for k in range(width + 2))) for p in range(width)]
    table = F.array(*rows)

    def step(state, position):
        size = F.element_at(F.element_at(table, position + 1), state["left"] + 1)
        take = (state["left"] > 0) & (state["rank"] >= size)
        return F.struct(
            F.when(take, state["rank"] - size).otherwise(state["rank"]).alias("rank"),
            F.when(take, state["left"] - 1).otherwise(state["left"]).alias("left"),
            F.when(take, state["out"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["out"])


def binomial(n: int, k: Column, most: int) -> Column:
    table = F.array(*(F.lit(math.comb(n, i)).cast("long") for i in range(most + 1)))
    return F.element_at(table, k.cast("int") + 1)


def _swap(value: Column, mask: int, shift: int) -> Column:
    """Exchange the fields under the mask with those shift bits higher."""
    return F.shiftrightunsigned(value, shift).bitwiseAND(word(mask)).bitwiseOR(F.shiftleft(value.bitwiseAND(word(mask)), shift))


def byte_swap(value: Column) -> Column:
    """Rows of an 8x8 board upside down."""
    for mask, shift in ((0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16), (0x00000000FFFFFFFF, 32)):
        value = _swap(value, mask, shift)
    return value


def mirror(value: Column) -> Column:
    """Bits of every byte in reverse: an 8x8 board left to right."""
    for mask, shift in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4)):
        value = _swap(value, mask, shift)
    return value


def transpose(value: Column) -> Column:
    """An 8x8 board with rows and columns exchanged."""
    for mask, shift in ((0x00AA00AA00AA00AA, 7), (0x0000CCCC0000CCCC, 14), (0x00000000F0F0F0F0, 28)):
        moved = value.bitwiseXOR(F.shiftrightunsigned(value, shift)).bitwiseAND(word(mask))
        value = value.bitwiseXOR(moved).bitwiseXOR(F.shiftleft(moved, shift))
    return value


def rotate(value: Column, quarters: int) -> Column:
    """An 8x8 board turned clockwise by so many times 90 degrees."""
    turned = {0: lambda v: v, 1: lambda v: mirror(transpose(v)), 2: lambda v: mirror(byte_swap(v)), 3: lambda v: byte_swap(transpose(v))}
    return turned[quarters % 4](value)


def color_flip(occupied: Column, colors: Column) -> Column:
    return F.bitwise_not(colors).bitwiseAND(occupied)


def render(value: Column, width: int) -> Column:
    """Bits as text, the highest first: # where set, . where not."""
    return F.translate(F.lpad(F.bin(value), width, "0"), "01", ".#")


def nibble_pack(first: Column, second: Column) -> Column:
    """Two numbers of four bits in one byte, the first in the low half."""
    return first.bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(second.bitwiseAND(F.lit(15)), 4))

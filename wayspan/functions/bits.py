"""Hour masks: bits 0 to 14 say whether a pixel is shaded in each frame of a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = 15
FULL = (1 << HOURS) - 1


def all_hours(frames: int) -> int:
    if not 1 <= frames <= HOURS:
        raise ValueError(f"frames must be 1 to {HOURS}")
    return (1 << frames) - 1


def hour_set(bits: Column, position: int | Column) -> Column:
    position = F.lit(position) if isinstance(position, int) else position
    return F.getbit(bits, position) == 1


def shaded_hours(bits: Column) -> Column:
    """Frames with shade; bits from 15 on are ignored."""
    return F.bit_count(bits.bitwiseAND(F.lit(FULL)))


def profile(bits: Column, hours: int = HOURS) -> Column:
    """The mask as an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda p: F.getbit(bits, p).cast("int"))


def pixel_class(covered: Column, ground: Column, canopy: Column) -> Column:
    """0 missing, 1 not ground, 2 ground, 3 ground under canopy."""
    return F.when(~covered, 0).when(~ground, 1).when(canopy, 3).otherwise(2)


def with_canopy(bits: Column, ground: Column, canopy: Column, frames: int = HOURS) -> Column:
    """Ground under canopy counts as shaded in all frames (the corrected surface)."""
    return F.when(ground & canopy, F.lit(all_hours(frames))).otherwise(bits)


def is_ground(valid: Column, height: Column, below: float = 2.0) -> Column:
    return F.coalesce(valid & (height < below), F.lit(False))


def pack(count: Column, bits: Column) -> Column:
    """Count and mask in one number."""
    return count * F.lit(1 << 16) + bits


def unpack(value: Column) -> tuple[Column, Column]:
    return F.shiftright(value, 16), value.bitwiseAND(F.lit((1 << 16) - 1))


def consistent(count: Column, bits: Column) -> Column:
    """Whether a packed count is that of its mask, and no bit lies beyond the hours."""
    return (F.shiftright(bits, HOURS) == 0) & (count == F.bit_count(bits))


def packed(flags: dict[int, Column]) -> Column:
    """A mask from hourly booleans by bit position; null counts as false."""
    bit = lambda p, c: F.when(c, 1 << p).otherwise(0)
    out = F.lit(0)
    for p, c in flags.items():
        out = out.bitwiseOR(bit(p, c))
    return out


def hour_state(count: Column, bits: Column, position: int, canopy: Column, corrected: bool) -> Column:
    """no data, shaded or sunlit at one hour. Canopy on the corrected surface is shaded, even without a count."""
    under = F.coalesce(canopy, F.lit(False)) if corrected else F.lit(False)
    return F.when(under, "shaded").when(count == 0, "no data").when(hour_set(bits, position), "shaded").otherwise("sunlit")

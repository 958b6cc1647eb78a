"""Rules of the plot game and the daily puzzle, and a seeded generator, as column expressions. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds and factors of the rules.
OVERRIPE, PROBLEM_WINDOW, PROBLEM_PENALTY, SKIP_SECONDS, SPEED_UPGRADE = 172_800, 10_800, 0.8, 1500, 0.1
# Limits of the notes on a frame.
SIDE_EASY, SIDE_ANY, SHARP_EASY, SHARP_ANY, SHARP_BLUR, FILL_EASY, WRONG_COSINE, WRONG_SHARPNESS = 600, 250, 250, 40, 5, 0.10, 0.65, 200


def problem_active(variety: Column, problem_at: Column, fixed: Column, now: Column, speed: float = 1) -> Column:
    return variety.isNotNull() & problem_at.isNotNull() & ~fixed & (now >= problem_at) & (now < problem_at + PROBLEM_WINDOW * 1000 / speed)


def plot_stage(variety: Column, planted: Column, ready: Column, problem: Column, now: Column, speed: float = 1) -> Column:
    """empty, problem, overripe, ripe, or how far it has grown: sapling, leaves, green."""
    grown = (now - planted) / F.nullif(ready - planted, F.lit(0))
    return (
        F.when(variety.isNull(), "empty")
        .when(problem, "problem")
        .when(now >= ready + OVERRIPE * 1000 / speed, "overripe")
        .when(now >= ready, "ripe")
        .when(grown * 3 < 1, "sapling")
        .when(grown * 3 < 2, "leaves")
        .otherwise("green")
    )


def harvest_yield(base: Column, ready: Column, problem_at: Column, fixed: Column, now: Column, speed: float = 1) -> Column:
    """Half when overripe, less after a problem that was let pass; one at least, half rounded up."""
    late = F.when(now >= ready + OVERRIPE * 1000 / speed, 0.5).otherwise(1.0)
    spoiled = F.when(problem_at.isNotNull() & ~fixed & (now >= problem_at + PROBLEM_WINDOW * 1000 / speed), PROBLEM_PENALTY).otherwise(1.0)
    return F.greatest(F.lit(1), F.floor(base * late * spoiled + 0.5))


def skip_cost(ready: Column, now: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), ready - now) / 1000 / SKIP_SECONDS))


def upgrade_factor(level: Column) -> Column:
    return F.greatest(F.lit(0.5), 1 - SPEED_UPGRADE * level)


def puzzle_cells(guess: Column, answer: Column) -> Column:
    """ok or no for colour, region and grape; a winery of the right region is near."""
    same = lambda f: guess[f].eqNullSafe(answer[f])
    return F.array(*[F.when(same(f), "ok").otherwise("no") for f in ("color", "region", "grape")], F.when(same("winery"), "ok").when(same("region"), "near").otherwise("no"))


def puzzle_hints(answer: list[Column], solved: Column, guesses: Column) -> Column:
    """Hints in order: one for each wrong guess, all once it is solved; the others are null."""
    shown = F.when(solved, len(answer)).otherwise(guesses)
    return F.array(*[F.when(shown > i, a) for i, a in enumerate(answer)])


def frame_notes(group: Column, side: Column, sharpness: Column, fill: Column, cosine: Column) -> Column:
    """What is wrong with a frame: small, blurred, smeared, far, wrong_bottle; none for a good one."""
    easy = group.isin("easy", "catalog")
    rules = {
        "small": side < F.when(easy, SIDE_EASY).otherwise(SIDE_ANY),
        "blurred": (group == "blur") & (sharpness < SHARP_BLUR),
        "smeared": (group != "blur") & (sharpness < F.when(easy, SHARP_EASY).otherwise(SHARP_ANY)),
        "far": easy & (fill < FILL_EASY),
        "wrong_bottle": cosine.isNotNull() & (sharpness > WRONG_SHARPNESS) & (cosine < WRONG_COSINE),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2**32, in parts that a long holds."""
    upper = F.shiftright(a, 16)
    return F.pmod(F.shiftleft(F.pmod(upper * b, F.lit(1 << 16)), 16) + F.pmod(a, F.lit(1 << 16)) * b, F.lit(1 << 32))


def draw(seed: Column, turn: Column) -> Column:
    """The turn-th (from 1) number in [0, 1) of a 32-bit generator that adds a constant and mixes; seed is an unsigned long."""
    a = F.pmod(seed + turn.cast("long") * F.lit(0x6D2B79F5), F.lit(1 << 32))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = F.pmod(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long"))), F.lit(1 << 32)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(1 << 32))

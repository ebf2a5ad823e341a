"""Run planning and progress as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pace:
    """Settings of a run."""

    min_delay_ms: int = 4000
    max_delay_ms: int = 15000
    items_per_run: int = 25
    backlog_threshold: int = 5
    ramp_runs: int = 6
    saturation: int = 200


# Fixed values. By kind of run: how much of the way from the quick to the slow delay it starts at, and what a
# full backlog adds. Then: what a favourite keeps of that way, growth of the delay with each failure in a row,
# and bounds in seconds of the pause before the next run.
PACES = {"first": (0.35, 0.65), "catch-up": (0.35, 0.65), "top-up": (0.2, 0.0)}
FAVORITE = 0.75
STRAIN = (1.0, 1.5, 2.25, 3.375, 5.0625)
PAUSE = (300.0, 14400.0)


def plan_run(backlog: Column, is_new: Column, favorite: Column, failures: Column, pace: Pace = Pace(), spread: float = 1.0) -> dict[str, Column]:
    """budget, base_delay_ms, spread_over_runs, requeue_delay_seconds, paced and reason of one run.

    The kind of a run decides all: idle without a backlog, first for a new account, catch-up from
    ``backlog_threshold`` open items on, else top-up. A run leaves the rest of its backlog to the next
    one, after a quarter of the time that the rest would take; ``spread`` stretches that pause.
    """
    kind = F.when(backlog <= 0, "idle").when(is_new, "first").when(backlog >= max(1, pace.backlog_threshold), "catch-up").otherwise("top-up")
    of_kind = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind]
    parts = of_kind({"idle": 0, "first": max(1, pace.ramp_runs), "catch-up": 1, "top-up": 1})
    budget = F.when(parts == 0, 0).otherwise(F.least(F.ceil(backlog / F.nullif(parts, F.lit(0))), F.lit(max(1, pace.items_per_run)))).cast("long")
    rest = F.greatest(backlog, F.lit(0)) - budget

    quick, slow = sorted((pace.min_delay_ms, pace.max_delay_ms))
    start, slope = (of_kind({name: values[k] for name, values in PACES.items()}) for k in (0, 1))
    way = (slow - quick) * (start + slope * F.least(F.lit(1.0), backlog / F.lit(float(pace.saturation))))
    calm = (quick + way * F.when(favorite, FAVORITE).otherwise(1.0)).cast("int")
    strain = F.array(*map(F.lit, STRAIN))[F.least(failures, F.lit(len(STRAIN) - 1)).cast("int")]
    delay = F.when(kind == "idle", pace.min_delay_ms).when(failures > 0, F.least(calm * strain, F.lit(4.0 * slow)).cast("int")).otherwise(calm)

    pause = F.greatest(F.lit(PAUSE[0]), F.least(F.lit(PAUSE[1]), rest * delay / F.lit(4000.0)))
    return {
        "budget": budget,
        "base_delay_ms": delay.cast("int"),
        "spread_over_runs": F.when(kind == "idle", 1).otherwise(F.ceil(backlog / F.nullif(budget, F.lit(0)))).cast("long"),
        "requeue_delay_seconds": F.when(rest > 0, pause * spread).otherwise(0.0),
        "paced": kind.isin("first", "catch-up"),
        "reason": F.concat_ws(" ", kind, F.lit("run:"), budget.cast("string"), F.lit("of"), F.greatest(backlog, F.lit(0)).cast("string"), F.lit("open items")),
    }


def percent_complete(downloaded: Column, skipped: Column, expected: Column, half_even: bool = False) -> Column:
    """At most 100, null without expected items. The queue rounds halves up, cards to even."""
    share = 100.0 * (downloaded + skipped) / expected
    rounded = F.bround(share) if half_even else F.round(share)
    return F.when(expected > 0, F.least(F.lit(100), rounded.cast("long")))


def estimated_missing(expected: Column, have: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(expected, have) - have)


def expected_items(pending: Column, missing: Column) -> Column:
    """Items that a job is expected to take: the open backlog, or what seems to be missing if there is none."""
    return F.when(pending > 0, pending).otherwise(F.coalesce(missing, F.lit(0)))

"""Ticket workflow analysis: where tickets wait and which miss their target.

A ticket passes created -> intake -> triage -> work -> resolved. Rows whose five
times are complete and in order are *valid*; only those are measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmeter.functions.numbers import at_least_one, first_largest, share
from opsmeter.functions.times import MICROS_PER_HOUR, as_hours, micros_between, parse_timestamp
from opsmeter.operators.keys import mark_rows, repeated_keys
from opsmeter.operators.median import weighted_median

TIMES = ["created_at", "intake_at", "triage_at", "work_at", "resolved_at"]

# duration of each stage, in workflow order
STAGES = {
    "intake": micros_between("created_at", "intake_at"),
    "triage": micros_between("intake_at", "triage_at"),
    "work": micros_between("triage_at", "work_at"),
    "review": micros_between("work_at", "resolved_at"),
}
CYCLE = micros_between("created_at", "resolved_at")

IN_ORDER = "coalesce(" + " AND ".join(f"{a} <= {b}" for a, b in zip(TIMES, TIMES[1:])) + ", false)"
MISSES_TARGET = f"coalesce({CYCLE} > sla_target_hours * {MICROS_PER_HOUR}L, false)"


def deduplicate(raw: DataFrame) -> DataFrame:
    """Read the times, drop rows equal in every column, and add what that pass knows.

    ``is_valid_timeline`` says whether the times are in order, ``copies`` how many raw rows a
    ticket stands for. Unreadable times are equal. Both are aggregates: as a filter
    on the grouping columns Spark would repeat the parsing for it below the shuffle.
    """
    kinds = dict(raw.dtypes)
    parsed = raw.withColumns({c: F.expr(parse_timestamp(c, kinds[c] == "string")) for c in TIMES})
    return parsed.groupBy(*parsed.columns).agg(
        F.expr(f"bool_and({IN_ORDER}) AS is_valid_timeline"), F.expr("count(1) AS copies")
    )


def flag_repeated_ids(tickets: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Add ``is_duplicate_ticket_id`` to deduplicated tickets; null ids are equal.

    ``repeated`` may hand in the stored repeated ids of stored tickets. Spark then knows
    their size beforehand and broadcasts them instead of moving the tickets.
    """
    if repeated is None:
        repeated = repeated_keys(tickets, "ticket_id", counted="is_valid_timeline")
    flagged = mark_rows(tickets, "ticket_id", repeated, "is_duplicate_ticket_id")
    columns = [c for c in tickets.columns if c not in ("is_valid_timeline", "copies")]
    return flagged.select(*columns, "is_duplicate_ticket_id", "is_valid_timeline")


def prepare(raw: DataFrame) -> DataFrame:
    """Deduplicated tickets with ``is_duplicate_ticket_id`` and ``is_valid_timeline``."""
    return flag_repeated_ids(deduplicate(raw))


def rejected(prepared: DataFrame) -> DataFrame:
    return prepared.where("NOT is_valid_timeline")


def clean(prepared: DataFrame) -> DataFrame:
    """Valid tickets with stage hours, the target flag and the longest stage."""
    return prepared.where("is_valid_timeline").selectExpr(
        "*",
        f"{as_hours(CYCLE)} AS cycle_time_hours",
        *[f"{as_hours(micros)} AS {name}_hours" for name, micros in STAGES.items()],
        f"{MISSES_TARGET} AS sla_breached",
        f"{first_largest(STAGES)} AS bottleneck_stage",
    )


def cycle_counts(deduplicated: DataFrame) -> DataFrame:
    """Tickets, those that miss their target, and raw rows per cycle time; null if not valid.

    All that ``kpi_overall`` needs, in one pass; it reads this several times, so store it.
    """
    return (
        deduplicated.selectExpr(
            f"IF(is_valid_timeline, {CYCLE}, NULL) AS cycle_micros", f"{MISSES_TARGET} AS missed", "copies"
        )
        .groupBy("cycle_micros")
        .agg(
            F.expr("count(1) AS tickets"),
            F.expr("count_if(missed) AS missed"),
            F.expr("sum(copies) AS raw_rows"),
        )
    )


def kpi_overall(cycles: DataFrame) -> DataFrame:
    """One row over all tickets, from ``cycle_counts``."""
    totals = cycles.agg(
        F.expr("coalesce(sum(raw_rows), 0) AS rows_raw"),
        F.expr("coalesce(sum(tickets), 0) AS kept"),
        F.expr("coalesce(sum(tickets) FILTER (WHERE cycle_micros IS NOT NULL), 0) AS valid"),
        F.expr("sum(missed) FILTER (WHERE cycle_micros IS NOT NULL) AS missed"),
        # bigint sums overflow beyond some 10^8 tickets of 20 hours
        F.expr("sum(CAST(cycle_micros AS DECIMAL(20,0)) * tickets) AS micros"),
    )
    return totals.withColumn(
        "middle", weighted_median(cycles, "cycle_micros", "tickets").scalar()
    ).selectExpr(
        "rows_raw",
        "kept AS rows_after_drop_duplicates",
        "rows_raw - kept AS duplicate_rows_removed",
        "valid AS rows_valid_timeline",
        "kept - valid AS rows_rejected_invalid_timeline",
        f"{share('valid', at_least_one('kept'))} AS pct_valid",
        f"{as_hours(share('micros', 'valid'))} AS avg_cycle_time_hours",
        f"{as_hours('middle')} AS median_cycle_time_hours",
        f"{share('missed', 'valid')} AS sla_breach_rate",
    )


KEYS = ["priority", "category", "owner_team"]


def measures(deduplicated: DataFrame) -> DataFrame:
    """Sums over valid tickets per priority, category, owner team and longest stage.

    A small table of which every KPI per group is a roll-up: the durations are
    computed once, in one pass.
    """
    return (
        deduplicated.where("is_valid_timeline")
        .selectExpr(
            *KEYS,
            f"{first_largest(STAGES)} AS bottleneck_stage",
            "ticket_id",
            f"{CYCLE} AS cycle_micros",
            f"{MISSES_TARGET} AS missed",
        )
        .groupBy(*KEYS, "bottleneck_stage")
        .agg(
            F.expr("count(ticket_id) AS tickets"),
            F.expr("count(1) AS measured"),
            F.expr("sum(CAST(cycle_micros AS DECIMAL(20,0))) AS micros"),
            F.expr("count_if(missed) AS missed"),
        )
    )


def _per_key(sums: DataFrame, key: str) -> DataFrame:
    totals = [F.expr(f"sum({c}) AS {c}") for c in ("tickets", "measured", "micros", "missed")]
    return (
        sums.where(f"{key} IS NOT NULL")
        .groupBy(key)
        .agg(*totals)
        .selectExpr(
            key,
            "tickets",
            f"{as_hours(share('micros', 'measured'))} AS avg_cycle_time_hours",
            f"{share('missed', 'measured')} AS sla_breach_rate",
        )
    )


def kpi_by(sums: DataFrame, key: str) -> DataFrame:
    """Tickets, mean cycle time and miss rate per one of ``KEYS``, from ``measures``.

    Tickets without the key are left out. Worst miss rate first.
    """
    return _per_key(sums, key).orderBy(
        F.desc("sla_breach_rate"), F.desc("avg_cycle_time_hours"), key
    )


def bottlenecks(sums: DataFrame) -> DataFrame:
    """Tickets and mean whole cycle time per longest stage, most frequent first."""
    return (
        _per_key(sums, "bottleneck_stage")
        .drop("sla_breach_rate")
        .orderBy(F.desc("tickets"), "bottleneck_stage")
    )


def top_bottlenecks(per_stage: DataFrame, count: int = 5) -> DataFrame:
    return per_stage.orderBy(F.desc("tickets"), "bottleneck_stage").limit(count)

import pytest

from opsmeter.plans import tickets
from testbed import frames
from tests.conftest import executed_plan

SCHEMA = """ticket_id STRING, created_at STRING, intake_at STRING, triage_at STRING, work_at STRING,
            resolved_at STRING, category STRING, priority STRING, channel STRING, owner_team STRING,
            sla_target_hours INT"""
DAY = "2024-05-01 "


def ticket(number, *hours, priority="High", target=24):
    texts = [h if h is None or "-" in str(h) else f"{DAY}{h}" for h in hours]
    return (number, *texts, "Billing", priority, "Web", "Team-A", target)


@pytest.fixture
def raw(rows):
    return rows(
        SCHEMA,
        ticket("T1", "01:00:00", "01:00:00", "02:00:00", "03:00:00", "03:00:00"),  # ties are valid
        ticket("T2", "00:00:00", "01:00:00", "02:00:00", "03:00:00", "2024-05-02 00:00:00"),  # = target
        ticket("T3", "00:00:00", "01:00:00", "02:00:00", "03:00:00", "2024-05-02 00:00:00.000001"),
        ticket("T4", "00:00:00", "03:00:00", "02:00:00", "04:00:00", "05:00:00"),  # out of order
        ticket("T5", "00:00:00", None, "02:00:00", "04:00:00", "05:00:00"),
        ticket("T6", "00:00:00", "no-date", "02:00:00", "04:00:00", "05:00:00"),
        ticket("T6", "00:00:00", "not-a-date", "02:00:00", "04:00:00", "05:00:00"),  # same as above
        ticket("T1", "01:00:00", "01:00:00", "02:00:00", "03:00:00", "03:00:00"),  # exact copy
        ticket("T2", "00:00:00", "06:00:00", "06:00:00", "06:00:00", "07:00:00", priority=None, target=None),
        ticket(None, "00:00:00", "01:00:00", "02:00:00", "03:00:00", "04:00:00", priority="Low"),
        ticket(None, "00:00:00", "01:00:00", "02:00:00", "03:00:00", "05:00:00", priority="Low"),
    )


def test_prepare(raw):
    prepared = tickets.prepare(raw)
    flags = prepared.select("ticket_id", "is_duplicate_ticket_id", "is_valid_timeline").collect()
    assert sorted(tuple(map(str, r)) for r in flags) == [
        ("None", "True", "True"),
        ("None", "True", "True"),
        ("T1", "False", "True"),
        ("T2", "True", "True"),
        ("T2", "True", "True"),
        ("T3", "False", "True"),
        ("T4", "False", "False"),
        ("T5", "False", "False"),
        ("T6", "False", "False"),
    ]
    assert {r[0] for r in tickets.rejected(prepared).select("ticket_id").collect()} == {"T4", "T5", "T6"}


def test_clean(raw):
    clean = tickets.clean(tickets.prepare(raw))
    measures = clean.select(
        "ticket_id", "cycle_time_hours", "intake_hours", "sla_breached", "bottleneck_stage"
    ).collect()
    assert sorted(tuple(r) for r in measures if r[0]) == [
        ("T1", 2.0, 0.0, False, "triage"),  # triage and work take as long: the first
        ("T2", 7.0, 6.0, False, "intake"),
        ("T2", 24.0, 1.0, False, "review"),
        ("T3", (24 * 3_600_000_000 + 1) / 3.6e9, 1.0, True, "review"),
    ]
    assert clean.columns == [*raw.columns, "is_duplicate_ticket_id", "is_valid_timeline",
                             "cycle_time_hours", "intake_hours", "triage_hours", "work_hours",
                             "review_hours", "sla_breached", "bottleneck_stage"]


def test_kpis(raw):
    once = tickets.deduplicate(raw)
    overall = tickets.kpi_overall(tickets.cycle_counts(once)).collect()[0].asDict()
    cycles = [2.0, 24.0, (24 * 3_600_000_000 + 1) / 3.6e9, 7.0, 4.0, 5.0]
    assert overall == {
        "rows_raw": 11,
        "rows_after_drop_duplicates": 9,
        "duplicate_rows_removed": 2,
        "rows_valid_timeline": 6,
        "rows_rejected_invalid_timeline": 3,
        "pct_valid": 6 / 9,
        "avg_cycle_time_hours": pytest.approx(sum(cycles) / 6),
        "median_cycle_time_hours": 6.0,
        "sla_breach_rate": 1 / 6,
    }
    sums = tickets.measures(once)
    by_priority = [tuple(r) for r in tickets.kpi_by(sums, "priority").collect()]
    assert by_priority == [  # a missing priority is no group, a missing id does not count
        ("High", 3, pytest.approx(sum(cycles[:3]) / 3), 1 / 3),
        ("Low", 0, 4.5, 0.0),
    ]
    stages = [tuple(r) for r in tickets.bottlenecks(sums).collect()]
    assert [s[:2] for s in stages] == [("review", 2), ("intake", 1), ("triage", 1)]
    assert len(tickets.top_bottlenecks(tickets.bottlenecks(sums), 2).collect()) == 2


def test_empty_input(raw):
    nothing = raw.limit(0)
    prepared = tickets.prepare(nothing)
    assert tickets.clean(prepared).count() == tickets.rejected(prepared).count() == 0
    assert tickets.kpi_by(tickets.measures(tickets.deduplicate(nothing)), "priority").count() == 0
    assert list(tickets.kpi_overall(tickets.cycle_counts(tickets.deduplicate(nothing))).collect()[0]) == [0, 0, 0, 0, 0, 0.0, None, None, None]


def test_weighted_group_means_give_the_overall_figure(spark, folder):
    raw = frames.tickets_raw(spark, folder)
    clean = tickets.clean(tickets.deduplicate(raw)).where("priority IS NOT NULL")
    overall = clean.selectExpr("avg(cycle_time_hours)", "avg(CAST(sla_breached AS INT))").collect()[0]
    for key in ("priority", "category", "owner_team"):
        sums = tickets.measures(tickets.deduplicate(raw).where("priority IS NOT NULL"))
        groups = tickets.kpi_by(sums, key).collect()
        size = sum(g.tickets for g in groups)
        assert sum(g.tickets * g.avg_cycle_time_hours for g in groups) / size == pytest.approx(overall[0])
        assert sum(g.tickets * g.sla_breach_rate for g in groups) / size == pytest.approx(overall[1])


def test_duplicates_are_dropped_once(spark, folder):
    """Flagging repeated ids and picking valid rows share one deduplicating shuffle."""
    plan = executed_plan(tickets.clean(tickets.prepare(frames.tickets_raw(spark, folder))))
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_hot_ticket_id(spark):
    """A third of the rows share one id, and a third are copies of one row."""
    raw = spark.range(30_000).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'copy' ELSE concat('T', id) END AS ticket_id",
        *[
            f"CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, IF(id % 3 = 1, {i}, id * {i}))"
            f" AS STRING) AS {name}"
            for i, name in enumerate(tickets.TIMES)
        ],
        "'a' AS category", "'b' AS priority", "'c' AS channel", "'d' AS owner_team", "8 AS sla_target_hours",
    )
    prepared = tickets.prepare(raw)
    flags = {(r[0], r[1]): r[2] for r in prepared.groupBy(
        "is_duplicate_ticket_id", "is_valid_timeline").count().collect()}
    assert flags == {(True, True): 10_000, (False, True): 10_001}

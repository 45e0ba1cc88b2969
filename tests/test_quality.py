from datetime import datetime, timedelta, timezone

import pytest

from opsmeter.operators.staging import stage
from opsmeter.plans import quality
from testbed import frames
from tests.conftest import executed_plan

AS_OF = datetime(2024, 1, 1)
PEOPLE = "row_id BIGINT, customer_id STRING, email STRING, signup_date STRING, country STRING, status STRING"
PAYMENTS = """row_id BIGINT, transaction_id STRING, customer_id STRING, transaction_date STRING,
              amount STRING, currency STRING, channel STRING"""
# The rules' names, severities and texts that the tests below expect.
CUSTOMERS = quality.customer_checks(AS_OF)
TRANSACTIONS = quality.transaction_checks(AS_OF)


@pytest.fixture
def people(rows):
    return rows(
        PEOPLE,
        (0, "C1", "a@b.c", "2023-01-01", "US", "Active"),
        (1, "C2", " a@b.c", "2024-01-01", "US", "Inactive"),  # not later than as_of
        (2, "C2", "\xa0", "2024-01-02", "us", "active"),
        (3, None, None, None, None, None),
        (4, " ", "a@@b.c", "2023-02-30", "XX", "Active"),
        (5, None, "a@b.c", " ", "IN", "Active"),
    )


@pytest.fixture
def payments(rows):
    return rows(
        PAYMENTS,
        (0, "T1", "C1", "2023-05-01", "12.5", "USD", "Web"),
        (1, "T2", "C9", "2024-06-01", "0", "USD", "Web"),
        (2, "T2", None, None, "nan", "usd", None),
        (3, "\t", " ", "soon", "1d", None, "Kiosk"),
        (4, None, "C2", " ", "-1e16", "EUR", "Store"),
        (5, "T3", "C1", "2023-05-01", "-0.25", "GBP", "Partner"),
        (6, "T4", "C1", "2023-05-01", "inf", "CAD", "Mobile"),
    )


def log_of(flagged, checks):
    log = quality.issues(flagged, checks)
    assert log.columns == ["table", "record_id", "column", "rule", "severity", "details", "severity_rank"]
    return sorted((r.record_id, r.column, r.rule, r.severity, r.details) for r in log.collect())


def test_customer_rules(people):
    assert log_of(quality.flag_customers(people), CUSTOMERS) == sorted([
        ("row_3", "customer_id", "not_null", "high", "customer_id is missing"),
        ("row_4", "customer_id", "not_null", "high", "customer_id is missing"),
        ("row_5", "customer_id", "not_null", "high", "customer_id is missing"),
        ("C2", "customer_id", "unique", "high", "duplicate customer_id"),
        ("C2", "customer_id", "unique", "high", "duplicate customer_id"),
        ("nan", "customer_id", "unique", "high", "duplicate customer_id"),
        ("nan", "customer_id", "unique", "high", "duplicate customer_id"),
        ("C2", "email", "not_null", "medium", "email is missing"),
        ("nan", "email", "not_null", "medium", "email is missing"),
        ("C2", "email", "valid_email", "medium", "invalid email:  a@b.c"),
        (" ", "email", "valid_email", "medium", "invalid email: a@@b.c"),
        ("nan", "signup_date", "valid_date", "high", "invalid signup_date: nan"),
        (" ", "signup_date", "valid_date", "high", "invalid signup_date: 2023-02-30"),
        ("nan", "signup_date", "valid_date", "high", "invalid signup_date:  "),
        ("C2", "signup_date", "not_future", "medium", "future signup_date: 2024-01-02"),
        ("C2", "country", "allowed_values", "low", "unexpected country: us"),
        ("nan", "country", "allowed_values", "low", "unexpected country: nan"),
        (" ", "country", "allowed_values", "low", "unexpected country: XX"),
        ("C2", "status", "allowed_values", "low", "unexpected status: active"),
        ("nan", "status", "allowed_values", "low", "unexpected status: nan"),
    ])


def test_transaction_rules(payments, people):
    assert log_of(quality.flag_transactions(payments, people), TRANSACTIONS) == sorted([
        ("row_3", "transaction_id", "not_null", "high", "transaction_id is missing"),
        ("row_4", "transaction_id", "not_null", "high", "transaction_id is missing"),
        ("T2", "transaction_id", "unique", "high", "duplicate transaction_id"),
        ("T2", "transaction_id", "unique", "high", "duplicate transaction_id"),
        ("T2", "customer_id", "not_null", "high", "customer_id is missing"),
        ("\t", "customer_id", "not_null", "high", "customer_id is missing"),
        ("T2", "customer_id", "fk_exists", "high", "customer_id not found: C9"),
        ("T2", "customer_id", "fk_exists", "high", "customer_id not found: nan"),
        ("T2", "transaction_date", "not_null", "high", "transaction_date is missing"),
        ("nan", "transaction_date", "not_null", "high", "transaction_date is missing"),
        ("\t", "transaction_date", "valid_date", "high", "invalid transaction_date: soon"),
        ("T2", "transaction_date", "not_future", "medium", "future transaction_date: 2024-06-01"),
        ("T2", "amount", "not_null", "high", "amount is missing or non-numeric"),
        ("\t", "amount", "not_null", "high", "amount is missing or non-numeric"),
        ("T2", "amount", "positive", "high", "non-positive amount: 0.0"),
        ("nan", "amount", "positive", "high", "non-positive amount: -1e+16"),
        ("T3", "amount", "positive", "high", "non-positive amount: -0.25"),
        ("T2", "currency", "allowed_values", "low", "unexpected currency: usd"),
        ("\t", "currency", "allowed_values", "low", "unexpected currency: nan"),
        ("T2", "channel", "allowed_values", "low", "unexpected channel: nan"),
        ("\t", "channel", "allowed_values", "low", "unexpected channel: Kiosk"),
    ])


def counted(table):
    flagged, checks = table
    return quality.counts(flagged, checks), checks


def test_summary_and_breakdowns(people, payments):
    one = quality.flag_customers(people), CUSTOMERS
    two = quality.flag_transactions(payments, people), TRANSACTIONS
    summary = quality.table_summary(*counted(one)).collect()[0].asDict()
    assert summary["rows"] == 6 and summary["issue_count"] == 20
    assert summary["duplicate_rate"] == 4 / 6
    assert summary["completeness_customer_id"] == 3 / 6
    assert summary["completeness_email"] == 4 / 6
    assert summary["quality_score"] == 0.0  # more than 1.67 violations per row
    second = quality.table_summary(*counted(two)).collect()[0]
    assert second.completeness_amount == 5 / 7  # measured after reading the number
    card = quality.scorecard(quality.table_summary(*counted(one)), quality.table_summary(*counted(two))).collect()
    assert [r["table"] for r in card] == ["OVERALL", "customers", "transactions"]
    assert card[0].rows == 13 and card[0].issue_count == 41 and card[0].issue_rate == 41 / 13
    assert card[0].duplicate_rate == (4 / 6 + 2 / 7) / 2
    assert card[0].completeness_customer_id is None and card[1].completeness_channel is None
    assert card[2].completeness_customer_id == 5 / 7
    total = quality.overall(quality.table_summary(*counted(one)), quality.table_summary(*counted(two))).collect()[0]
    assert tuple(total) == tuple(card[0])[:7]

    rates = quality.combined(quality.failure_rates(*counted(one)), quality.failure_rates(*counted(two)))
    assert [tuple(r) for r in quality.top_rules(rates, 3).collect()] == [
        ("transactions", "not_null", 8),
        ("customers", "allowed_values", 5),
        ("customers", "not_null", 5),
    ]
    ranks = quality.issues_by_severity(rates).collect()
    assert sum(r.issues for r in ranks) == 41 and ranks[0].severity_rank == 3
    status = {r.row_id: (r.violations, r.status) for r in quality.record_status(*one).collect()}
    assert status[0] == (0, "clean") and status[5] == (3, "failed")
    rates = {(r.column, r.rule): r.failure_rate for r in quality.failure_rates(*counted(two)).collect()}
    assert len(rates) == 11 and rates["amount", "positive"] == 3 / 7


def test_empty_tables(people, payments):
    nobody, nothing = people.limit(0), payments.limit(0)
    one = quality.flag_customers(nobody), CUSTOMERS
    two = quality.flag_transactions(nothing, nobody), TRANSACTIONS
    assert quality.combined(quality.issues(*one), quality.issues(*two)).count() == 0
    card = quality.scorecard(quality.table_summary(*counted(one)), quality.table_summary(*counted(two))).collect()
    assert [(r.rows, r.issue_count, r.issue_rate, r.quality_score) for r in card] == [(0, 0, 0.0, 100.0)] * 3
    assert all(r.duplicate_rate is None and r.completeness_overall is None for r in card)
    # one empty table: its missing rates make the overall mean missing too
    full = quality.table_summary(*counted((quality.flag_customers(people), CUSTOMERS)))
    mixed = quality.overall(full, quality.table_summary(*counted(two))).collect()[0]
    assert mixed.duplicate_rate is None and mixed.quality_score == 50.0


def test_log_is_one_pass_in_generated_code(spark, folder):
    payments, people = frames.transactions_raw(spark, folder), frames.customers_raw(spark, folder)
    # stored keys: their size is known, so they are broadcast
    keys = stage(quality.faulty_transaction_keys(payments, people))
    flagged = quality.flag_transactions(payments, people, keys)
    plan = executed_plan(quality.issues(flagged, TRANSACTIONS))
    final = plan.split("Initial Plan")[0]
    assert ") Generate inline" in final
    assert final.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in final
    assert "Exchange hashpartitioning" not in final  # no row moves


def test_hot_customer(spark):
    """A third of the payments name one unknown customer, a third name none."""
    payments = spark.range(30_000).selectExpr(
        "id AS row_id", "concat('T', id) AS transaction_id",
        "CASE id % 3 WHEN 0 THEN 'C9' WHEN 1 THEN NULL ELSE 'C1' END AS customer_id",
        "'2023-01-01' AS transaction_date", "'1' AS amount", "'USD' AS currency", "'Web' AS channel",
    )
    people = spark.createDataFrame([(0, "C1", "a@b.c", "2023-01-01", "US", "Active")], PEOPLE)
    flagged = quality.flag_transactions(payments, people)
    rates = quality.failure_rates(*counted((flagged, TRANSACTIONS))).collect()
    failed = {(r.column, r.rule): r.failed_records for r in rates}
    assert failed["customer_id", "fk_exists"] == 20_000
    assert failed["customer_id", "not_null"] == 10_000


def test_as_of_and_dates_with_offsets(spark):
    """Moments with an offset are compared in UTC."""
    five_hours_east = timezone(timedelta(hours=5))
    people = spark.createDataFrame(
        [
            (0, "C1", "a@b.c", "2023-01-01 10:00:00+05:00", "US", "Active"),  # 05:00 UTC
            (1, "C2", "a@b.c", "2023-01-01 10:00:00", "US", "Active"),
            (2, "C3", "a@b.c", "2023-01-01T04:59:59Z", "US", "Active"),
        ],
        PEOPLE,
    )
    checks = quality.customer_checks(datetime(2023, 1, 1, 9, 59, 59, tzinfo=five_hours_east))
    found = quality.issues(quality.flag_customers(people), checks).collect()
    assert sorted((r.record_id, r.rule) for r in found) == [("C1", "not_future"), ("C2", "not_future")]


def largest_method(spark, frame):
    """Bytes of the largest generated method of a plan; the JVM interprets those over 8,000."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(frame._jdf.queryExecution().executedPlan())
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.set(name, before)


def test_passes_over_the_rows_are_compiled(spark, folder):
    name = "spark.sql.adaptive.enabled"
    spark.conf.set(name, "false")  # plans are made once
    try:
        people, payments = frames.customers_raw(spark, folder), frames.transactions_raw(spark, folder)
        tables = [(quality.flag_customers(people), CUSTOMERS), (quality.flag_transactions(payments, people), TRANSACTIONS)]
        for job in (quality.counts, quality.issues, quality.record_status):
            for table in tables:
                assert largest_method(spark, job(*table)) < 8000
    finally:
        spark.conf.set(name, "true")

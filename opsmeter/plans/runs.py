"""The three runs: read the inputs, compute, rewrite the output tables.

What several outputs need is stored once in the shared folder (``stage``), so the
big shuffles of a run happen once; the run removes it at its end. ``fmt`` is a file format for ``target`` as a
folder, or ``table`` for ``target`` as a database. A run's tables appear together at its end
(``Release``); ``read_result`` reads them.

``bad_share`` lets a run go on without the CSV records whose cells do not fit, if no more than
that share of an input is bad; they go to ``_quarantine/<input>`` below the target folder.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from opsmeter.operators.keys import repeated_keys
from opsmeter.operators.staging import stage, staging_area
from opsmeter.plans import quality, sales, tickets
from opsmeter.plans.sales import Star
from opsmeter.sources.sinks import Release
from opsmeter.sources.text import Quarantine, read_records, read_tickets


def _quarantine(release: Release, name: str, bad_share: float | None) -> Quarantine | None:
    return None if bad_share is None else Quarantine(f"{release.root}/_quarantine/{name}", bad_share)


def run_tickets(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str = "parquet",
    multi_line: bool | None = None,
    bad_share: float | None = None,
) -> None:
    """CSV of raw tickets -> clean and rejected tickets and five KPI tables."""
    with staging_area(spark), Release(spark, target, fmt) as release:
        raw = read_tickets(spark, source, multi_line, _quarantine(release, "tickets", bad_share))
        deduplicated = stage(tickets.deduplicate(raw))
        repeated = stage(repeated_keys(deduplicated, "ticket_id"))
        prepared = tickets.flag_repeated_ids(deduplicated, repeated)
        release.save(tickets.clean(prepared), "tickets_clean")
        release.save(tickets.rejected(prepared), "tickets_rejected")
        sums = stage(tickets.measures(deduplicated))
        reports = {
            "kpi_overall": tickets.kpi_overall(stage(tickets.cycle_counts(deduplicated))),
            "kpi_by_priority": tickets.kpi_by(sums, "priority"),
            "kpi_by_category": tickets.kpi_by(sums, "category"),
            "kpi_by_owner": tickets.kpi_by(sums, "owner_team"),
            "kpi_bottlenecks": tickets.bottlenecks(sums),
        }
        for name, report in reports.items():
            release.save_report(report, name)


def run_quality(
    spark: SparkSession,
    customers: str,
    transactions: str,
    target: str,
    as_of: datetime,
    fmt: str = "parquet",
    multi_line: bool | None = None,
    bad_share: float | None = None,
) -> None:
    """CSVs of customers and transactions -> violation log, scorecard, record status, breakdowns."""
    with staging_area(spark), Release(spark, target, fmt) as release:
        # stored by the numbering
        people = read_records(spark, customers, multi_line, _quarantine(release, "customers", bad_share))
        payments = read_records(spark, transactions, multi_line, _quarantine(release, "transactions", bad_share))
        repeated = stage(quality.faulty_customer_keys(people))
        faulty = stage(quality.faulty_transaction_keys(payments, people))
        checked = [
            (quality.flag_customers(people, repeated), quality.customer_checks(as_of)),
            (quality.flag_transactions(payments, people, faulty), quality.transaction_checks(as_of)),
        ]
        # two passes over the rows: the log, and the status, which counts for all else on its way
        log = quality.combined(*[quality.issues(*table) for table in checked])
        watched = [(quality.Watched(*table), table[1]) for table in checked]
        status = quality.combined(*[quality.record_status(table.rows, checks) for table, checks in watched])
        release.save(log, "dq_issues")
        release.save(status, "dq_record_status")
        counted = [(table.counts(), checks) for table, checks in watched]
        rates = quality.combined(*[quality.failure_rates(*table) for table in counted])
        card = quality.scorecard(*[quality.table_summary(*table) for table in counted])
        release.save_report(card, "dq_summary")
        release.save_report(rates, "dq_failure_rates")
        release.save_report(quality.top_rules(rates), "dq_top_rules")
        release.save_report(quality.issues_by_severity(rates), "dq_issues_by_severity")


def register_views(star: Star) -> None:
    """The three enriched views, for SQL in this session."""
    orders = sales.orders_enriched(star)
    orders.createOrReplaceTempView("v_orders_enriched")
    sales.order_items_enriched(star, orders).createOrReplaceTempView("v_order_items_enriched")
    sales.returns_enriched(star, orders).createOrReplaceTempView("v_returns_enriched")


def run_sales(star: Star, target: str, fmt: str = "parquet") -> None:
    """Star schema -> views, six KPI tables and two cohort tables."""
    register_views(star)
    spark = star.fact_orders.sparkSession
    with staging_area(spark), Release(spark, target, fmt) as release:
        orders = stage(sales.orders_enriched(star))
        returns = stage(sales.returns_enriched(star, orders))
        # one look at the ids spares every KPI a shuffle by order
        unique = repeated_keys(orders, "order_id").isEmpty()
        odd_products = stage(sales.odd_products(star))
        odd_orders = stage(sales.odd_orders(star, orders))
        per_order = stage(sales.order_sales(star, orders, unique, odd_products))
        release.save(sales.customer_first_order(orders), "customer_first_order")
        reports = {
            "kpi_monthly": sales.kpi_monthly(per_order, returns, unique).orderBy("order_month"),
            "kpi_by_region": sales.kpi_by_region(per_order, unique).orderBy("region"),
            "kpi_by_channel": sales.kpi_by_channel(per_order, unique).orderBy("channel"),
            "kpi_top_products": sales.kpi_top_products(star, odd=odd_orders),
            "kpi_returns_by_reason": sales.kpi_returns_by_reason(returns),
            "kpi_returns_by_channel": sales.kpi_returns_by_channel(orders, returns, unique),
            "customer_cohorts": sales.customer_cohorts(orders),
        }
        for name, report in reports.items():
            release.save_report(report, name)


def sanity_checks(star: Star, target: str, fmt: str = "parquet") -> None:
    """Row counts, date range and null counts of the base tables."""
    reports = {
        "schema_row_counts": sales.schema_row_counts(star),
        "order_date_range": sales.order_date_range(star),
        "order_null_audit": sales.order_null_audit(star),
    }
    with Release(star.fact_orders.sparkSession, target, fmt) as release:
        for name, report in reports.items():
            release.save_report(report, name)

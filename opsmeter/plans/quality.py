"""Data-quality rules over a customer and a transaction table.

All rules of a table run in one pass: the two checks that look beyond the row
(repeated key, missing parent) arrive as boolean columns, every rule is then a
column expression, and a row carries its violations as an array.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from opsmeter.functions.numbers import (
    at_least_one,
    clamp,
    known_number,
    mean,
    parse_number,
    share,
)
from opsmeter.functions.text import (
    float_text,
    has_email_shape,
    is_blank,
    outside,
    quote,
    text_or_nan,
)
from opsmeter.functions.times import parse_timestamp
from opsmeter.operators.keys import mark_rows, repeated_keys, unmatched_keys

# Fixed values of the rule set.
ALLOWED_COUNTRIES = ["US", "CA", "MX", "GB", "DE", "IN"]
ALLOWED_STATUS = ["Active", "Inactive"]
ALLOWED_CURRENCY = ["USD", "CAD", "GBP", "EUR"]
ALLOWED_CHANNEL = ["Web", "Mobile", "Store", "Partner"]
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}
ISSUE_RATE_PENALTY = 60.0
COMPLETENESS_PENALTY = 30.0
DUPLICATE_PENALTY = 10.0

REPEATED = "key_is_repeated"
ORPHANED = "parent_is_missing"


@dataclass(frozen=True)
class Rule:
    """``fires`` and ``details`` are SQL over the flagged rows of the table."""

    column: str
    name: str
    severity: str
    fires: str
    details: str
    by_position: bool = False  # the record has no id: name it by its row


@dataclass(frozen=True)
class Checks:
    """What to check in one table."""

    table: str
    key: str
    required: list[str]
    rules: list[Rule]


def _shows(text: str, value: str) -> str:
    return f"concat({quote(text + ': ')}, {value})"


def not_null(column: str, severity: str, by_position: bool = False) -> Rule:
    details = quote(f"{column} is missing")
    return Rule(column, "not_null", severity, is_blank(column), details, by_position)


def unique(column: str, severity: str) -> Rule:
    """For the key column of the table."""
    return Rule(column, "unique", severity, REPEATED, quote(f"duplicate {column}"))


def valid_email(column: str, severity: str) -> Rule:
    fires = f"NOT {is_blank(column)} AND NOT {has_email_shape(column)}"
    return Rule(
        column, "valid_email", severity, fires, _shows(f"invalid {column}", text_or_nan(column))
    )


def valid_date(column: str, severity: str, blank_is_invalid: bool) -> Rule:
    fires = f"{column}_parsed IS NULL"
    if not blank_is_invalid:
        fires = f"{fires} AND NOT {is_blank(column)}"
    return Rule(
        column, "valid_date", severity, fires, _shows(f"invalid {column}", text_or_nan(column))
    )


def not_future(column: str, severity: str, as_of: datetime) -> Rule:
    # like the times in the tables: a moment with an offset is taken to UTC
    utc = as_of.astimezone(timezone.utc) if as_of.tzinfo else as_of
    moment = utc.replace(tzinfo=None).isoformat(" ")
    fires = f"coalesce({column}_parsed > TIMESTAMP_NTZ '{moment}', false)"
    return Rule(
        column, "not_future", severity, fires, _shows(f"future {column}", text_or_nan(column))
    )


def allowed_values(column: str, severity: str, allowed: list[str]) -> Rule:
    return Rule(
        column,
        "allowed_values",
        severity,
        outside(column, allowed),
        _shows(f"unexpected {column}", text_or_nan(column)),
    )


def fk_exists(column: str, severity: str) -> Rule:
    return Rule(
        column, "fk_exists", severity, ORPHANED, _shows(f"{column} not found", text_or_nan(column))
    )


def numeric(column: str, severity: str) -> Rule:
    details = quote(f"{column} is missing or non-numeric")
    return Rule(column, "not_null", severity, f"{column} IS NULL", details)


def positive(column: str, severity: str) -> Rule:
    fires = f"coalesce({column} <= 0, false)"
    return Rule(
        column, "positive", severity, fires, _shows(f"non-positive {column}", float_text(column))
    )


def customer_checks(as_of: datetime) -> Checks:
    """The rules of the customer table, their severities and required columns."""
    return Checks(
        "customers",
        key="customer_id",
        required=["customer_id", "email", "signup_date", "country", "status"],
        rules=[
            not_null("customer_id", "high", by_position=True),
            unique("customer_id", "high"),
            not_null("email", "medium"),
            valid_email("email", "medium"),
            valid_date("signup_date", "high", blank_is_invalid=True),
            not_future("signup_date", "medium", as_of),
            allowed_values("country", "low", ALLOWED_COUNTRIES),
            allowed_values("status", "low", ALLOWED_STATUS),
        ],
    )


def transaction_checks(as_of: datetime) -> Checks:
    """The rules of the transaction table, their severities and required columns."""
    return Checks(
        "transactions",
        key="transaction_id",
        required=[
            "transaction_id",
            "customer_id",
            "transaction_date",
            "amount",
            "currency",
            "channel",
        ],
        rules=[
            not_null("transaction_id", "high", by_position=True),
            unique("transaction_id", "high"),
            not_null("customer_id", "high"),
            fk_exists("customer_id", "high"),
            not_null("transaction_date", "high"),
            valid_date("transaction_date", "high", blank_is_invalid=False),
            not_future("transaction_date", "medium", as_of),
            numeric("amount", "high"),
            positive("amount", "high"),
            allowed_values("currency", "low", ALLOWED_CURRENCY),
            allowed_values("channel", "low", ALLOWED_CHANNEL),
        ],
    )


# --- rows with what the rules need -------------------------------------------


def faulty_customer_keys(customers: DataFrame) -> DataFrame:
    """Keys for ``flag_customers``: few, and worth storing, so that their size is known."""
    return repeated_keys(customers, "customer_id")


def flag_customers(customers: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Add the parsed date and the repeated-key flag. Needs ``row_id`` beside the raw columns.

    ``repeated`` may hand in the stored ``faulty_customer_keys``.
    """
    repeated = repeated if repeated is not None else faulty_customer_keys(customers)
    flagged = mark_rows(customers, "customer_id", repeated, REPEATED)
    return flagged.selectExpr("*", f"{parse_timestamp('signup_date')} AS signup_date_parsed")


def faulty_transaction_keys(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """``fault, faulty_key``: repeated transactions and unknown customers; worth storing.

    Their size is then known when Spark plans the join back: few keys are broadcast and
    no row moves.
    """
    repeated = repeated_keys(transactions, "transaction_id")
    orphans = unmatched_keys(transactions, "customer_id", customers, "customer_id")
    return repeated.selectExpr("'repeated' AS fault", "transaction_id AS faulty_key").union(
        orphans.selectExpr("'orphaned' AS fault", "customer_id AS faulty_key")
    )


def flag_transactions(
    transactions: DataFrame, customers: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Add the parsed date, the number of ``amount``, and both key flags.

    ``keys`` may hand in the stored ``faulty_transaction_keys``.
    """
    keys = keys if keys is not None else faulty_transaction_keys(transactions, customers)
    flagged = transactions
    for key, fault, flag in [
        ("transaction_id", "repeated", REPEATED),
        ("customer_id", "orphaned", ORPHANED),
    ]:
        faulty = keys.where(f"fault = '{fault}'").select("faulty_key")
        flagged = mark_rows(flagged, key, faulty, flag)
    is_text = dict(transactions.dtypes)["amount"] == "string"
    return flagged.withColumns(
        {
            "transaction_date_parsed": F.expr(parse_timestamp("transaction_date")),
            "amount": F.expr(parse_number("amount") if is_text else known_number("amount")),
        }
    )


# --- violation log -----------------------------------------------------------


def _record_id(checks: Checks, by_position: bool) -> str:
    return "concat('row_', row_id)" if by_position else text_or_nan(checks.key)


def _violation(rule: Rule, checks: Checks) -> str:
    return f"""IF({rule.fires}, named_struct(
        'record_id', {_record_id(checks, rule.by_position)},
        'column', {quote(rule.column)},
        'rule', {quote(rule.name)},
        'severity', {quote(rule.severity)},
        'details', {rule.details},
        'severity_rank', {SEVERITY_RANK.get(rule.severity, 0)}), NULL)"""


def issues(flagged: DataFrame, checks: Checks) -> DataFrame:
    """One row per violation of one table."""
    found = ", ".join(_violation(rule, checks) for rule in checks.rules)
    # Rules that did not fire leave an empty row to drop: compacting the array
    # instead would take the whole pass out of generated code.
    return flagged.selectExpr(
        f"{quote(checks.table)} AS `table`", f"inline(array({found}))"
    ).where("rule IS NOT NULL")


def combined(*results: DataFrame) -> DataFrame:
    """The logs, record states or failure rates of several tables as one."""
    return reduce(DataFrame.unionByName, results)


def record_status(flagged: DataFrame, checks: Checks) -> DataFrame:
    """Every record as ``clean`` or ``failed``, with its number of violations."""
    fired = " + ".join(f"CAST({rule.fires} AS INT)" for rule in checks.rules)
    return flagged.selectExpr(
        f"{quote(checks.table)} AS `table`",
        "row_id",
        f"{text_or_nan(checks.key)} AS record_id",
        f"{fired} AS violations",
    ).selectExpr("*", "IF(violations > 0, 'failed', 'clean') AS status")


# --- counts of one pass ------------------------------------------------------


def _count_columns(checks: Checks) -> tuple[list[str], list[str]]:
    """What to count over the rows, and what follows from these counts.

    A cell is filled unless its column's ``not_null`` rule fires, so only the other columns are
    looked at twice: the pass over the rows has to stay below the 8,000 bytes of a
    generated method that the JVM compiles.
    """
    missing = {rule.column: i for i, rule in enumerate(checks.rules) if rule.name == "not_null"}
    counted = [
        "count(1) AS `rows`",
        *[f"count_if({rule.fires}) AS failed_{i}" for i, rule in enumerate(checks.rules)],
        f"count_if({REPEATED}) AS repeated",
        *[f"count_if(NOT {is_blank(c)}) AS filled_{c}" for c in checks.required if c not in missing],
    ]
    follows = [f"`rows` - failed_{missing[c]} AS filled_{c}" for c in checks.required if c in missing]
    return counted, follows


def counts(flagged: DataFrame, checks: Checks) -> DataFrame:
    """One row: rows, failures of each rule, repeated keys, filled cells per required column.

    Scorecard, failure rates, top rules and severities all follow from it.
    """
    counted, follows = _count_columns(checks)
    return flagged.selectExpr(*counted).selectExpr("*", *follows)


class Watched:
    """Flagged rows that are counted while something else is written from them.

    ``rows`` passes the flagged rows on; once an action has read all of them without a
    shuffle in between, ``counts`` is the row that the function of that name gives, at
    no further pass. Spark counts each task of that action once, however often it was tried.
    """

    def __init__(self, flagged: DataFrame, checks: Checks):
        self._seen = Observation()
        counted, self._follows = _count_columns(checks)
        self.rows = flagged.observe(self._seen, *[F.expr(c) for c in counted])

    def counts(self) -> DataFrame:
        seen = self._seen.get
        columns = ", ".join(f"{value}L AS `{name}`" for name, value in seen.items())
        return self.rows.sparkSession.sql(f"SELECT {columns}").selectExpr("*", *self._follows)


def failure_rates(counted: DataFrame, checks: Checks) -> DataFrame:
    """Failed records and failure rate of every rule, those that never fired included."""
    per_rule = ", ".join(
        f"""named_struct('column', {quote(rule.column)}, 'rule', {quote(rule.name)},
                         'severity', {quote(rule.severity)}, 'failed_records', failed_{i})"""
        for i, rule in enumerate(checks.rules)
    )
    return counted.selectExpr(
        f"{quote(checks.table)} AS `table`", "`rows`", f"inline(array({per_rule}))"
    ).selectExpr("*", f"{share('failed_records', at_least_one('`rows`'))} AS failure_rate")


def top_rules(rates: DataFrame, count: int = 10) -> DataFrame:
    """Rules with the most violations, from ``failure_rates``; ties by table and rule."""
    sizes = rates.groupBy("table", "rule").agg(F.expr("sum(failed_records) AS size"))
    return sizes.where("size > 0").orderBy(F.desc("size"), "table", "rule").limit(count)


def issues_by_severity(rates: DataFrame) -> DataFrame:
    """Violations per table and severity, from ``failure_rates``, the most severe first."""
    ranks = ", ".join(f"{quote(name)}, {rank}" for name, rank in SEVERITY_RANK.items())
    sizes = (
        rates.where("failed_records > 0")
        .selectExpr("*", f"coalesce(element_at(map({ranks}), severity), 0) AS severity_rank")
        .groupBy("table", "severity", "severity_rank")
        .agg(F.expr("sum(failed_records) AS issues"))
    )
    return sizes.orderBy(F.desc("severity_rank"), "table")


# --- scorecard ---------------------------------------------------------------


def table_summary(counted: DataFrame, checks: Checks) -> DataFrame:
    """One row from ``counts``: size, violations, duplicate share, completeness, score 0-100.

    Rates of a table without rows are null, its score is 100.
    """
    filled = {c: f"completeness_{c}" for c in checks.required}
    rates = counted.selectExpr(
        "`rows`",
        " + ".join(f"failed_{i}" for i in range(len(checks.rules))) + " AS issue_count",
        f"{share('repeated', '`rows`')} AS duplicate_rate",
        *[f"{share(f'filled_{c}', '`rows`')} AS {name}" for c, name in filled.items()],
    ).selectExpr(
        "*",
        f"{share('issue_count', at_least_one('`rows`'))} AS issue_rate",
        f"{mean(list(filled.values()))} AS completeness_overall",
    )
    score = f"""100D - issue_rate * {ISSUE_RATE_PENALTY}D
                - (1D - completeness_overall) * {COMPLETENESS_PENALTY}D
                - duplicate_rate * {DUPLICATE_PENALTY}D"""
    return rates.selectExpr(
        f"{quote(checks.table)} AS `table`",
        "`rows`",
        "issue_count",
        "issue_rate",
        "duplicate_rate",
        "completeness_overall",
        f"{clamp(score, 0.0, 100.0)} AS quality_score",
        *filled.values(),
    )


MEASURES = ["duplicate_rate", "completeness_overall", "quality_score"]

# Sums over summary rows; unlike avg, one null makes the mean null.
POOLED = [
    "sum(`rows`) AS `rows`",
    "sum(issue_count) AS issue_count",
    f"{share('sum(issue_count)', at_least_one('sum(`rows`)'))} AS issue_rate",
    *[f"IF(count({m}) = count(1), sum({m}) / count(1), NULL) AS {m}" for m in MEASURES],
]


def overall(*summaries: DataFrame) -> DataFrame:
    """One OVERALL row: pooled issue rate, plain means of the tables' other measures."""
    pooled = _stacked(summaries).selectExpr(*POOLED)
    return pooled.selectExpr("'OVERALL' AS `table`", "*")


def scorecard(*summaries: DataFrame) -> DataFrame:
    """OVERALL and one row per table; completeness of a column the table lacks is null.

    A rollup over the summary rows, so each table is measured once.
    """
    stacked = _stacked(summaries)
    filled = [c for c in stacked.columns if c.startswith("completeness_") and c not in MEASURES]
    card = stacked.rollup("table").agg(
        F.expr("grouping(`table`) = 1 AS is_total"),
        *[F.expr(sql) for sql in POOLED],
        *[F.expr(f"IF(grouping(`table`) = 0, max({c}), NULL) AS {c}") for c in filled],
    )
    return card.orderBy(F.desc("is_total"), "table").selectExpr(
        "IF(is_total, 'OVERALL', `table`) AS `table`", *[f"`{c}`" for c in stacked.columns[1:]]
    )


def _stacked(summaries: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)

"""Random tables against plain Python, row by row."""

import random
import re
import statistics
from collections import Counter
from datetime import datetime, timedelta

import pytest

from opsmeter.functions.text import EMAIL_SHAPE
from opsmeter.plans import quality, tickets
from tests.test_quality import AS_OF, CUSTOMERS, PAYMENTS, PEOPLE, TRANSACTIONS
from tests.test_tickets import SCHEMA

STAGES = ["intake", "triage", "work", "review"]


def moment(text):
    try:
        return datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None


@pytest.mark.parametrize("seed", [1, 2])
def test_tickets(spark, seed):
    chance = random.Random(seed)

    def row():
        at, times = datetime(2024, 3, 30) + timedelta(hours=chance.randrange(48)), []
        for _ in range(5):
            times.append(str(at))
            at += timedelta(minutes=chance.choice([0, 0, 30, 30, 60, 600, -5]))
        times = [chance.choice([t] * 30 + [None, "?", "??"]) for t in times]
        return (
            chance.choice(["T" + str(chance.randrange(200)), None]),
            *times,
            chance.choice(["Billing", "Access"]),
            chance.choice(["Low", "High", None]),
            "Web",
            "Team-A",
            chance.choice([8, 24, None]),
        )

    data = [row() for _ in range(400)]
    data += chance.choices(data, k=100)
    raw = spark.createDataFrame(data, SCHEMA)

    unique = {(r[0], *map(moment, r[1:6]), *r[6:]) for r in data}
    ids = Counter(r[0] for r in unique)
    valid = [r for r in unique if None not in r[1:6] and list(r[1:6]) == sorted(r[1:6])]
    prepared = tickets.prepare(raw)
    ours = {tuple(r)[:11]: (r.is_duplicate_ticket_id, r.is_valid_timeline) for r in prepared.collect()}
    assert ours == {r: (ids[r[0]] > 1, r in valid) for r in unique}

    def measures(r):
        hours = [(b - a) / timedelta(hours=1) for a, b in zip(r[1:5], r[2:6])]
        cycle = (r[5] - r[1]) / timedelta(hours=1)
        return (cycle, *hours, r[10] is not None and cycle > r[10], STAGES[hours.index(max(hours))])

    clean = tickets.clean(prepared)
    assert {tuple(r)[:11]: tuple(r)[13:] for r in clean.collect()} == {r: measures(r) for r in valid}

    cycles = [measures(r)[0] for r in valid]
    overall = tickets.kpi_overall(tickets.cycle_counts(tickets.deduplicate(raw))).collect()[0]
    assert tuple(overall)[:5] == (500, len(unique), 500 - len(unique), len(valid), len(unique) - len(valid))
    assert overall.avg_cycle_time_hours == pytest.approx(statistics.mean(cycles))
    assert overall.median_cycle_time_hours == pytest.approx(statistics.median(cycles))
    low = [r for r in valid if r[7] == "Low"]
    got = {r.priority: r for r in tickets.kpi_by(tickets.measures(tickets.deduplicate(raw)), "priority").collect()}
    assert set(got) == {"Low", "High"} and got["Low"].tickets == sum(r[0] is not None for r in low)
    assert got["Low"].sla_breach_rate == pytest.approx(statistics.mean(measures(r)[5] for r in low))


def shown(value):
    return "nan" if value is None else str(value)


def blank(value):
    return value is None or value.strip() == ""


@pytest.mark.parametrize("seed", [3, 4])
def test_quality(spark, seed):
    chance = random.Random(seed)
    dates = ["2023-01-01", "2024-01-01", "2024-01-02", "2023-02-30", "", " \t", "soon", None]
    people = [
        (i, chance.choice([f"C{chance.randrange(60)}", None, " "]),
         chance.choice(["a@b.c", "a@b", "x y@b.c", "a@b.c\n", "", " ", None]), chance.choice(dates),
         chance.choice(["US", "GB", "us", "", None]), chance.choice(["Active", "Inactive", "x", None]))
        for i in range(150)
    ]
    payments = [
        (i, chance.choice([f"T{chance.randrange(200)}", None, ""]),
         chance.choice([f"C{chance.randrange(70)}", None, " "]), chance.choice(dates),
         chance.choice(["1.5", "0", "-3.25", "abc", "", "nan", "-inf", None, " 7 "]),
         chance.choice(["USD", "EUR", "usd", None]), chance.choice(["Web", "Store", "Kiosk", None]))
        for i in range(300)
    ]
    log = []

    def note(table, record, column, rule, details):
        log.append((table, shown(record), column, rule, details))

    ids = Counter(r[1] for r in people)
    for i, key, email, signup, country, status in people:
        if blank(key):
            note("customers", f"row_{i}", "customer_id", "not_null", "customer_id is missing")
        if ids[key] > 1:
            note("customers", key, "customer_id", "unique", "duplicate customer_id")
        if blank(email):
            note("customers", key, "email", "not_null", "email is missing")
        elif not re.match(EMAIL_SHAPE, email):
            note("customers", key, "email", "valid_email", f"invalid email: {email}")
        if moment(signup) is None:
            note("customers", key, "signup_date", "valid_date", f"invalid signup_date: {shown(signup)}")
        elif moment(signup) > AS_OF:
            note("customers", key, "signup_date", "not_future", f"future signup_date: {signup}")
        if country not in quality.ALLOWED_COUNTRIES:
            note("customers", key, "country", "allowed_values", f"unexpected country: {shown(country)}")
        if status not in quality.ALLOWED_STATUS:
            note("customers", key, "status", "allowed_values", f"unexpected status: {shown(status)}")
    known = {r[1] for r in people} - {None}
    ids = Counter(r[1] for r in payments)
    numbers = {"1.5": 1.5, "0": 0.0, "-3.25": -3.25, "-inf": float("-inf"), " 7 ": 7.0}
    for i, key, customer, day, amount, currency, channel in payments:
        if blank(key):
            note("transactions", f"row_{i}", "transaction_id", "not_null", "transaction_id is missing")
        if ids[key] > 1:
            note("transactions", key, "transaction_id", "unique", "duplicate transaction_id")
        if blank(customer):
            note("transactions", key, "customer_id", "not_null", "customer_id is missing")
        if customer not in known:
            note("transactions", key, "customer_id", "fk_exists", f"customer_id not found: {shown(customer)}")
        if blank(day):
            note("transactions", key, "transaction_date", "not_null", "transaction_date is missing")
        elif moment(day) is None:
            note("transactions", key, "transaction_date", "valid_date", f"invalid transaction_date: {day}")
        elif moment(day) > AS_OF:
            note("transactions", key, "transaction_date", "not_future", f"future transaction_date: {day}")
        if amount not in numbers:
            note("transactions", key, "amount", "not_null", "amount is missing or non-numeric")
        elif numbers[amount] <= 0:
            note("transactions", key, "amount", "positive", f"non-positive amount: {numbers[amount]}")
        if currency not in quality.ALLOWED_CURRENCY:
            note("transactions", key, "currency", "allowed_values", f"unexpected currency: {shown(currency)}")
        if channel not in quality.ALLOWED_CHANNEL:
            note("transactions", key, "channel", "allowed_values", f"unexpected channel: {shown(channel)}")

    people, payments = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(payments, PAYMENTS)
    one = quality.flag_customers(people), CUSTOMERS
    two = quality.flag_transactions(payments, people), TRANSACTIONS
    ours = quality.combined(quality.issues(*one), quality.issues(*two)).collect()
    assert Counter((r[0], r.record_id, r.column, r.rule, r.details) for r in ours) == Counter(log)
    counted = [(quality.counts(*table), table[1]) for table in (one, two)]
    card = quality.scorecard(*[quality.table_summary(*table) for table in counted]).collect()
    assert card[0].issue_count == len(log)
    rates = quality.combined(*[quality.failure_rates(*table) for table in counted]).collect()
    counts = Counter((table, column, rule) for table, _, column, rule, _ in log)
    assert {(r.table, r.column, r.rule): r.failed_records for r in rates if r.failed_records} == dict(counts)
    status = quality.combined(quality.record_status(*one), quality.record_status(*two))
    assert status.agg({"violations": "sum"}).collect()[0][0] == len(log)

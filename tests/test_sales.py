from decimal import Decimal

import duckdb
import pytest

from opsmeter.operators.staging import stage
from opsmeter.plans import sales
from opsmeter.sources.star import read_star, unreadable_numbers
from testbed import frames
from testbed.oracle import cents, half_up
from tests.conftest import executed_plan

D = Decimal
DDL = {
    "dim_reps": "rep_id STRING, rep_name STRING, region STRING",
    "dim_customers": "customer_id STRING, customer_name STRING, segment STRING, region STRING",
    "dim_products": "product_id STRING, product_name STRING, category STRING, unit_cost DECIMAL(18,2)",
    "fact_orders": """order_id STRING, customer_id STRING, rep_id STRING, order_date STRING,
                      channel STRING, discount_rate DOUBLE""",
    "fact_order_items": """order_item_id STRING, order_id STRING, product_id STRING, quantity INT,
                           unit_price DECIMAL(18,2), unit_cost DECIMAL(18,2)""",
    "fact_returns": "return_id STRING, order_id STRING, return_date STRING, reason STRING",
}
DATA = {
    "dim_reps": [("R1", "Ann", "West"), ("R2", "Bo", None)],
    "dim_customers": [("C1", "One", "SMB", "South"), ("C2", "Two", "SMB", "West"), ("C3", "Three", "SMB", None)],
    "dim_products": [("P1", "Nut", "Hardware", D("1.00")), ("P2", "Bolt", None, D("2.00"))],
    "fact_orders": [
        ("O1", "C1", "R1", "2024-01-05", "Web", 0.1),
        ("O2", "C1", "R2", "2024-01-31", "Web", 0.0),
        ("O3", "C2", "R1", "2024-02-01", None, 0.0),
        ("O4", "C2", "R1", "2024-03-01", "Sales", 0.0),  # no items
        ("O5", "C9", "R1", "2024-02-01", "Web", 0.0),  # unknown customer
        ("O6", "C3", "R9", "2024-02-01", "Web", 0.0),  # unknown rep
        ("O7", "C3", "R1", None, "Web", 0.0),  # no date
        ("O8", "C1", "R1", "2024-02-10", "Web", 0.0),  # the same order twice, for two customers
        ("O8", "C2", "R1", "2024-02-10", "Web", 0.0),
        ("O9", "C1", "R1", "2024-04-01", "Web", 0.0),  # given away
    ],
    "fact_order_items": [
        ("I1", "O1", "P1", 2, D("9562.10"), D("1.00")),
        ("I2", "O1", "P2", 1, D("0.05"), D("2.00")),
        ("I3", "O2", "P1", 3, D("9.99"), D("1.00")),
        ("I4", "O3", "P2", 1, D("19124.19"), D("30000.00")),  # sold at a loss
        ("I5", "O5", "P1", 1, D("1.00"), D("1.00")),
        ("I6", "O6", "P1", 1, D("1.00"), D("1.00")),
        ("I7", "O1", "P9", 1, D("1.00"), D("1.00")),  # unknown product
        ("I8", "O99", "P1", 1, D("1.00"), D("1.00")),  # unknown order
        ("I9", "O7", "P1", 1, D("5.00"), D("1.00")),
        ("I10", "O8", "P1", 1, D("7.00"), D("1.00")),
        ("I11", "O9", "P1", 1, D("0.00"), D("1.00")),
        ("I12", "O2", "P1", None, D("9.99"), D("1.00")),
        ("I13", "O2", None, 1, D("9.99"), D("1.00")),
    ],
    "fact_returns": [
        ("X1", "O1", "2024-02-20", "Damaged"),
        ("X2", "O1", "2024-02-21", "Other"),  # the same order again
        ("X3", "O4", "2024-03-20", "Damaged"),
        ("X4", "O5", "2024-03-20", "Damaged"),  # unknown customer
        ("X5", "O3", "2024-03-20", None),
    ],
}

VIEWS = """
CREATE VIEW o AS SELECT f.*, substr(order_date, 1, 7) AS order_month, c.region AS customer_region,
       r.region AS rep_region
  FROM fact_orders f JOIN dim_customers c USING (customer_id) JOIN dim_reps r USING (rep_id);
CREATE VIEW i AS SELECT o.*, product_id, product_name, category, quantity,
       quantity * unit_price AS revenue, quantity * unit_price - quantity * i.unit_cost AS gross_profit
  FROM fact_order_items i JOIN o USING (order_id) JOIN dim_products p USING (product_id);
CREATE VIEW t AS SELECT t.*, o.* EXCLUDE (order_id) FROM fact_returns t JOIN o USING (order_id);
"""


@pytest.fixture(scope="module")
def star(spark):
    return sales.Star(**{name: spark.createDataFrame(DATA[name], ddl) for name, ddl in DDL.items()})


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name, ddl in DDL.items():
        con.execute(f"CREATE TABLE {name} ({ddl.replace('STRING', 'VARCHAR')})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(DATA[name][0]))})", DATA[name])
    con.execute(VIEWS)
    return con


def check(frame, db, sql):
    key = lambda row: [str(v) for v in row]
    ours = sorted([tuple(r) for r in frame.collect()], key=key)
    theirs = sorted(db.execute(sql).fetchall(), key=key)
    assert [r[0] for r in ours] == [r[0] for r in theirs]
    for one, two in zip(ours, theirs):
        assert list(one) == [pytest.approx(v) if isinstance(v, float) else v for v in two]


MARGIN = half_up(cents("sum(gross_profit)"), cents("sum(revenue)"), 4)
SUMS = f"""sum(revenue)::DOUBLE, sum(gross_profit)::DOUBLE,
           CASE WHEN sum(revenue) = 0 THEN 0 ELSE {MARGIN} END"""
AOV = half_up(cents("sum(revenue)"), "count(DISTINCT order_id) * 100", 2)


def test_monthly(star, db):
    monthly = sales.kpi_monthly(sales.order_sales(star), sales.returns_enriched(star))
    check(
        monthly,
        db,
        f"""SELECT m.*, coalesce(n, 0), round(coalesce(n, 0)::DOUBLE / orders, 4)
            FROM (SELECT order_month, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id),
                         {SUMS}, {AOV}
                  FROM i GROUP BY 1) m
            LEFT JOIN (SELECT order_month, count(DISTINCT order_id) AS n FROM t GROUP BY 1) r
              ON r.order_month = m.order_month""",
    )
    rows = {r.order_month: r for r in monthly.collect()}
    assert rows["2024-02"].orders == 2 and rows["2024-02"].customers == 2
    assert rows["2024-04"].gross_margin_rate == 0.0  # no revenue


def test_by_region_and_channel(star, db):
    per_order = sales.order_sales(star)
    for key, frame in [("rep_region", sales.kpi_by_region(per_order)), ("channel", sales.kpi_by_channel(per_order))]:
        check(
            frame,
            db,
            f"""SELECT {key}, count(DISTINCT order_id), {SUMS},
                       {AOV}
                FROM i GROUP BY 1""",
        )
    assert sales.kpi_by_region(per_order).columns[0] == "region"


def test_average_order_value_rounds_half_up(spark, star):
    two = spark.createDataFrame(
        [("I1", "O1", "P1", 1, D("9562.10"), D("0.00")), ("I2", "O2", "P1", 1, D("9562.09"), D("0.00"))],
        DDL["fact_order_items"],
    )
    only = sales.Star(**{**star.__dict__, "fact_order_items": two})
    assert sales.kpi_by_channel(sales.order_sales(only)).collect()[0].aov == 9562.1


def test_top_products(star, db):
    check(
        sales.kpi_top_products(star),
        db,
        f"""SELECT product_id, product_name, category, sum(quantity)::BIGINT, {SUMS}
            FROM i GROUP BY 1, 2, 3 ORDER BY sum(revenue) DESC, 1 LIMIT 25""",
    )
    best = sales.kpi_top_products(star, count=1).collect()
    assert [r.product_id for r in best] == ["P1"] and len(sales.best_products(sales.kpi_top_products(star), 1).collect()) == 1


def test_product_listed_twice_counts_twice(spark, star):
    """An inner join repeats the items of a product that the dimension holds twice."""
    twice = star.dim_products.union(star.dim_products.where("product_id = 'P1'"))
    double = sales.Star(**{**star.__dict__, "dim_products": twice})
    units = {r.product_id: r.units for r in sales.kpi_top_products(star).collect()}
    assert {r.product_id: r.units for r in sales.kpi_top_products(double).collect()} == {
        "P1": 2 * units["P1"],
        "P2": units["P2"],
    }
    revenue = sum(r.revenue for r in sales.kpi_by_channel(sales.order_sales(double)).collect())
    items = sum(r.revenue for r in sales.order_items_enriched(double).collect() if r.revenue)
    assert revenue == pytest.approx(float(items))


def test_returns(star, db):
    returns = sales.returns_enriched(star)
    check(sales.kpi_returns_by_reason(returns), db, "SELECT reason, count(*) FROM t GROUP BY 1")
    check(
        sales.kpi_returns_by_channel(sales.orders_enriched(star), returns),
        db,
        """SELECT a.*, coalesce(n, 0), round(coalesce(n, 0)::DOUBLE / orders, 4)
           FROM (SELECT order_month, channel, count(DISTINCT order_id) AS orders FROM o GROUP BY 1, 2) a
           LEFT JOIN (SELECT order_month, channel, count(DISTINCT order_id) AS n FROM t GROUP BY 1, 2) b
             ON a.order_month = b.order_month AND a.channel = b.channel""",
    )
    months = {(r.order_id, r.order_month, r.return_month) for r in returns.collect()}
    assert ("O1", "2024-01", "2024-02") in months


def test_cohorts(star, db):
    first = "SELECT customer_id, min(order_month) AS first FROM o GROUP BY 1"
    for orders in (sales.orders_enriched(star), sales.customer_months(star)):
        check(sales.customer_first_order(orders), db, first)
        check(
            sales.customer_cohorts(orders),
            db,
            f"""WITH f AS ({first}), a AS (SELECT first, order_month, count(DISTINCT customer_id) AS n
                                          FROM o JOIN f USING (customer_id) GROUP BY 1, 2),
                     s AS (SELECT first, max(n) AS size FROM a GROUP BY 1)
                SELECT a.first, order_month, size, n, round(n::DOUBLE / size, 4)
                FROM a JOIN s ON s.first = a.first""",
        )


def test_sanity_checks(star):
    assert dict(map(tuple, sales.schema_row_counts(star).collect())) == {n: len(v) for n, v in DATA.items()}
    assert tuple(sales.order_date_range(star).collect()[0]) == ("2024-01-05", "2024-04-01")
    assert tuple(sales.order_null_audit(star).collect()[0]) == (0, 0, 1)


def test_empty_star(spark):
    empty = sales.Star(**{name: spark.createDataFrame([], ddl) for name, ddl in DDL.items()})
    per_order, returns = sales.order_sales(empty), sales.returns_enriched(empty)
    orders = sales.orders_enriched(empty)
    for frame in [
        sales.kpi_monthly(per_order, returns),
        sales.kpi_by_region(per_order),
        sales.kpi_top_products(empty),
        sales.kpi_returns_by_channel(orders, returns),
        sales.customer_cohorts(orders),
    ]:
        assert frame.collect() == []
    assert tuple(sales.order_null_audit(empty).collect()[0]) == (None, None, None)


# --- roll-ups that must agree -------------------------------------------------


@pytest.fixture(scope="module")
def fixture_star(spark, folder):
    return frames.star(spark, folder)


def test_roll_ups_agree(fixture_star):
    per_order, returns = sales.order_sales(fixture_star), sales.returns_enriched(fixture_star)
    orders = sales.orders_enriched(fixture_star)
    monthly = sales.kpi_monthly(per_order, returns).collect()
    by_channel = sales.kpi_by_channel(per_order).collect()
    by_region = sales.kpi_by_region(per_order).collect()
    totals = {
        (sum(r.orders for r in kpi), round(sum(r.revenue for r in kpi), 2), round(sum(r.gross_profit for r in kpi), 2))
        for kpi in (monthly, by_channel, by_region)
    }
    assert len(totals) == 1 and totals.pop()[:2] == (1305, 13288905.25)
    placed = sales.kpi_returns_by_channel(orders, returns).collect()
    assert sum(r.returned_orders for r in placed) == sum(r.returns for r in sales.kpi_returns_by_reason(returns).collect())
    cohorts = sales.customer_cohorts(orders).collect()
    start = [r for r in cohorts if r.cohort_month == r.activity_month]
    assert all(r.active_customers == r.cohort_customers and r.retention_rate == 1.0 for r in start)
    assert sum(r.cohort_customers for r in start) == orders.select("customer_id").distinct().count()


# --- plans ---------------------------------------------------------------------


def test_items_are_summed_before_the_order_join(fixture_star):
    """One shuffle by order for the items, none for grouping per order afterwards."""
    plan = sales.kpi_by_channel(sales.order_sales(fixture_star))._jdf.queryExecution().sparkPlan().toString()
    join = plan.index("order_id", plan.index("Join"))
    assert "partial_sum(revenue" in plan[join:] and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_read_needed_columns_only(fixture_star):
    plan = executed_plan(sales.kpi_by_channel(sales.order_sales(fixture_star)))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line]
    assert scans and all("l_extendedprice" not in line.split("ReadSchema")[1] for line in scans)


def test_unique_orders_give_the_same(fixture_star):
    returns = sales.returns_enriched(fixture_star)
    by_flag = []
    for unique in (False, True):
        per_order = sales.order_sales(fixture_star, unique_orders=unique)
        by_flag.append([
            sorted(map(str, kpi.collect()))
            for kpi in (sales.kpi_monthly(per_order, returns, unique), sales.kpi_by_region(per_order, unique),
                        sales.kpi_by_channel(per_order, unique))
        ])
    assert by_flag[0] == by_flag[1]


def test_copies_of_an_order_collapse_before_the_join(spark, star):
    copies = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 'O1', concat('O', id)) AS order_id", "'C1' AS customer_id", "'R1' AS rep_id",
        "'2024-01-05' AS order_date", "'Web' AS channel", "0.1D AS discount_rate",
    )
    hot = sales.Star(**{**star.__dict__, "fact_orders": copies})
    per_order = sales.order_sales(hot)
    stored = sales.order_sales(hot, sales.orders_enriched(hot))
    assert sorted(map(str, stored.collect())) == sorted(map(str, per_order.collect()))
    assert per_order.where("order_id = 'O1'").count() == 1
    brute = sales.order_items_enriched(hot).agg({"revenue": "sum"}).collect()[0][0]
    kpi = sales.kpi_by_channel(per_order).collect()[0]
    assert kpi.revenue == float(brute) and kpi.orders == 5  # O1, O2, O5, O7 and O8 have items
    monthly = sales.kpi_monthly(per_order, sales.returns_enriched(hot)).collect()[0]
    assert (monthly.orders, monthly.customers, monthly.revenue) == (kpi.orders, 1, kpi.revenue)


def test_hot_order_and_product(spark, star):
    """A third of the items belong to one order, another third are one product."""
    items = spark.range(30_000).selectExpr(
        "CAST(id AS STRING) AS order_item_id",
        "IF(id % 3 = 0, 'O1', concat('O', id % 5)) AS order_id",
        "IF(id % 3 = 1, 'P1', 'P2') AS product_id",
        "1 AS quantity", "CAST(2 AS DECIMAL(18,2)) AS unit_price", "CAST(1 AS DECIMAL(18,2)) AS unit_cost",
    )
    hot = sales.Star(**{**star.__dict__, "fact_order_items": items})
    brute = sales.order_items_enriched(hot).groupBy("channel").agg({"revenue": "sum"}).collect()
    ours = sales.kpi_by_channel(sales.order_sales(hot)).collect()
    assert {r.channel: r.revenue for r in ours} == {r[0]: float(r[1]) for r in brute}


def test_monthly_kpis_do_not_copy_rows(fixture_star):
    """No Expand for two distinct counts, and sales move once after they met their orders."""
    kpi = sales.kpi_monthly(sales.order_sales(fixture_star), sales.returns_enriched(fixture_star))
    for frame in (kpi, sales.latest_months(kpi)):
        assert "Expand" not in frame._jdf.queryExecution().sparkPlan().toString()
    per_order = sales.order_sales(fixture_star)
    marked = sales.kpi_monthly(per_order, fixture_star.fact_returns.limit(0).selectExpr(
        "order_id", "return_date AS order_month"))
    window = marked._jdf.queryExecution().executedPlan().toString()
    below = window[window.index("Window") :].splitlines()
    assert not any("Exchange" in line for line in below[:3]), below[:3]


def test_unique_orders_are_counted_in_place(fixture_star):
    orders, returns = sales.orders_enriched(fixture_star), sales.returns_enriched(fixture_star)
    once = sales.kpi_returns_by_channel(orders, returns, unique_orders=True)
    assert once.collect() == sales.kpi_returns_by_channel(orders, returns).collect()


def test_items_stay_in_place_for_the_best_products(fixture_star):
    """Items are weighed by the odd orders; only sums per product are shuffled."""
    odd = stage(sales.odd_orders(fixture_star, sales.orders_enriched(fixture_star)))
    plan = executed_plan(sales.kpi_top_products(fixture_star, odd=odd)).split("Initial Plan")[0]
    assert sales.kpi_top_products(fixture_star, odd=odd).collect() == sales.kpi_top_products(fixture_star).collect()
    assert "hashpartitioning(order_id" not in plan


def test_digits_of_the_input_count(spark, tmp_path):
    """Prices of three decimals and broken quantities are rounded after multiplying only."""
    for name, ddl in DDL.items():
        columns = [c.split()[0] for c in ddl.replace("DECIMAL(18,2)", "D").split(",")]
        rows = [tuple(r) for r in DATA[name]]
        if name == "fact_order_items":
            at = {c: i for i, c in enumerate(columns)}
            first = list(rows[0])
            first[at["quantity"]], first[at["unit_price"]], first[at["unit_cost"]] = "2.7", "1.005", "n/k"
            rows = [tuple(first)]
        frame = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows],
                                      ", ".join(f"{c} STRING" for c in columns))
        frame.write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    star = read_star(spark, str(tmp_path), "csv")
    row = sales.order_items_enriched(star).collect()
    assert [(str(r.revenue), r.cost) for r in row] == [("2.71", None)]  # 2.7135, not 2 * 1.01
    bad = {tuple(r)[:2]: r.rows for r in unreadable_numbers(spark, str(tmp_path), "csv").collect()}
    assert bad["fact_order_items", "unit_cost"] == 1 and sum(bad.values()) == 1

"""Sales reporting over a star schema: enriched views, KPI tables, cohorts.

Dimension joins are inner joins, so facts with an unknown customer, rep, product
or order drop out. Spark broadcasts a dimension while it is small and sort-merges
it otherwise. Item-level KPIs sum the items of an order before the order joins,
which shuffles one row per order instead of one per item.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmeter.functions.numbers import rounded_rate, rounded_ratio
from opsmeter.functions.times import month_key
from opsmeter.operators.keys import irregular_matches

TOP_PRODUCTS = 25


@dataclass(frozen=True)
class Star:
    """The six base tables."""

    dim_customers: DataFrame
    dim_products: DataFrame
    dim_reps: DataFrame
    fact_orders: DataFrame
    fact_order_items: DataFrame
    fact_returns: DataFrame


# Line values, each rounded half up on its own before any sum (by the cast).
LINE_VALUES = {
    "revenue": "CAST(quantity * unit_price AS DECIMAL(18,2))",
    "cost": "CAST(quantity * unit_cost AS DECIMAL(18,2))",
    "gross_profit": "CAST(quantity * unit_price - quantity * unit_cost AS DECIMAL(18,2))",
}

# The KPIs sum whole cents: exact in any order, and much cheaper than decimals.
LINE_CENTS = {f"{name}_cents": f"CAST({v} * 100 AS BIGINT)" for name, v in LINE_VALUES.items()}
MONEY = ["revenue_cents / 100D AS revenue", "gross_profit_cents / 100D AS gross_profit"]
MARGIN = f"{rounded_rate('gross_profit_cents', 'revenue_cents', 4)} AS gross_margin_rate"
RETURN_RATE = f"{rounded_rate('returned_orders', 'orders', 4)} AS return_rate"


# --- enriched views ---------------------------------------------------------


def _orders_with_rep(star: Star) -> DataFrame:
    reps = star.dim_reps.selectExpr("rep_id", "rep_name", "region AS rep_region")
    orders = star.fact_orders.join(reps, "rep_id")
    return orders.selectExpr("*", f"{month_key('order_date')} AS order_month")


def orders_enriched(star: Star) -> DataFrame:
    """One row per order with its customer and rep."""
    customers = star.dim_customers.selectExpr(
        "customer_id", "customer_name", "segment", "region AS customer_region"
    )
    return (
        _orders_with_rep(star)
        .join(customers, "customer_id")
        .selectExpr(
            "order_id",
            "order_date",
            "order_month",
            "channel",
            "discount_rate",
            "customer_id",
            "customer_name",
            "segment",
            "customer_region",
            "rep_id",
            "rep_name",
            "rep_region",
        )
    )


def order_items_enriched(star: Star, orders: DataFrame | None = None) -> DataFrame:
    """One row per item with its order, customer, rep and product.

    ``orders`` may hand in a stored copy of ``orders_enriched``.
    """
    orders = orders if orders is not None else orders_enriched(star)
    return (
        star.fact_order_items.join(
            star.dim_products.select("product_id", "product_name", "category"), "product_id"
        )
        .join(orders, "order_id")
        .selectExpr(
            "order_item_id",
            *orders.columns,
            "product_id",
            "product_name",
            "category",
            "quantity",
            "unit_price",
            "unit_cost",
            *[f"{value} AS {name}" for name, value in LINE_VALUES.items()],
        )
    )


def returns_enriched(star: Star, orders: DataFrame | None = None) -> DataFrame:
    """One row per return with its order, customer and rep."""
    orders = orders if orders is not None else orders_enriched(star)
    return star.fact_returns.join(orders, "order_id").selectExpr(
        "return_id",
        "order_id",
        "return_date",
        f"{month_key('return_date')} AS return_month",
        "reason",
        "order_date",
        "order_month",
        "channel",
        "customer_id",
        "segment",
        "customer_region",
        "rep_id",
        "rep_region",
    )


# --- KPI tables -------------------------------------------------------------


def odd_products(star: Star) -> DataFrame:
    """Products of items that the dimension lacks or lists several times; few, worth storing."""
    items = star.fact_order_items.where("product_id IS NOT NULL")
    return irregular_matches(items, "product_id", star.dim_products)


def odd_orders(star: Star, orders: DataFrame) -> DataFrame:
    """Orders of items that ``orders_enriched`` lacks or has several times; few, worth storing."""
    return irregular_matches(star.fact_order_items, "order_id", orders)


def _weighed(items: DataFrame, key: str, odd: DataFrame, values: dict[str, str], *keep: str) -> DataFrame:
    """The items as an inner join by ``key`` leaves them, without the join's other columns.

    An item without match drops out, one with n matches counts n times. Spark broadcasts the
    odd keys while they are few, so the items stay in place however many keys there are.
    """
    weighed = [f"{value} * coalesce(matches, 1) AS {name}" for name, value in values.items()]
    return (
        items.where(f"{key} IS NOT NULL")
        .join(odd, F.expr(f"{key} = odd_key"), "left")
        .where("coalesce(matches, 1) > 0")
        .selectExpr(*keep, *weighed)
    )


def order_sales(
    star: Star,
    orders: DataFrame | None = None,
    unique_orders: bool = False,
    odd: DataFrame | None = None,
) -> DataFrame:
    """Sales per order: month, channel, customer, rep region and the summed cents.

    Orders without items, and items without product, are absent. The rows are left
    hash-partitioned by ``order_id``. ``odd`` may hand in the stored ``odd_products``.

    ``unique_orders`` states that no order id occurs twice among the orders. Otherwise
    copies of an order are collapsed first, so that they never meet in one task.
    """
    header = ["order_id", "order_month", "channel", "customer_id", "rep_region"]
    headers = (orders if orders is not None else _orders_with_rep(star)).select(*header)
    cents = list(LINE_CENTS)
    if not unique_orders:
        headers = headers.groupBy(*header).agg(F.expr("count(1) AS copies"))
        cents = [f"{name} * copies AS {name}" for name in LINE_CENTS]
    if orders is None:
        headers = headers.join(star.dim_customers.select("customer_id"), "customer_id")
    odd = odd if odd is not None else odd_products(star)
    items = _weighed(star.fact_order_items, "product_id", odd, LINE_CENTS, "order_id")
    per_order = items.groupBy("order_id").agg(*_sums(*LINE_CENTS))
    return per_order.join(headers, "order_id").selectExpr(*header, *cents)


SUMMED = ["revenue_cents", "gross_profit_cents"]


def _sums(*names: str) -> list[Column]:
    return [F.expr(f"sum({name}) AS {name}") for name in names]


def returned_orders(returns: DataFrame, *keys: str) -> DataFrame:
    """Distinct returned orders per key (``returns_enriched`` columns)."""
    return returns.groupBy(*keys).agg(F.expr("count(DISTINCT order_id) AS returned"))


def _with_returns(kpi: DataFrame, returns: DataFrame, *keys: str) -> DataFrame:
    joined = kpi.join(returned_orders(returns, *keys), list(keys), "left")
    return joined.selectExpr(*kpi.columns, "coalesce(returned, 0) AS returned_orders")


def _order_count(unique_orders: bool) -> Column:
    return F.expr("count(1) AS orders" if unique_orders else "count(DISTINCT order_id) AS orders")


def kpi_monthly(sales: DataFrame, returns: DataFrame, unique_orders: bool = False) -> DataFrame:
    """Orders, customers, money and returns per order month.

    ``sales`` is ``order_sales``, ``returns`` is ``returns_enriched``. Two distinct counts
    would make Spark copy every row. Here an order counts with its first row of a month, which
    is found where ``order_sales`` left the rows, by order; then the orders move once,
    to one row per customer and month. ``unique_orders`` as there: every row is a first one.
    """
    first = "1"
    if not unique_orders:
        first = "IF(row_number() OVER (PARTITION BY order_id, order_month ORDER BY order_id) = 1, 1, 0)"
    marked = sales.selectExpr("order_month", "customer_id", f"{first} AS first_row", *SUMMED)
    per_customer = marked.groupBy("order_month", "customer_id").agg(*_sums("first_row", *SUMMED))
    months = per_customer.groupBy("order_month").agg(
        F.expr("sum(first_row) AS orders"), F.expr("count(customer_id) AS customers"), *_sums(*SUMMED)
    )
    return _with_returns(months, returns, "order_month").selectExpr(
        "order_month",
        "orders",
        "customers",
        *MONEY,
        MARGIN,
        f"{rounded_rate('revenue_cents', '(orders * 100)', 2)} AS aov",
        "returned_orders",
        RETURN_RATE,
    )


def _kpi_by(sales: DataFrame, key: str, unique_orders: bool) -> DataFrame:
    return (
        sales.groupBy(key)
        .agg(_order_count(unique_orders), *_sums(*SUMMED))
        .selectExpr(
            key,
            "orders",
            *MONEY,
            MARGIN,
            f"{rounded_ratio('revenue_cents', '(orders * 100)', 2)} AS aov",
        )
    )


def kpi_by_region(sales: DataFrame, unique_orders: bool = False) -> DataFrame:
    """Sales per region of the rep."""
    return _kpi_by(sales, "rep_region", unique_orders).withColumnRenamed("rep_region", "region")


def kpi_by_channel(sales: DataFrame, unique_orders: bool = False) -> DataFrame:
    return _kpi_by(sales, "channel", unique_orders)


def kpi_top_products(
    star: Star, orders: DataFrame | None = None, count: int = TOP_PRODUCTS, odd: DataFrame | None = None
) -> DataFrame:
    """Products with the most revenue; ties by product id.

    Items are weighed by the few odd orders, not shuffled to meet the orders, and summed per
    product in place first, so a best seller never meets the product join as more than
    one row. ``odd`` may hand in the stored ``odd_orders``.
    """
    if odd is None:
        odd = odd_orders(star, orders if orders is not None else orders_enriched(star))
    values = {"units": "quantity", **{name: LINE_CENTS[name] for name in SUMMED}}
    items = _weighed(star.fact_order_items, "order_id", odd, values, "product_id")
    per_product = items.groupBy("product_id").agg(*_sums("units", *SUMMED))
    names = star.dim_products.select("product_id", "product_name", "category")
    return (
        per_product.join(names, "product_id")
        .groupBy("product_id", "product_name", "category")
        .agg(*_sums("units", *SUMMED))
        .orderBy(F.desc("revenue_cents"), "product_id", "product_name", "category")
        .limit(count)
        .selectExpr("product_id", "product_name", "category", "units", *MONEY, MARGIN)
    )


def kpi_returns_by_reason(returns: DataFrame) -> DataFrame:
    counts = returns.groupBy("reason").agg(F.expr("count(1) AS returns"))
    return counts.orderBy(F.desc("returns"), "reason")


def kpi_returns_by_channel(
    orders: DataFrame, returns: DataFrame, unique_orders: bool = False
) -> DataFrame:
    """Orders, returned orders and return rate per order month and channel.

    With ``unique_orders`` the orders are counted where they are; else their ids move once.
    """
    counted = "count(order_id)" if unique_orders else "count(DISTINCT order_id)"
    placed = orders.groupBy("order_month", "channel").agg(F.expr(f"{counted} AS orders"))
    return (
        _with_returns(placed, returns, "order_month", "channel")
        .selectExpr("*", RETURN_RATE)
        .orderBy("order_month", "channel")
    )


# --- cohorts ----------------------------------------------------------------


def customer_months(star: Star) -> DataFrame:
    """The months in which each customer ordered: ``customer_id``, ``order_month``.

    Distinct before the customers join, so a customer with a large share of the orders
    meets it as one row per month. ``orders_enriched`` serves the cohorts as well.
    """
    active = _orders_with_rep(star).select("customer_id", "order_month").distinct()
    return active.join(star.dim_customers.select("customer_id"), "customer_id", "left_semi")


def customer_first_order(orders: DataFrame) -> DataFrame:
    """First order month per customer, from ``customer_months`` or ``orders_enriched``."""
    return orders.groupBy("customer_id").agg(F.expr("min(order_month) AS first_order_month"))


def customer_cohorts(orders: DataFrame) -> DataFrame:
    """Active customers per first-order month and activity month, with the retention rate."""
    # distinct first: a customer then has one row per month, however many orders
    activity = (
        orders.select("customer_id", "order_month")
        .distinct()
        .selectExpr(
            "order_month AS activity_month",
            "min(order_month) OVER (PARTITION BY customer_id) AS cohort_month",
        )
        .where("cohort_month IS NOT NULL")
        .groupBy("cohort_month", "activity_month")
        .agg(F.expr("count(1) AS active_customers"))
    )
    return (
        activity.selectExpr(
            "cohort_month",
            "activity_month",
            "max(active_customers) OVER (PARTITION BY cohort_month) AS cohort_customers",
            "active_customers",
        )
        .selectExpr(
            "*", f"{rounded_ratio('active_customers', 'cohort_customers', 4)} AS retention_rate"
        )
        .orderBy("cohort_month", "activity_month")
    )


# --- sanity checks and extracts ---------------------------------------------


def schema_row_counts(star: Star) -> DataFrame:
    """Rows per base table."""
    names = [
        "dim_customers",
        "dim_products",
        "dim_reps",
        "fact_orders",
        "fact_order_items",
        "fact_returns",
    ]
    return reduce(
        DataFrame.unionByName,
        [getattr(star, name).selectExpr(f"'{name}' AS table_name", "count(1) AS `rows`") for name in names],
    )


def order_date_range(star: Star) -> DataFrame:
    return star.fact_orders.agg(
        F.expr("min(order_date) AS min_order_date"), F.expr("max(order_date) AS max_order_date")
    )


def order_null_audit(star: Star) -> DataFrame:
    """Null counts of the order keys; a null count for a table without rows."""
    columns = ["order_id", "customer_id", "order_date"]
    return star.fact_orders.agg(
        *[F.expr(f"sum(CAST({c} IS NULL AS INT)) AS null_{c}") for c in columns]
    )


def latest_months(monthly: DataFrame, count: int = 6) -> DataFrame:
    return monthly.orderBy(F.desc("order_month")).limit(count)


def regions_by_revenue(by_region: DataFrame) -> DataFrame:
    return by_region.orderBy(F.desc("revenue"), "region")


def best_products(top_products: DataFrame, count: int = 10) -> DataFrame:
    return top_products.orderBy(F.desc("revenue"), "product_id").limit(count)

"""SQL for DuckDB: the derived inputs as CTEs and the expected result of every query.

Written apart from the Spark jobs: plain aggregates, distinct counts and window
counts over the whole derived tables. Rounded figures use whole-number arithmetic,
because DuckDB rounds binary doubles.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"

CTES = {
    "fx_tickets_once": """
        SELECT k,
               'T' || (CASE WHEN k % 50 = 7 THEN k - 7 ELSE k END) AS ticket_id,
               created_at,
               CASE WHEN k % 97 = 0 THEN NULL ELSE created_at + to_minutes(k * 13 % 180) END
                   AS intake_at,
               triage_at,
               triage_at + to_minutes(k * 11 % 1440) AS work_at,
               triage_at + to_minutes(k * 11 % 1440)
                   + to_minutes(CASE WHEN k % 89 = 0 THEN -3000 ELSE k * 17 % 480 END)
                   AS resolved_at,
               c_mktsegment AS category,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
                    WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS priority,
               CASE k % 4 WHEN 0 THEN 'Email' WHEN 1 THEN 'Web' WHEN 2 THEN 'Phone'
                    ELSE 'Chat' END AS channel,
               'Team-' || CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C'
                               ELSE 'D' END AS owner_team,
               CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 24
                    WHEN '3-MEDIUM' THEN 48 WHEN '5-LOW' THEN 72 END AS sla_target_hours
        FROM (SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderpriority, c.c_mktsegment,
                     o.o_orderdate + to_minutes(o.o_orderkey * 37 % 1440) AS created_at,
                     o.o_orderdate + to_minutes(o.o_orderkey * 37 % 1440)
                         + to_minutes(o.o_orderkey * 13 % 180 + o.o_orderkey * 7 % 360)
                         AS triage_at
              FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)""",
    "fx_tickets": """
        SELECT * EXCLUDE (k) FROM fx_tickets_once
        UNION ALL
        SELECT * EXCLUDE (k) FROM fx_tickets_once WHERE k % 101 = 0""",
    "deduplicated": "SELECT DISTINCT * FROM fx_tickets",
    "prepared": """
        SELECT *,
               count(*) OVER (PARTITION BY ticket_id) > 1 AS is_duplicate_ticket_id,
               coalesce(created_at <= intake_at AND intake_at <= triage_at
                        AND triage_at <= work_at AND work_at <= resolved_at, false)
                   AS is_valid_timeline
        FROM deduplicated""",
    "stage_times": """
        SELECT *,
               epoch_us(resolved_at) - epoch_us(created_at) AS cycle_us,
               epoch_us(intake_at) - epoch_us(created_at) AS intake_us,
               epoch_us(triage_at) - epoch_us(intake_at) AS triage_us,
               epoch_us(work_at) - epoch_us(triage_at) AS work_us,
               epoch_us(resolved_at) - epoch_us(work_at) AS review_us
        FROM prepared WHERE is_valid_timeline""",
    "measured": """
        SELECT *,
               coalesce(cycle_us > sla_target_hours * 3600000000, false) AS sla_breached,
               CASE WHEN intake_us >= greatest(triage_us, work_us, review_us) THEN 'intake'
                    WHEN triage_us >= greatest(work_us, review_us) THEN 'triage'
                    WHEN work_us >= review_us THEN 'work'
                    ELSE 'review' END AS bottleneck_stage
        FROM stage_times""",
    "fx_customers_raw": """
        SELECT c AS row_id,
               CASE WHEN c % 211 = 3 THEN NULL WHEN c % 50 = 9 THEN 'C' || (c - 1)
                    ELSE 'C' || c END AS customer_id,
               CASE WHEN c % 33 = 1 THEN NULL WHEN c % 71 = 2 THEN '  '
                    WHEN c % 50 = 3 THEN 'not-an-email'
                    ELSE 'user' || c || '@example.com' END AS email,
               CASE WHEN c % 90 = 4 THEN NULL WHEN c % 90 = 5 THEN '2001-02-30'
                    WHEN c % 100 = 6 THEN '2002-01-11'
                    ELSE '200' || (c % 2) || '-0' || (c % 9 + 1) || '-1' || (c % 10) END
                   AS signup_date,
               CASE WHEN c % 120 = 8 THEN NULL WHEN c % 100 = 7 THEN 'XX'
                    ELSE CASE c_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'MX'
                              WHEN 3 THEN 'GB' WHEN 4 THEN 'DE' ELSE 'IN' END END AS country,
               CASE WHEN c % 150 = 10 THEN 'Paused' WHEN c % 7 = 0 THEN 'Inactive'
                    ELSE 'Active' END AS status
        FROM (SELECT c_custkey AS c, c_nationkey FROM customer)""",
    "fx_transactions_raw": """
        SELECT k AS row_id,
               CASE WHEN k % 401 = 5 THEN NULL WHEN k % 100 = 9 THEN 'T' || (k - 1)
                    ELSE 'T' || k END AS transaction_id,
               CASE WHEN k % 301 = 6 THEN NULL WHEN k % 67 = 2 THEN 'C999999999'
                    ELSE 'C' || o_custkey END AS customer_id,
               CASE WHEN k % 200 = 3 THEN NULL WHEN k % 500 = 4 THEN 'not-a-date'
                    WHEN k % 100 = 5 THEN '2002-01-08'
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS transaction_date,
               CASE WHEN k % 250 = 1 THEN NULL WHEN k % 250 = 2 THEN 'abc'
                    WHEN k % 50 = 6 THEN '-' || (k % 900 + 1) || '.5'
                    WHEN k % 100 = 8 THEN '0' ELSE (k % 900 + 1) || '.25' END AS amount_text,
               CASE WHEN k % 100 = 11 THEN 'XXX'
                    ELSE CASE k % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CAD' WHEN 2 THEN 'GBP'
                              ELSE 'EUR' END END AS currency,
               CASE WHEN k % 100 = 12 THEN 'Kiosk'
                    ELSE CASE k % 4 WHEN 0 THEN 'Web' WHEN 1 THEN 'Mobile' WHEN 2 THEN 'Store'
                              ELSE 'Partner' END END AS channel
        FROM (SELECT o_orderkey AS k, o_custkey, o_orderdate FROM orders)""",
    "customers_typed": """
        SELECT *, TRY_CAST(signup_date AS TIMESTAMP) AS signup_at,
               count(*) OVER (PARTITION BY customer_id) > 1 AS repeated
        FROM fx_customers_raw""",
    "transactions_typed": """
        SELECT *, TRY_CAST(transaction_date AS TIMESTAMP) AS transaction_at,
               TRY_CAST(amount_text AS DOUBLE) AS amount,
               count(*) OVER (PARTITION BY transaction_id) > 1 AS repeated
        FROM fx_transactions_raw""",
    "dq_customers": f"""
        SELECT 'row_' || row_id AS record_id, row_id, 'customer_id' AS "column",
               'not_null' AS rule, 'high' AS severity, 'customer_id is missing' AS details
        FROM customers_typed WHERE customer_id IS NULL OR trim(customer_id) = ''
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'customer_id', 'unique', 'high',
               'duplicate customer_id'
        FROM customers_typed WHERE repeated
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'email', 'not_null', 'medium',
               'email is missing'
        FROM customers_typed WHERE email IS NULL OR trim(email) = ''
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'email', 'valid_email', 'medium',
               'invalid email: ' || email
        FROM customers_typed
        WHERE trim(email) <> '' AND NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'signup_date', 'valid_date', 'high',
               'invalid signup_date: ' || coalesce(signup_date, 'nan')
        FROM customers_typed WHERE signup_at IS NULL
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'signup_date', 'not_future', 'medium',
               'future signup_date: ' || signup_date
        FROM customers_typed WHERE signup_at > {AS_OF}
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'country', 'allowed_values', 'low',
               'unexpected country: ' || coalesce(country, 'nan')
        FROM customers_typed
        WHERE country IS NULL OR country NOT IN ('US', 'CA', 'MX', 'GB', 'DE', 'IN')
        UNION ALL
        SELECT coalesce(customer_id, 'nan'), row_id, 'status', 'allowed_values', 'low',
               'unexpected status: ' || coalesce(status, 'nan')
        FROM customers_typed WHERE status IS NULL OR status NOT IN ('Active', 'Inactive')""",
    "dq_transactions": f"""
        SELECT 'row_' || row_id AS record_id, row_id, 'transaction_id' AS "column",
               'not_null' AS rule, 'high' AS severity, 'transaction_id is missing' AS details
        FROM transactions_typed WHERE transaction_id IS NULL OR trim(transaction_id) = ''
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'transaction_id', 'unique', 'high',
               'duplicate transaction_id'
        FROM transactions_typed WHERE repeated
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'customer_id', 'not_null', 'high',
               'customer_id is missing'
        FROM transactions_typed WHERE customer_id IS NULL OR trim(customer_id) = ''
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'customer_id', 'fk_exists', 'high',
               'customer_id not found: ' || coalesce(customer_id, 'nan')
        FROM transactions_typed t
        WHERE NOT EXISTS (SELECT 1 FROM fx_customers_raw c WHERE c.customer_id = t.customer_id)
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'transaction_date', 'not_null', 'high',
               'transaction_date is missing'
        FROM transactions_typed WHERE transaction_date IS NULL OR trim(transaction_date) = ''
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'transaction_date', 'valid_date', 'high',
               'invalid transaction_date: ' || transaction_date
        FROM transactions_typed WHERE trim(transaction_date) <> '' AND transaction_at IS NULL
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'transaction_date', 'not_future', 'medium',
               'future transaction_date: ' || transaction_date
        FROM transactions_typed WHERE transaction_at > {AS_OF}
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'amount', 'not_null', 'high',
               'amount is missing or non-numeric'
        FROM transactions_typed WHERE amount IS NULL
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'amount', 'positive', 'high',
               'non-positive amount: ' || CAST(amount AS VARCHAR)
        FROM transactions_typed WHERE amount <= 0
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'currency', 'allowed_values', 'low',
               'unexpected currency: ' || coalesce(currency, 'nan')
        FROM transactions_typed
        WHERE currency IS NULL OR currency NOT IN ('USD', 'CAD', 'GBP', 'EUR')
        UNION ALL
        SELECT coalesce(transaction_id, 'nan'), row_id, 'channel', 'allowed_values', 'low',
               'unexpected channel: ' || coalesce(channel, 'nan')
        FROM transactions_typed
        WHERE channel IS NULL OR channel NOT IN ('Web', 'Mobile', 'Store', 'Partner')""",
    "log": """
        SELECT tab AS "table", record_id, "column", rule, severity, details,
               CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END
                   AS severity_rank, row_id
        FROM (SELECT 'customers' AS tab, * FROM dq_customers
              UNION ALL SELECT 'transactions', * FROM dq_transactions)""",
    "customer_rates": """
        SELECT count(*) AS n,
               (SELECT count(*) FROM dq_customers) AS issues,
               sum(CASE WHEN repeated THEN 1 ELSE 0 END)::DOUBLE / count(*) AS dup,
               count(CASE WHEN trim(customer_id) <> '' THEN 1 END)::DOUBLE / count(*) AS c1,
               count(CASE WHEN trim(email) <> '' THEN 1 END)::DOUBLE / count(*) AS c2,
               count(CASE WHEN trim(signup_date) <> '' THEN 1 END)::DOUBLE / count(*) AS c3,
               count(CASE WHEN trim(country) <> '' THEN 1 END)::DOUBLE / count(*) AS c4,
               count(CASE WHEN trim(status) <> '' THEN 1 END)::DOUBLE / count(*) AS c5
        FROM customers_typed""",
    "customer_card": """
        SELECT 'customers' AS "table", n AS "rows", issues AS issue_count,
               issues::DOUBLE / n AS issue_rate, dup AS duplicate_rate,
               (c1 + c2 + c3 + c4 + c5) / 5 AS completeness_overall,
               greatest(0::DOUBLE, least(100::DOUBLE,
                   100 - issues::DOUBLE / n * 60 - (1 - (c1 + c2 + c3 + c4 + c5) / 5) * 30
                       - dup * 10)) AS quality_score,
               c1 AS completeness_customer_id, c2 AS completeness_email,
               c3 AS completeness_signup_date, c4 AS completeness_country,
               c5 AS completeness_status
        FROM customer_rates""",
    "transaction_rates": """
        SELECT count(*) AS n,
               (SELECT count(*) FROM dq_transactions) AS issues,
               sum(CASE WHEN repeated THEN 1 ELSE 0 END)::DOUBLE / count(*) AS dup,
               count(CASE WHEN trim(transaction_id) <> '' THEN 1 END)::DOUBLE / count(*) AS c1,
               count(CASE WHEN trim(customer_id) <> '' THEN 1 END)::DOUBLE / count(*) AS c2,
               count(CASE WHEN trim(transaction_date) <> '' THEN 1 END)::DOUBLE / count(*) AS c3,
               count(amount)::DOUBLE / count(*) AS c4,
               count(CASE WHEN trim(currency) <> '' THEN 1 END)::DOUBLE / count(*) AS c5,
               count(CASE WHEN trim(channel) <> '' THEN 1 END)::DOUBLE / count(*) AS c6
        FROM transactions_typed""",
    "transaction_card": """
        SELECT 'transactions' AS "table", n AS "rows", issues AS issue_count,
               issues::DOUBLE / n AS issue_rate, dup AS duplicate_rate,
               (c1 + c2 + c3 + c4 + c5 + c6) / 6 AS completeness_overall,
               greatest(0::DOUBLE, least(100::DOUBLE,
                   100 - issues::DOUBLE / n * 60 - (1 - (c1 + c2 + c3 + c4 + c5 + c6) / 6) * 30
                       - dup * 10)) AS quality_score,
               c1 AS completeness_transaction_id, c2 AS completeness_customer_id,
               c3 AS completeness_transaction_date, c4 AS completeness_amount,
               c5 AS completeness_currency, c6 AS completeness_channel
        FROM transaction_rates""",
    "overall_card": """
        SELECT 'OVERALL' AS "table", c."rows" + t."rows" AS "rows",
               c.issue_count + t.issue_count AS issue_count,
               (c.issue_count + t.issue_count)::DOUBLE / (c."rows" + t."rows") AS issue_rate,
               (c.duplicate_rate + t.duplicate_rate) / 2 AS duplicate_rate,
               (c.completeness_overall + t.completeness_overall) / 2 AS completeness_overall,
               (c.quality_score + t.quality_score) / 2 AS quality_score
        FROM customer_card c, transaction_card t""",
    "fx_dim_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
               r_name AS region
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "fx_dim_reps": """
        SELECT s_suppkey AS rep_id, s_name AS rep_name, r_name AS region
        FROM supplier JOIN nation ON n_nationkey = s_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "fx_dim_products": """
        SELECT product_id, product_name, category, list_price,
               -- whole cents, half a cent rounds up
               CAST(((CAST(list_price * 100 AS BIGINT) * (45 + product_id % 31) + 50) // 100)
                    / CAST(100 AS DOUBLE) AS DECIMAL(18,2)) AS unit_cost
        FROM (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
                     CAST(p_retailprice AS DECIMAL(18,2)) AS list_price FROM part)""",
    "fx_fact_orders": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 40 = 39 THEN o_custkey + 1000000000 ELSE o_custkey END
                   AS customer_id,
               o_orderkey % (SELECT count(*) + 1 FROM supplier) AS rep_id,
               strftime(o_orderdate, '%Y-%m-%d') AS order_date,
               CASE WHEN o_orderkey % 20 < 11 THEN 'Web' WHEN o_orderkey % 20 < 18 THEN 'Sales'
                    ELSE 'Partner' END AS channel,
               (o_orderkey % 19)::DOUBLE / 100 AS discount_rate
        FROM orders""",
    "fx_fact_order_items": """
        SELECT l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey
                   AS order_item_id,
               l.l_orderkey AS order_id, l.l_partkey AS product_id,
               CAST(l.l_partkey % 5 + 1 AS INTEGER) AS quantity,
               -- whole cents, half a cent rounds up
               CAST(((CAST(p.list_price * 100 AS BIGINT) * (100 - o.o_orderkey % 19) + 50) // 100)
                    / CAST(100 AS DOUBLE) AS DECIMAL(18,2)) AS unit_price,
               p.unit_cost
        FROM lineitem l JOIN fx_dim_products p ON p.product_id = l.l_partkey
        JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "fx_fact_returns": """
        SELECT 'RET' || o_orderkey AS return_id, o_orderkey AS order_id,
               strftime(o_orderdate + to_days(CAST(3 + o_orderkey % 42 AS INTEGER)), '%Y-%m-%d')
                   AS return_date,
               CASE o_orderkey % 5 WHEN 0 THEN 'Damaged' WHEN 1 THEN 'Wrong item'
                    WHEN 2 THEN 'Late delivery' WHEN 3 THEN 'Customer changed mind'
                    ELSE 'Other' END AS reason
        FROM orders
        WHERE o_orderkey % 23 = 0 OR (o_orderkey % 20 < 11 AND o_orderkey % 41 = 0)""",
    "v_orders": """
        SELECT o.order_id, o.order_date, substr(o.order_date, 1, 7) AS order_month, o.channel,
               o.discount_rate, o.customer_id, c.customer_name, c.segment,
               c.region AS customer_region, o.rep_id, r.rep_name, r.region AS rep_region
        FROM fx_fact_orders o JOIN fx_dim_customers c USING (customer_id)
        JOIN fx_dim_reps r USING (rep_id)""",
    "v_items": """
        SELECT i.order_item_id, o.*, i.product_id, p.product_name, p.category, i.quantity,
               i.unit_price, i.unit_cost,
               CAST(i.quantity * i.unit_price AS DECIMAL(18,2)) AS revenue,
               CAST(i.quantity * i.unit_cost AS DECIMAL(18,2)) AS cost,
               CAST(i.quantity * (i.unit_price - i.unit_cost) AS DECIMAL(18,2)) AS gross_profit
        FROM fx_fact_order_items i JOIN v_orders o USING (order_id)
        JOIN fx_dim_products p USING (product_id)""",
    "v_returns": """
        SELECT t.return_id, t.order_id, t.return_date, substr(t.return_date, 1, 7) AS return_month,
               t.reason, o.order_date, o.order_month, o.channel, o.customer_id, o.segment,
               o.customer_region, o.rep_id, o.rep_region
        FROM fx_fact_returns t JOIN v_orders o USING (order_id)""",
}

_TICKETS = ["fx_tickets_once", "fx_tickets", "deduplicated", "prepared", "stage_times", "measured"]
_QUALITY = ["fx_customers_raw", "fx_transactions_raw", "customers_typed", "transactions_typed"]
_LOG = _QUALITY + ["dq_customers", "dq_transactions", "log"]
_CARDS = _LOG + ["customer_rates", "customer_card", "transaction_rates", "transaction_card"]
_STAR = [
    "fx_dim_customers",
    "fx_dim_reps",
    "fx_dim_products",
    "fx_fact_orders",
    "fx_fact_order_items",
    "fx_fact_returns",
]
_VIEWS = _STAR + ["v_orders", "v_items", "v_returns"]


def _with(ctes: list[str], select: str) -> str:
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in ctes)
    return f"WITH {body}\n{select}"


def _from_files(sql: str) -> str:
    """The query over tables read from files, where ``row_id`` is the place in the files."""
    for key in ("c", "k"):
        sql = sql.replace(
            f"SELECT {key} AS row_id", f"SELECT row_number() OVER (ORDER BY {key}) - 1 AS row_id"
        )
    return sql


# tickets written as text: see files.tickets
_NUMBER = "CAST(substr(ticket_id, 2) AS BIGINT)"
_FILE_TICKETS = f"""
    SELECT DISTINCT ticket_id, created_at,
           CASE WHEN {_NUMBER} % 2 = 0 AND {_NUMBER} % 101 = 0 THEN NULL ELSE intake_at END
               AS intake_at,
           triage_at, work_at, resolved_at,
           CASE {_NUMBER} % 10
               WHEN 3 THEN 'say "' || category || '",' || chr(10) || category
               WHEN 4 THEN NULL ELSE category END AS category,
           priority, channel, owner_team, CAST(sla_target_hours AS DOUBLE) AS sla_target_hours
    FROM fx_tickets"""


def half_up(part: str, whole: str, digits: int) -> str:
    """``part / whole`` of whole numbers, rounded half away from zero, as a double."""
    unit = 10**digits
    size = f"((abs({part}) * {2 * unit} + ({whole})) // (({whole}) * 2))"
    return f"(sign({part}) * CAST({size} AS DOUBLE) / {unit}::DOUBLE)"


def cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS HUGEINT)"


_MARGIN = half_up(cents("sum(gross_profit)"), cents("sum(revenue)"), 4)
_MONEY = """CAST(sum(revenue) AS DOUBLE) AS revenue,
            CAST(sum(gross_profit) AS DOUBLE) AS gross_profit"""
_ORDERS = "count(DISTINCT order_id)"
_AOV = half_up(cents("sum(revenue)"), f"{_ORDERS} * 100", 2)


def _mean_hours(micros: str) -> str:
    return f"CAST(sum({micros}) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 3600000000::DOUBLE"


def _ticket_kpi(key: str) -> str:
    return _with(
        _TICKETS,
        f"""SELECT {key}, count(ticket_id) AS tickets,
                   {_mean_hours("cycle_us")} AS avg_cycle_time_hours,
                   CAST(count(*) FILTER (WHERE sla_breached) AS DOUBLE) / count(*)
                       AS sla_breach_rate
            FROM measured WHERE {key} IS NOT NULL GROUP BY {key}""",
    )


_BOTTLENECKS = f"""SELECT bottleneck_stage, count(ticket_id) AS tickets,
                          {_mean_hours("cycle_us")} AS avg_cycle_time_hours
                   FROM measured GROUP BY bottleneck_stage"""

_TICKET_COLUMNS = """ticket_id, created_at, intake_at, triage_at, work_at, resolved_at, category,
                     priority, channel, owner_team, sla_target_hours, is_duplicate_ticket_id,
                     is_valid_timeline"""

_ISSUE_COLUMNS = '"table", record_id, "column", rule, severity, details, severity_rank'


def _sales_kpi(key: str, name: str) -> str:
    return f"""SELECT {key} AS {name}, {_ORDERS} AS orders, {_MONEY},
                      {_MARGIN} AS gross_margin_rate, {_AOV} AS aov
               FROM v_items GROUP BY {key}"""


_MONTHLY = f"""
    SELECT m.*, coalesce(r.returned, 0) AS returned_orders,
           {half_up("coalesce(r.returned, 0)", "m.orders", 4)} AS return_rate
    FROM (SELECT order_month, {_ORDERS} AS orders, count(DISTINCT customer_id) AS customers,
                 {_MONEY}, {_MARGIN} AS gross_margin_rate, {_AOV} AS aov
          FROM v_items GROUP BY order_month) m
    LEFT JOIN (SELECT order_month, {_ORDERS} AS returned FROM v_returns GROUP BY order_month) r
      ON r.order_month = m.order_month"""

_TOP_PRODUCTS = f"""
    SELECT product_id, product_name, category, CAST(sum(quantity) AS BIGINT) AS units, {_MONEY},
           {_MARGIN} AS gross_margin_rate
    FROM v_items GROUP BY product_id, product_name, category
    ORDER BY sum(revenue) DESC, product_id LIMIT 25"""

_RULES = [
    ("customers", "customer_id", "not_null", "high"),
    ("customers", "customer_id", "unique", "high"),
    ("customers", "email", "not_null", "medium"),
    ("customers", "email", "valid_email", "medium"),
    ("customers", "signup_date", "valid_date", "high"),
    ("customers", "signup_date", "not_future", "medium"),
    ("customers", "country", "allowed_values", "low"),
    ("customers", "status", "allowed_values", "low"),
    ("transactions", "transaction_id", "not_null", "high"),
    ("transactions", "transaction_id", "unique", "high"),
    ("transactions", "customer_id", "not_null", "high"),
    ("transactions", "customer_id", "fk_exists", "high"),
    ("transactions", "transaction_date", "not_null", "high"),
    ("transactions", "transaction_date", "valid_date", "high"),
    ("transactions", "transaction_date", "not_future", "medium"),
    ("transactions", "amount", "not_null", "high"),
    ("transactions", "amount", "positive", "high"),
    ("transactions", "currency", "allowed_values", "low"),
    ("transactions", "channel", "allowed_values", "low"),
]
_RULE_ROWS = ", ".join(str(rule) for rule in _RULES)

_RECORD_STATUS = """
    SELECT s.tab AS "table", s.row_id, s.record_id, CAST(coalesce(v.n, 0) AS INTEGER) AS violations,
           CASE WHEN v.n > 0 THEN 'failed' ELSE 'clean' END AS status
    FROM (SELECT 'customers' AS tab, row_id, coalesce(customer_id, 'nan') AS record_id
          FROM fx_customers_raw
          UNION ALL
          SELECT 'transactions', row_id, coalesce(transaction_id, 'nan')
          FROM fx_transactions_raw) s
    LEFT JOIN (SELECT "table" AS tab, row_id, count(*) AS n FROM log GROUP BY ALL) v
      ON v.tab = s.tab AND v.row_id = s.row_id"""

_FAILURE_RATES = f"""
    SELECT r.tab AS "table", n.n AS "rows", r.col AS "column", r.rule, r.severity,
           coalesce(f.n, 0) AS failed_records,
           coalesce(f.n, 0)::DOUBLE / n.n AS failure_rate
    FROM (VALUES {_RULE_ROWS}) r(tab, col, rule, severity)
    JOIN (SELECT 'customers' AS tab, count(*) AS n FROM fx_customers_raw
          UNION ALL SELECT 'transactions', count(*) FROM fx_transactions_raw) n ON n.tab = r.tab
    LEFT JOIN (SELECT "table" AS tab, "column" AS col, rule, count(DISTINCT row_id) AS n
               FROM log GROUP BY ALL) f
      ON f.tab = r.tab AND f.col = r.col AND f.rule = r.rule"""

CTES["file_tickets"] = _FILE_TICKETS

SQL = {
    # tickets
    "ticket_duplicate_flags": _with(
        _TICKETS[:4], "SELECT ticket_id, is_duplicate_ticket_id FROM prepared"
    ),
    "ticket_prepared": _with(_TICKETS[:4], f"SELECT {_TICKET_COLUMNS} FROM prepared"),
    "ticket_rejected": _with(
        _TICKETS[:4], f"SELECT {_TICKET_COLUMNS} FROM prepared WHERE NOT is_valid_timeline"
    ),
    "ticket_clean": _with(
        _TICKETS,
        f"""SELECT {_TICKET_COLUMNS},
                   CAST(cycle_us AS DOUBLE) / 3600000000::DOUBLE AS cycle_time_hours,
                   CAST(intake_us AS DOUBLE) / 3600000000::DOUBLE AS intake_hours,
                   CAST(triage_us AS DOUBLE) / 3600000000::DOUBLE AS triage_hours,
                   CAST(work_us AS DOUBLE) / 3600000000::DOUBLE AS work_hours,
                   CAST(review_us AS DOUBLE) / 3600000000::DOUBLE AS review_hours,
                   sla_breached, bottleneck_stage
            FROM measured""",
    ),
    "ticket_kpi_overall": _with(
        _TICKETS,
        f"""SELECT (SELECT count(*) FROM fx_tickets) AS rows_raw,
                   (SELECT count(*) FROM deduplicated) AS rows_after_drop_duplicates,
                   (SELECT count(*) FROM fx_tickets) - (SELECT count(*) FROM deduplicated)
                       AS duplicate_rows_removed,
                   count(*) AS rows_valid_timeline,
                   (SELECT count(*) FROM prepared WHERE NOT is_valid_timeline)
                       AS rows_rejected_invalid_timeline,
                   count(*)::DOUBLE / (SELECT count(*) FROM deduplicated) AS pct_valid,
                   {_mean_hours("cycle_us")} AS avg_cycle_time_hours,
                   median(cycle_us) / 3600000000::DOUBLE AS median_cycle_time_hours,
                   CAST(count(*) FILTER (WHERE sla_breached) AS DOUBLE) / count(*)
                       AS sla_breach_rate
            FROM measured""",
    ),
    "ticket_kpi_by_priority": _ticket_kpi("priority"),
    "ticket_kpi_by_category": _ticket_kpi("category"),
    "ticket_kpi_by_owner": _ticket_kpi("owner_team"),
    "ticket_bottlenecks": _with(_TICKETS, _BOTTLENECKS),
    "ticket_bottlenecks_top5": _with(
        _TICKETS, f"SELECT * FROM ({_BOTTLENECKS}) ORDER BY tickets DESC, bottleneck_stage LIMIT 5"
    ),
    # data quality
    "dq_customer_issues": _with(
        _LOG, f"SELECT {_ISSUE_COLUMNS} FROM log WHERE \"table\" = 'customers'"
    ),
    "dq_transaction_issues": _with(
        _LOG, f"SELECT {_ISSUE_COLUMNS} FROM log WHERE \"table\" = 'transactions'"
    ),
    "dq_issues": _with(_LOG, f"SELECT {_ISSUE_COLUMNS} FROM log"),
    "dq_summary_customers": _with(_CARDS, "SELECT * FROM customer_card"),
    "dq_summary_transactions": _with(_CARDS, "SELECT * FROM transaction_card"),
    "dq_overall": _with(_CARDS + ["overall_card"], "SELECT * FROM overall_card"),
    "dq_scorecard": _with(
        _CARDS + ["overall_card"],
        """SELECT * FROM overall_card
           UNION ALL BY NAME SELECT * FROM customer_card
           UNION ALL BY NAME SELECT * FROM transaction_card""",
    ),
    "dq_top_rules": _with(
        _LOG,
        """SELECT "table", rule, count(*) AS size FROM log GROUP BY "table", rule
           ORDER BY size DESC, "table", rule LIMIT 10""",
    ),
    "dq_record_status": _with(_LOG, _RECORD_STATUS),
    "dq_failure_rate_by_rule": _with(_LOG, _FAILURE_RATES),
    "dq_issues_by_severity": _with(
        _LOG,
        """SELECT "table", severity, severity_rank, count(*) AS issues FROM log
           GROUP BY "table", severity, severity_rank""",
    ),
    # sales
    "order_items_enriched": _with(
        _VIEWS,
        """SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price,
                             CAST(unit_cost AS DOUBLE) AS unit_cost,
                             CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
                             CAST(gross_profit AS DOUBLE) AS gross_profit)
           FROM v_items""",
    ),
    "orders_enriched": _with(_VIEWS, "SELECT * FROM v_orders"),
    "returns_enriched": _with(_VIEWS, "SELECT * FROM v_returns"),
    "kpi_monthly": _with(_VIEWS, _MONTHLY),
    "kpi_by_region": _with(_VIEWS, _sales_kpi("rep_region", "region")),
    "kpi_by_channel": _with(_VIEWS, _sales_kpi("channel", "channel")),
    "kpi_top_products": _with(_VIEWS, _TOP_PRODUCTS),
    "kpi_returns_by_reason": _with(
        _VIEWS, "SELECT reason, count(*) AS returns FROM v_returns GROUP BY reason"
    ),
    "kpi_returns_by_channel": _with(
        _VIEWS,
        f"""SELECT o.order_month, o.channel, o.orders, coalesce(r.returned, 0) AS returned_orders,
                   {half_up("coalesce(r.returned, 0)", "o.orders", 4)} AS return_rate
            FROM (SELECT order_month, channel, {_ORDERS} AS orders FROM v_orders
                  GROUP BY order_month, channel) o
            LEFT JOIN (SELECT order_month, channel, {_ORDERS} AS returned FROM v_returns
                       GROUP BY order_month, channel) r
              ON r.order_month = o.order_month AND r.channel = o.channel""",
    ),
    "customer_first_order": _with(
        _VIEWS,
        """SELECT customer_id, min(order_month) AS first_order_month FROM v_orders
           GROUP BY customer_id""",
    ),
    "customer_cohorts": _with(
        _VIEWS,
        f"""SELECT a.cohort_month, a.activity_month, s.cohort_customers, a.active_customers,
                   {half_up("a.active_customers", "s.cohort_customers", 4)} AS retention_rate
            FROM (SELECT f.first_month AS cohort_month, o.order_month AS activity_month,
                         count(DISTINCT o.customer_id) AS active_customers
                  FROM v_orders o
                  JOIN (SELECT customer_id, min(order_month) AS first_month FROM v_orders
                        GROUP BY customer_id) f USING (customer_id)
                  GROUP BY f.first_month, o.order_month) a
            JOIN (SELECT first_month, count(*) AS cohort_customers
                  FROM (SELECT customer_id, min(order_month) AS first_month FROM v_orders
                        GROUP BY customer_id)
                  GROUP BY first_month) s ON s.first_month = a.cohort_month""",
    ),
    "schema_row_counts": _with(
        _STAR,
        """SELECT 'dim_customers' AS table_name, count(*) AS "rows" FROM fx_dim_customers
           UNION ALL SELECT 'dim_products', count(*) FROM fx_dim_products
           UNION ALL SELECT 'dim_reps', count(*) FROM fx_dim_reps
           UNION ALL SELECT 'fact_orders', count(*) FROM fx_fact_orders
           UNION ALL SELECT 'fact_order_items', count(*) FROM fx_fact_order_items
           UNION ALL SELECT 'fact_returns', count(*) FROM fx_fact_returns""",
    ),
    "order_date_range": _with(
        ["fx_fact_orders"],
        """SELECT min(order_date) AS min_order_date, max(order_date) AS max_order_date
           FROM fx_fact_orders""",
    ),
    "order_null_audit": _with(
        ["fx_fact_orders"],
        """SELECT count(*) - count(order_id) AS null_order_id,
                  count(*) - count(customer_id) AS null_customer_id,
                  count(*) - count(order_date) AS null_order_date
           FROM fx_fact_orders""",
    ),
    "kpi_monthly_latest6": _with(
        _VIEWS, f"SELECT * FROM ({_MONTHLY}) ORDER BY order_month DESC LIMIT 6"
    ),
    "kpi_regions_by_revenue": _with(_VIEWS, _sales_kpi("rep_region", "region")),
    "kpi_top10_products": _with(
        _VIEWS, f"SELECT * FROM ({_TOP_PRODUCTS}) ORDER BY revenue DESC, product_id LIMIT 10"
    ),
    # through files, result tables and views
    "csv_ticket_prepared": _with(
        [*_TICKETS[:2], "file_tickets"],
        f"""SELECT {_TICKET_COLUMNS} FROM (
                SELECT *, count(*) OVER (PARTITION BY ticket_id) > 1 AS is_duplicate_ticket_id,
                       coalesce(created_at <= intake_at AND intake_at <= triage_at
                                AND triage_at <= work_at AND work_at <= resolved_at, false)
                           AS is_valid_timeline
                FROM file_tickets)""",
    ),
    "csv_dq_issues": _from_files(_with(_LOG, f"SELECT {_ISSUE_COLUMNS} FROM log")),
    "csv_dq_record_status": _from_files(_with(_LOG, _RECORD_STATUS)),
    "csv_kpi_by_channel": _with(_VIEWS, _sales_kpi("channel", "channel")),
    "csv_kpi_monthly": _with(_VIEWS, _MONTHLY),
    "saved_kpi_by_region": _with(_VIEWS, _sales_kpi("rep_region", "region")),
    "saved_kpi_by_region_csv": _with(_VIEWS, _sales_kpi("rep_region", "region")),
    "saved_kpi_by_region_table": _with(_VIEWS, _sales_kpi("rep_region", "region")),
    "csv_quarantine": _with(
        ["fx_customers_raw"],
        """SELECT coalesce(customer_id, '') || ',' || coalesce(email, '') || ',' ||
                  coalesce(signup_date, '') || ',' || coalesce(country, '') || ',' ||
                  coalesce(status, '') || ',one more' AS record,
                  (SELECT count(customer_id) FROM fx_customers_raw WHERE row_id % 97 <> 0) AS ids_left
           FROM fx_customers_raw WHERE row_id % 97 = 0""",
    ),
    "dq_scorecard_watched": _with(
        _CARDS + ["overall_card"],
        """SELECT * FROM overall_card
           UNION ALL BY NAME SELECT * FROM customer_card
           UNION ALL BY NAME SELECT * FROM transaction_card""",
    ),
    "dq_repeated_keys_by_load": _with(
        ["fx_transactions_raw"],
        """SELECT transaction_id FROM fx_transactions_raw
           GROUP BY transaction_id HAVING count(*) > 1""",
    ),
    "reach_by_grain": _with(
        _VIEWS,
        " UNION ALL ".join(
            f"""SELECT '{name}' AS grain, {grain} AS value, count(DISTINCT order_id) AS orders,
                       count(DISTINCT customer_id) AS customers FROM v_orders GROUP BY {grain}"""
            for name, grain in {
                "month": "order_month",
                "quarter": "order_month[:4] || '-Q' || CAST((CAST(order_month[6:] AS INT) + 2) // 3 AS VARCHAR)",
                "region": "rep_region",
                "channel": "channel",
            }.items()
        ),
    ),
    "view_orders_by_segment": _with(
        _VIEWS,
        """SELECT o.segment, count(DISTINCT o.order_id) AS orders, count(r.return_id) AS returns
           FROM v_orders o LEFT JOIN v_returns r ON r.order_id = o.order_id GROUP BY o.segment""",
    ),
}

# the same results by other ways
SQL |= {
    "customer_cohorts_by_load": SQL["customer_cohorts"],
    "order_items_bucketed": SQL["order_items_enriched"],
}

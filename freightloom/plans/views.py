"""Named SQL views shared by the checks."""

from pyspark.sql import functions as F


def cells_sql(*keys: str) -> str:
    k = ", ".join(keys)
    return f"""
SELECT *, CASE WHEN count(actual) OVER w = 3 THEN avg(actual) OVER w END AS forecast
FROM (SELECT {k}, period, count(*) AS orders, sum(qty) AS actual, avg(late) AS late_rate, sum(sales) AS revenue
      FROM oi GROUP BY {k}, period)
WINDOW w AS (PARTITION BY {k} ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
"""


CELLS = cells_sql("category", "region")
ORDER_BY = "order_date, order_id, line_no, product_id, supplier_id, l_shipdate"

# Dates that follow from the newest day of the data.
RUNNING_SQL = "(SELECT strftime(max(order_date) + INTERVAL 1 DAY, '%Y-%m') FROM oi)"
COMPLETE_SQL = "(SELECT strftime(date_trunc('month', max(order_date) + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m') FROM oi)"


def since_sql(months: int) -> str:
    return f"(SELECT date_trunc('month', max(order_date) - INTERVAL {months} MONTH)::date FROM oi)"


def since(d, months: int):
    """First day of the month that lies so many months before the newest day."""
    return d.agg(F.trunc(F.add_months(F.max("order_date"), -months), "MM")).scalar()


def running_month(d):
    """The month that is not complete: that of the day after the newest."""
    return d.agg(F.date_format(F.date_add(F.max("order_date"), 1), "yyyy-MM")).scalar()


def complete_month(d):
    """The newest month the data cover to its last day."""
    return d.agg(F.date_format(F.date_sub(F.trunc(F.date_add(F.max("order_date"), 1), "MM"), 1), "yyyy-MM")).scalar()

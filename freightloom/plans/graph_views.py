"""SQL of the node and edge tables for the checks."""

from freightloom.plans.views import ORDER_BY


def title(c: str) -> str:
    words = f"string_split(replace(replace(lower(trim({c})), '_', ' '), '  ', ' '), ' ')"
    return f"list_aggregate(list_transform({words}, lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ')"


def nid(label: str, key: str) -> str:
    return f"substr(md5('{label}:' || {key}), 1, 12)"


NAMED = f"""SELECT * REPLACE ({title('department')} AS department, {title('category')} AS category, {title('city')} AS city) FROM oi"""
FIRST = """SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY line_no, product_id, supplier_id, l_shipdate) = 1"""
SUPPLIERS = f"""
SELECT {nid('Supplier', 'name')} AS node_id, name, round(1 - p, 6) AS reliability, round(p, 6) AS delay_rate,
  round(1 - p, 6) AS shipping_efficiency, round(d, 6) AS avg_delay_days, n AS total_orders,
  round(least(p * 0.5 + least(greatest(d, 0.0) / 7, 1.0) * 0.5, 1.0), 6) AS risk_score
FROM (SELECT department AS name, avg(late) AS p, avg(days_real) - avg(days_sched) AS d, count(*) AS n FROM nm GROUP BY department)"""
_DESC = ", ".join(c + " DESC" for c in ORDER_BY.split(", "))
PRODUCTS = f"""
SELECT {nid('Product', 'category')} AS node_id, category, round(r7, 6) AS rolling_7d, round(r30, 6) AS rolling_30d,
  round(vol, 6) AS volatility, round(slope, 6) AS trend_slope, round(least(vol * 0.5 + p * 0.5, 1.0), 6) AS inventory_stress,
  round(least(vol * 0.4 + p * 0.3 + abs(slope) / (r30 + 1) * 0.3, 1.0), 6) AS forecast_risk
FROM (SELECT category, avg(late) AS p,
    CASE WHEN count(*) >= 7 THEN avg(qty) FILTER (b <= 7) ELSE avg(qty) END AS r7,
    CASE WHEN count(*) >= 30 THEN avg(qty) FILTER (b <= 30) ELSE avg(qty) END AS r30,
    CASE WHEN count(*) >= 14 THEN avg(qty) FILTER (b <= 7) - avg(qty) FILTER (a <= 7) ELSE 0.0 END AS slope,
    coalesce(stddev_samp(qty), 0.0) / avg(qty) AS vol
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {ORDER_BY}) AS a,
          row_number() OVER (PARTITION BY category ORDER BY {_DESC}) AS b FROM nm) GROUP BY category)"""
WAREHOUSES = f"""
SELECT {nid('Warehouse', 'city')} AS node_id, city, region, round(1 - p, 6) AS coverage, round(s, 6) AS stress,
  round(greatest((1 - s) * 30, 0.0), 6) AS days_to_reorder, round(least(s * 0.7 + p * 0.3, 1.0), 6) AS risk
FROM (SELECT city, min(region) AS region, avg(late) AS p, least(avg(late) * 0.6 + least(avg(qty) / 20, 1.0) * 0.4, 1.0) AS s
      FROM nm GROUP BY city)"""
SHIPMENTS = f"""
SELECT {nid('Shipment', 'ship_mode')} AS node_id, ship_mode AS mode, round(avg(days_sched), 6) AS scheduled_days,
  round(avg(days_real), 6) AS actual_days, round(avg(days_real) - avg(days_sched), 6) AS delay,
  round(1 - avg(late), 6) AS efficiency, round(avg(late), 6) AS late_rate FROM nm GROUP BY ship_mode"""
CUSTOMERS = f"""
SELECT {nid('Customer', 'customer_id')} AS node_id, customer_id, min(segment) AS segment, min(region) AS region,
  count(*) AS total_orders, round(avg(sales), 8) AS avg_order_value,
  round(CASE WHEN sum(sales) > 0 THEN sum(profit) / sum(sales) ELSE 0.0 END, 6) AS profit_margin FROM nm GROUP BY customer_id"""
ORDERS = f"""
SELECT {nid('Order', 'order_id')} AS node_id, order_id, order_date, round(sales, 2) AS value, qty AS quantity,
  round(profit, 4) AS profit, CAST(late AS DOUBLE) AS risk_score FROM fl"""
_MONTH = "monthname(order_date)"
CALENDAR = f"""
SELECT DISTINCT {nid('CalendarEvent', "'month_' || month(order_date)")} AS node_id, {_MONTH} AS name,
  'monthly_period' AS type, CASE WHEN month(order_date) = 12 THEN 1 ELSE 0 END AS is_holiday FROM nm
UNION ALL SELECT {nid('CalendarEvent', "'weekend'")}, 'Weekend', 'day_type', 0 WHERE EXISTS (SELECT 1 FROM nm WHERE isodow(order_date) >= 6)"""
_E = "{s} AS src, {d} AS dst, '{r}' AS rel_type, '{sl}' AS src_label, '{dl}' AS dst_label"


def _edge(rel, src, dst):
    return _E.format(s=nid(*src), d=nid(*dst), r=rel, sl=src[0], dl=dst[0])


SUPPLIES = f"""
SELECT {_edge('SUPPLIES', ('Supplier', 'department'), ('Product', 'category'))}, round(n / max(n) OVER (), 6) AS strength,
  n AS frequency, round(d, 6) AS avg_delay, CAST(0.95 AS DOUBLE) AS confidence
FROM (SELECT department, category, count(*) AS n, avg(days_real) AS d FROM nm GROUP BY department, category)"""
STORED_IN = f"""
SELECT {_edge('STORED_IN', ('Product', 'category'), ('Warehouse', 'city'))}, round(n / max(n) OVER (), 6) AS strength,
  n AS frequency, CAST(NULL AS DOUBLE) AS avg_delay, CAST(0.85 AS DOUBLE) AS confidence
FROM (SELECT * FROM (SELECT category, city, count(*) AS n FROM nm GROUP BY category, city)
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, city) <= 3)"""
SHIPS_VIA = f"""
SELECT {_edge('SHIPS_VIA', ('Order', 'order_id'), ('Shipment', 'ship_mode'))}, CAST(1 AS DOUBLE) AS strength,
  CAST(1 AS BIGINT) AS frequency, CAST(NULL AS DOUBLE) AS avg_delay, CAST(1 AS DOUBLE) AS confidence
FROM (SELECT DISTINCT order_id, ship_mode FROM nm)"""
DELIVERED_TO = f"""
SELECT {_edge('DELIVERED_TO', ('Shipment', 'ship_mode'), ('Customer', 'customer_id'))}, round(least(n / 10, 1.0), 6) AS strength,
  n AS frequency, round(d, 6) AS avg_delay, CAST(0.9 AS DOUBLE) AS confidence
FROM (SELECT * FROM (SELECT ship_mode, customer_id, count(*) AS n, avg(days_real) AS d FROM nm GROUP BY ship_mode, customer_id)
      QUALIFY row_number() OVER (PARTITION BY ship_mode ORDER BY n DESC, customer_id) <= 50)"""
_ONE = "CAST({} AS DOUBLE) AS strength, CAST(1 AS BIGINT) AS frequency, CAST(NULL AS DOUBLE) AS avg_delay, CAST({} AS DOUBLE) AS confidence"
_MKEY = "'month_' || month(order_date)"
PER_ORDER = f"""
SELECT {_edge('PLACED', ('Customer', 'customer_id'), ('Order', 'order_id'))}, {_ONE.format(1, 1)} FROM fl
UNION ALL SELECT {_edge('CONTAINS', ('Order', 'order_id'), ('Product', 'category'))}, {_ONE.format(1, 1)} FROM fl
UNION ALL SELECT {_edge('INFLUENCES', ('CalendarEvent', _MKEY), ('Order', 'order_id'))}, {_ONE.format(0.7, 0.8)} FROM fl"""
NODES = """
SELECT node_id, 'Supplier' AS label, name, risk_score AS risk FROM sup
UNION ALL SELECT node_id, 'Product', category, forecast_risk FROM pro
UNION ALL SELECT node_id, 'Warehouse', city, risk FROM war
UNION ALL SELECT node_id, 'Shipment', mode, late_rate FROM shi
UNION ALL SELECT node_id, 'Customer', CAST(customer_id AS VARCHAR), 0.0 FROM cus
UNION ALL SELECT node_id, 'Order', CAST(order_id AS VARCHAR), risk_score FROM ord
UNION ALL SELECT node_id, 'CalendarEvent', name, 0.0 FROM cal"""
EDGES = f"{SUPPLIES} UNION ALL {STORED_IN} UNION ALL {SHIPS_VIA} UNION ALL {DELIVERED_TO} UNION ALL {PER_ORDER}"
BASE = {"nm": NAMED, "fl": FIRST}
GRAPH = {
    **BASE, "sup": SUPPLIERS, "pro": PRODUCTS, "war": WAREHOUSES, "shi": SHIPMENTS, "cus": CUSTOMERS, "ord": ORDERS, "cal": CALENDAR,
    "nodes": NODES, "edges": EDGES,
    "adj": "SELECT src, dst, rel_type, strength, frequency, confidence FROM edges UNION ALL SELECT dst, src, rel_type, strength, frequency, confidence FROM edges",
    "deg": "SELECT src AS node_id, count(*) AS degree FROM adj GROUP BY src",
}

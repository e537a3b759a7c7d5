"""Matching of new rows with forecast anchors."""

import datetime

from freightloom.plans.joins import unmatched

SCHEMA = "order_id long, line_no int, product_id long, supplier_id long, l_shipdate date, order_date date, department string, ship_mode string, region string, late int, qty double"


def test_a_row_is_unmatched_only_without_an_anchor_of_any_kind_in_the_whole_history(spark):
    day = lambda m, d=1: datetime.date(2001, m, d)
    row = lambda i, when, product, supplier, mode: (i, 1, product, 1, when, when, supplier, mode, "R", 1, 2.0)
    rows = [
        row(1, day(1), 10, "S", "air"),  # far before the cut
        row(2, day(8, 20), 10, "new", "sea"), row(3, day(8, 20), 11, "S", "sea"), row(4, day(8, 20), 12, "new", "air"),  # one known key each
        row(5, day(8, 31), 13, "new", "sea"),
    ]
    got = unmatched(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["order_id"] for r in got] == [5]

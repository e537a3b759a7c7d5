import datetime
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from freightloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared") / "checkpoints"))
    yield session
    session.stop()


def order_lines(n, seed=1, hot=0.5):
    """Random order lines; a share `hot` of them falls on one day and one cell."""
    rnd = random.Random(seed)
    start = datetime.date(2000, 1, 1)
    rows = []
    for i in range(n):
        is_hot = rnd.random() < hot
        day = start + datetime.timedelta(days=5 if is_hot else rnd.randrange(60))
        rows.append({
            "order_date": day, "order_id": rnd.randrange(n), "line_no": i, "product_id": rnd.randrange(9), "supplier_id": rnd.randrange(4),
            "l_shipdate": day, "slot": 0, "category": "A" if is_hot else rnd.choice("ABC"), "region": "R" if is_hot else rnd.choice("RST"),
            "department": "D" if is_hot else rnd.choice("DEF"), "ship_mode": rnd.choice("mn"), "qty": float(rnd.randrange(1, 50)), "late": rnd.randrange(2),
        })
    return rows


LINE_SCHEMA = ("order_date date, order_id long, line_no int, product_id long, supplier_id long, l_shipdate date, slot int, category string, "
               "region string, department string, ship_mode string, qty double, late int")


@pytest.fixture(scope="session")
def lines(spark):
    rows = order_lines(600)
    return spark.createDataFrame([tuple(r.values()) for r in rows], LINE_SCHEMA)

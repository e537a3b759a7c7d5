import datetime

import pytest
from pyspark.sql import functions as F

from freightloom.session import work_path
from freightloom.sources.store import CumulativeStore

SCHEMA = "period string, order_date date, id long, sales double"


def month(spark, period, ids):
    d = datetime.date.fromisoformat(period + "-15")
    return spark.createDataFrame([(period, d, i, float(i)) for i in ids], SCHEMA)


@pytest.fixture
def store(spark):
    s = CumulativeStore(spark, work_path(spark, "store-test"))
    s.write_base(month(spark, "2020-01", range(10)))
    return s


def held(store):
    return {r.period: r.n for r in store.read().groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_append_replay_and_rollback(spark, store):
    assert held(store) == {"2020-01": 10}
    assert [r.period for r in store.append(month(spark, "2020-02", range(5))).collect()] == ["2020-02"]
    # a replayed period is refused, the rest of the upload is taken
    both = month(spark, "2020-02", range(99)).unionByName(month(spark, "2020-03", range(3)))
    assert [r.period for r in store.append(both).collect()] == ["2020-03"]
    assert held(store) == {"2020-01": 10, "2020-02": 5, "2020-03": 3}
    store.rollback("2020-02")
    assert held(store) == {"2020-01": 10, "2020-03": 3}
    store.append(month(spark, "2020-02", range(7)))
    assert held(store) == {"2020-01": 10, "2020-02": 7, "2020-03": 3}


def test_unlisted_partition_is_not_read(spark, store):
    month(spark, "2020-02", range(4)).write.partitionBy("period").parquet(f"{store.path}/increments")
    assert held(store) == {"2020-01": 10}
    store.append(month(spark, "2020-03", range(2)))
    assert held(store) == {"2020-01": 10, "2020-03": 2}


def test_uploads_are_told_apart_by_the_hash_of_their_bytes(spark, tmp_path):
    """Each file has the SHA-256 of its bytes, and files of the same bytes count as copies."""
    import hashlib
    import shutil

    from freightloom.plans import QUERIES
    from freightloom.plans.store import uploads

    for name, n in (("lineitem", 5), ("documents", 7)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/made/{name}")
        shutil.copy(next((tmp_path / "made" / name).glob("*.parquet")), tmp_path / f"{name}.parquet")
    shutil.copy(tmp_path / "lineitem.parquet", tmp_path / "orders.parquet")
    got = {r.file_name: r for r in uploads(spark, str(tmp_path), ("lineitem", "orders", "documents")).collect()}
    assert set(got) == {"lineitem.parquet", "orders.parquet", "documents.parquet"}
    for name, r in got.items():
        content = (tmp_path / name).read_bytes()
        assert (r.sha256, r.file_size, r.n_columns) == (hashlib.sha256(content).hexdigest(), len(content), 1)
    copies = {r.file_name: (r.n_rows, r.has_size, r.hash_digits, r.copies) for r in QUERIES["upload_metadata"](spark, str(tmp_path)).collect()}
    assert copies == {"lineitem.parquet": (5, 1, 64, 2), "orders.parquet": (5, 1, 64, 2), "documents.parquet": (7, 1, 64, 1)}

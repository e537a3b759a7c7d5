"""Monthly store: base table plus immutable monthly increments, with a manifest against replays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(columns: list[str]) -> Column:
    """Order-independent checksum of a set of rows."""
    return F.bit_xor(F.xxhash64(*columns))


def manifest_of(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("order_date").alias("data_end"), fingerprint(columns).alias("checksum")
    )


def with_digests(files: DataFrame) -> DataFrame:
    """Adds sha256 of the bytes of the file at `file_path`, a URI as Spark's sources give it; a row a file.

    A digest takes a file's bytes one after the other, so they are streamed, whatever the file's size, through the file system Spark reads it by.
    """
    spark, rows = files.sparkSession, []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in files.collect():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["file_path"]))
        stream = path.getFileSystem(conf).open(path)
        try:
            rows.append((*row, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return spark.createDataFrame(rows, files.schema.add("sha256", "string"))


class CumulativeStore:
    """Increments are partitions of one parquet table; the manifest is a small table of appended periods.

    The increment is written before its manifest row. A crash between the two leaves a partition the manifest does not list; it is neither read nor
    refused, and the retry overwrites just that partition.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write_base(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/base")

    def _exists(self, part: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{part}")
            return True
        except AnalysisException:
            return False

    def manifest(self) -> DataFrame:
        """Entries that were not rolled back: the newest entry per period decides."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], "period string, n_rows long, data_end date, checksum long")
        log = self.spark.read.parquet(f"{self.path}/manifest")
        latest = log.groupBy("period").agg(F.max_by(F.struct("n_rows", "data_end", "checksum", "removed"), "seq").alias("m"))
        return latest.where("NOT m.removed").select("period", "m.n_rows", "m.data_end", "m.checksum")

    def _log(self, rows: DataFrame, removed: bool) -> None:
        seq = 1
        if self._exists("manifest"):
            last = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("seq")).first()[0]
            seq = (last or 0) + 1
        rows.select("period", "n_rows", "data_end", "checksum", F.lit(removed).alias("removed"), F.lit(seq).alias("seq")).write.mode("append").parquet(
            f"{self.path}/manifest"
        )

    def append(self, df: DataFrame) -> DataFrame:
        """Append the periods the manifest does not hold yet; returns the accepted manifest rows."""
        fresh = df.join(self.manifest().select("period"), "period", "left_anti")
        columns = sorted(c for c in df.columns if c != "period")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{self.path}/increments")
        written = (
            self.spark.read.schema(df.schema).parquet(f"{self.path}/increments")
            .join(df.select("period").distinct(), "period", "left_semi")
            .join(self.manifest().select("period"), "period", "left_anti")
        )
        manifest_of(written, columns).write.mode("overwrite").parquet(f"{self.path}/accepted")
        accepted = self.spark.read.parquet(f"{self.path}/accepted")
        self._log(accepted, removed=False)
        return accepted

    def rollback(self, period: str) -> None:
        """Take one period out; its partition stays on disk unread until it is appended again."""
        self._log(self.manifest().where(F.col("period") == period), removed=True)

    def read(self) -> DataFrame:
        """Base plus the increments the manifest lists; columns missing on one side become null."""
        base = self.spark.read.parquet(f"{self.path}/base")
        if not self._exists("increments"):
            return base
        listed = self.manifest().select("period")
        return base.unionByName(self.spark.read.parquet(f"{self.path}/increments").withColumn("period", F.col("period").cast("string")).join(
            listed, "period", "left_semi"), allowMissingColumns=True)

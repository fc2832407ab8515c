"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder does for a local session (tests); a cluster has none that all machines share, so
    that is an error.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postline-checkpoints-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, wherever that is kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that a job writes to the shared folder for itself: ``cut`` writes one, ``free`` deletes some, and leaving the
    ``with`` block deletes all that weren't kept. Shuffles of freed tables go with the next collection of garbage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.names: dict[str, str] = {}  # of tables in buckets, by path

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.free(*[df for df, _ in self.paths.values()])

    def cut(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """df, written once as a compressed table, so that no later step computes it again or needs its lineage. by: columns, the
        last ones of df, whose values have a folder each."""
        path = shared_path(self.spark, "cut")
        df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def bucketed(self, parts: list[DataFrame], key: str) -> DataFrame:
        """The rows of all parts, written once in buckets of ``key``, as many as there are shuffle partitions: joins by it don't move
        these rows again. The shuffle behind a part goes before the next part's."""
        path = shared_path(self.spark, "bucketed")
        name = self.names[path] = path.rsplit("/", 1)[1].replace("-", "_")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for part in parts:
            part.write.mode("append").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(name)
            self.free()
        out = self.spark.table(name)
        self.paths[id(out)] = out, path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a table of this scratch, which the caller's result still reads."""
        self.paths.pop(id(df))
        return df

    def free(self, *dfs: DataFrame) -> None:
        """Deletes tables that nothing reads any more; without any, lets go of the shuffles behind tables that were written."""
        for df in dfs:
            path = self.paths.pop(id(df))[1]
            if path in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(path)}")
            remove(self.spark, path)
        self.spark.sql("SELECT 1").collect()  # Spark's listeners hold the last query that ended, and by it its shuffles, until another comes
        self.spark._jvm.System.gc()  # lets the driver tell executors which shuffles nobody can read any more


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once; the table stays, for results that read it later."""
    scratch = Scratch(df.sparkSession)
    return scratch.keep(scratch.cut(df))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, nothing else: ``lower`` would change other letters as well."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(col: Column, modulo: int) -> Column:
    """crc32 of the value as text, modulo ``modulo``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulo)

"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, in local mode only, one of this process (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, conf, True)
    spark.sparkContext.setCheckpointDir(conf)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, for tables that are small beside the input.

    Spark hands the estimated size of a plan on to its checkpoint, and joins
    multiply sizes, so in rounds of joins the estimate's digits double until
    planning never ends; the rows are therefore taken up without it.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete the tables that ``written`` has made in this process; call it when no result that reads them is needed any more."""
    while _written:
        _delete(spark, _written[-1])


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.remove(name)


def drop(df: DataFrame) -> None:
    """Delete one written table whose readers have all been written themselves."""
    _delete(df.sparkSession, df.lodestone_path)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through compressed Parquet in the shared folder, for tables that grow with the texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are over. The driver holds on to the last query until another one runs, hence the empty one."""
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

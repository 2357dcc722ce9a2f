"""What several operators need."""

from __future__ import annotations

import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is named, as in tests, a temporary one of the only machine; a
    cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="terrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim(spark: SparkSession) -> str | None:
    """Returns to the system what the driver's JVM has freed outside its heap, most of it by its compilers, which the C library
    keeps otherwise. What the JVM says of it; None from a JVM that has no such command (before 17.0.9, or not on Linux)."""
    sc = spark.sparkContext
    lang, management, of = sc._jvm.java.lang, sc._jvm.javax.management, sc._jvm.java.lang.Class.forName

    def array(kind, *values):
        out = sc._gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    try:
        # by the interface's method, since the server's class isn't public
        kinds = map(of, ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"])
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *kinds))
        name = management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JError:
        return None


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in files that outlive executors. Shuffle files that only the cut lineage needed stay on the
    executors' disks until the driver collects its garbage, which a driver with little to do puts off, so it is asked to, and
    to return what it has freed."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    trim(df.sparkSession)
    return out


#: Keys that join_hot() joins by broadcast.
HOT = 256


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], size: str, spread: list[str], how: str = "inner") -> DataFrame:
    """big with the columns of small, which has one row a key and has in ``size`` about how many rows of big it meets. The ``HOT``
    largest keys, a fixed number of rows, are joined by broadcast, and their rows of big are dealt by ``spread``; each other
    key has less than 1 / HOT of the rows, and goes by shuffle. how: inner or left."""
    values = [c for c in small.columns if c not in keys]
    top = small.orderBy(F.desc(size), *keys).limit(HOT).select(*keys, F.struct(*values).alias("__hot"))
    j = big.join(F.broadcast(top), keys, "left")
    j = j.withColumn("__deal", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0))
    none = F.when(F.col(size) < 0, 1).otherwise(0)  # 0, which the optimizer must not know, else it takes __deal out of the keys
    j = j.join(small.select(*keys, none.alias("__deal"), F.struct(*values).alias("__cold")), [*keys, "__deal"], "left")
    j = j.withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        j = j.where("__found is not null")
    return j.select(*big.columns, *(F.col(f"__found.{c}").alias(c) for c in values))


def finite_vector(c: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(c) > 0) & ok, F.lit(False))

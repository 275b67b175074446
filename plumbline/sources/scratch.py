"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Without native code, Hadoop's local file system starts a `chmod` for every file and folder it makes, and until such a
#: helper runs it holds all memory of its JVM once more.  The raw one, without checksum files, starts two for the part
#: of a task instead of five.  Nobody looks for `_SUCCESS`.  Paths of other file systems do not see the first options.
WRITING = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

#: The name of `System.trim_native_heap` as a bean's operation.
COMMAND = "systemTrimNativeHeap"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a folder of its own; on a
    cluster that is an error, since executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    named = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def app_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; all of them go when the driver ends."""
    fs, at = file_system(spark, app_dir(spark))
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{app_dir(spark)}/{uuid.uuid4().hex}-{name}"


def trim(spark: SparkSession) -> str:
    """Gives native memory that the driver's JVM has freed back to the system; what the JVM says to that, empty if it cannot.

    Planning and shuffles free it in some hundred threads, and the C library
    keeps it for each of them.  Only the JVM's own command `System.trim_native_heap` reaches it; by
    reflection, since the bean's class is not public.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        values[0], values[1] = bean, COMMAND
        return str(named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values))
    except Py4JError:  # another JVM, or another C library
        return ""


def shrink(spark: SparkSession) -> bool:
    """Has the driver's JVM collect its garbage where its heap has grown beyond half of what it may have; whether it did.

    Most of such a heap is what planning and the events of tasks left behind.  A full collection gives the free part
    back to the system, which the JVM does not do by itself, and lets Spark drop the broadcasts and shuffles that
    nothing refers to.  A heap of fixed size gives nothing back.
    """
    heap = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    grown = heap.getInit() < heap.getMax() < 2 * heap.getCommitted()
    if grown:
        spark.sparkContext._jvm.System.gc()
    return grown


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and a lost executor costs a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**WRITING).option("compression", "zstd").parquet(path)
    shrink(df.sparkSession)
    trim(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)

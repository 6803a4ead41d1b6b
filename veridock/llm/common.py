"""What the training-data operators share: columns, words, shared storage.

Row identity. ``doc_id`` may repeat or be null, so operators that shuffle facts
about a document key them by ``(doc_id, xxhash64(text))``: rows that repeat both
are one document and get the same answer on each row.
"""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of digits, a-z and anything outside ASCII, after lower-casing A-Z only.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A side is broadcast only below both of these measured sizes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=source`` columns by exact name and position.

    Extra columns never matter, also when they differ from a wanted one in case
    only or repeat its name (the first one counts).
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(src)}").alias(new) for new, src in columns.items()])


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def word_array(col: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(col), BETWEEN), "")


def by_position(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under the column names c0, c1, ... and the new name of each column (of repeated names the first).

    Operators that give all columns back work on these names, so names that
    differ in case only, repeat, or look like an operator's own can't clash.
    ``docs.columns`` in order are what ``back`` restores.
    """
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}


def back(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns c0, c1, ... under their own names again; others go."""
    return df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode, where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="veridock-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder and read it back.

    The table survives lost executors; ``drop_table`` removes it, at the latest the
    end of the application does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridock/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    release_shuffles(spark)
    return table


def drop_table(*tables: DataFrame) -> None:
    """Remove tables of ``write_table`` that nothing unwritten depends on any more."""
    for table in tables:
        spark = table.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice that finished jobs' shuffles aren't referred to, so executors delete their files now and not in half an hour."""
    spark._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Give memory that the driver's JVM has freed outside its heap back to the system; False where its JVM has no such command.

    Planning and compiling leave the C library with hundreds of freed MB that it
    keeps otherwise. The command is ``jcmd``'s System.trim_native_heap, asked of
    the driver by JMX; the method is taken from the public interface, as the
    server's own class isn't open to callers.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array

    def of(kind, *values):
        out = array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    try:
        none = of(jvm.Object), of(jvm.String)
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", of(jvm.Class, *map(jvm.Class.forName, types)))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, of(jvm.Object, name, "systemTrimNativeHeap", *none))
    except Py4JError:
        return False
    return True


#: A group of any size is dealt into so many parts before it is aggregated or joined.
SALTS = 64


def join_groups(df: DataFrame, keys: list[str], unit: str, partial: list[Column], whole: list[Column], having: str = "true") -> DataFrame:
    """The rows with the aggregates of their group, of groups for which ``having`` holds.

    ``partial`` aggregates rows, ``whole`` what ``partial`` gave. A group is dealt
    by a hash of column ``unit`` into parts, for aggregation and for the join
    back, so no task gets all rows of a hot key.
    """
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(unit), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "salt_").agg(*partial)
    groups = parts.groupBy(*keys).agg(*whole, F.collect_set("salt_").alias("salts_")).where(having)
    dealt = groups.withColumn("salt_", F.explode("salts_")).drop("salts_")
    return salted.join(dealt.hint("merge"), [*keys, "salt_"]).drop("salt_")


def join_hot(df: DataFrame, key: str | list[str], unit: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined with the one row of ``table`` for each key, where many rows of ``df`` may share a key.

    Parts of a key, dealt by a hash of column ``unit``, fetch its row once each.
    """
    keys = [key] if isinstance(key, str) else key
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(unit), F.lit(SALTS)))
    found = salted.select(*keys, "salt_").distinct().join(table.hint("merge"), keys)
    return salted.join(found.hint("merge"), [*keys, "salt_"], how).drop("salt_")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables that are used again."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint()
    release_shuffles(df.sparkSession)
    return kept


def broadcast_if_small(df: DataFrame, size: Column | None = None) -> tuple[DataFrame, bool]:
    """Broadcast hint only after measuring rows and bytes (``size``: bytes of a row)."""
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size if size is not None else F.lit(64))).first()
    small = rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def name_by_sort(keys: DataFrame, *columns: str, name: str = "name") -> DataFrame:
    """Sort distinct keys and give each an integer name that follows that order.

    The result is checkpointed: names stay the same when a task is run again.
    """
    ordered = keys.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return checkpoint(ordered.withColumn(name, F.monotonically_increasing_id()))

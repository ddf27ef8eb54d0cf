"""What the operators share: reading tables, durable intermediate tables, fold rules, ranks at scale."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, as in tests, a temporary folder
    is made, but only on a local master: on a cluster a machine's own folder would lose data.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark deletes the shuffles and broadcasts of frames that are gone only then, and
    the plans of many small jobs would else fill the driver's heap before what follows needs memory beside it."""
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession, command: str = "systemTrimNativeHeap") -> bool:
    """Give memory that the driver's JVM has freed outside its heap back to the system; whether it could.

    Spark starts a thread for every exchange, and the C library keeps what each of them, the compiler and the
    collector have freed: over the stages of a pipeline some hundred MB. Not every JVM has the command."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    given = new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), command
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the public interface, as the server's own class is closed to reflection
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, given)
    except Py4JJavaError:
        return False
    return True


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts the lineage, is computed once,
    and survives the loss of executors. ``drop`` and ``release`` delete those that nothing reads any more; what a
    returned frame still reads stays until its owner deletes the folder ``top``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` once and return (the table read back, its path)."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((found, path))
        return found, path

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the table read back."""
        return self.keep(df)[0]

    def drop(self, *paths: str) -> None:
        """Delete tables that are no longer read."""
        jvm = self.spark._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.held = [(df, path) for df, path in self.held if path not in paths]

    def release(self, *needed: DataFrame) -> None:
        """Delete all tables but those needed."""
        self.drop(*(path for df, path in self.held if not any(df is n for n in needed)))


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def offsets(counted: DataFrame, key: str, sub: str, size: str, out: str) -> DataFrame:
    """For each (key, sub) the sum of ``size`` over the smaller subs of the same key.

    ``counted`` holds one row per (key, sub); subs are few per key, so the window is small."""
    w = Window.partitionBy(key).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(key, sub, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias(out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, per_class: int, longest: int, id_col: str = "doc_id", text_col: str = "text", more: Column | None = None) -> tuple[list[tuple], dict[int, int]]:
    """A bounded sample of labelled texts on the driver, as (text, label) or, with the column ``more``, (text, label,
    more); and the number of allowed labels per class.

    The ids are drawn from the label table alone, ``per_class`` of each class by a hash order, so that the
    list of ids is bounded and the texts need no shuffle. Texts over ``longest`` characters are left out of
    the sample (of training only), so the sample holds ``2 * per_class * longest`` characters at most.
    Null labels count as none. Ids that are labelled twice with different classes are left out. Of several
    rows under one id the first in the order of texts counts.
    """
    given = labels.where(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    each = given.groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")).where("label = other").drop("other")
    counts = {r.label: r.n for r in each.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = [r for y in (0, 1) for r in each.where(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class).collect()]
    if not picks:
        return [], counts
    wanted = docs.sparkSession.createDataFrame(picks, each.schema)
    text = F.col(text_col).cast("string")
    row = F.struct(text.alias("text"), (F.lit(None).cast("long") if more is None else more).alias("more"))
    found = docs.where(F.length(text) <= longest).select(F.col(id_col), row.alias("_row")).join(F.broadcast(wanted), id_col)
    found = found.groupBy(id_col).agg(F.min("_row").alias("_row"), F.first("label").alias("label")).orderBy(F.xxhash64(id_col), id_col)
    rows = found.select("_row.text", "label", "_row.more").collect()
    return [(r.text, r.label, r.more)[: 2 + (more is not None)] for r in rows], counts

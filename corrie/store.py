"""Tables in the shared folder: they cut the lineage of iterations and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Applications whose Python workers have the library.
shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this library's modules, once for each application."""
    context = spark.sparkContext
    if context.applicationId in shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="modules-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as box:
        for module in sorted(root.rglob("*.py")):
            box.write(module, module.relative_to(root.parent))
    context.addPyFile(str(path))
    shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only in local mode, where one machine does it all, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = current.get()
    return configured.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The table, written once and read from there."""
    path = f"{shared_dir(df.sparkSession)}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept(list):
    """Tables written for one owner, who can delete their files."""

    def __call__(self, df: DataFrame) -> DataFrame:
        table = stored(df)
        self.append(table)
        return table

    def drop(self) -> None:
        while self:
            table = self.pop()
            for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                removed(table.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add consecutive numbers from 0 in the given order, without one task for all rows.

    Rows are dealt by ranges and written; the counts of the parts, one for each partition, go to the driver.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    base, total = {}, 0
    for part, n in counts:
        base[part] = total
        total += n
    if not base:
        return parts.drop("_part").withColumn(name, F.lit(0).cast("long"))
    spark = df.sparkSession
    bases = spark.createDataFrame([(p, b) for p, b in base.items()], "_part int, _base long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + place - 1).drop("_part", "_base")

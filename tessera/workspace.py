"""Where stage tables are written.

A stage that is read by several later stages is written once as parquet to the
shared folder named by ``spark.checkpoint.dir`` and read back from there. The
written table cuts the lineage, survives lost executors, and gives the next
stage column pruning, filter pushdown and real size statistics for the
automatic broadcast decision.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names. Where none is named, a folder in the warehouse, which
    all executors share as well."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages").rstrip("/")


class Workspace:
    """Stage tables of one run. Every table gets a path of its own, so a table that
    is built again never pulls the files from under a plan that reads the first one."""

    def __init__(self, spark: SparkSession, run: str, root: str | None = None) -> None:
        self.spark = spark
        self.root = f"{root or shared_folder(spark)}/tessera/{run}"
        self._made = itertools.count()

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._made):05d}-{name}"

    def store(self, name: str, df: DataFrame) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the run's stage tables, once no plan reads them any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

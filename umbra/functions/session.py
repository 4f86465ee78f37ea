"""What a session needs before the package's functions run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once a Spark application, so that Python workers can import them wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="umbra-")) / "umbra_modules.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="umbra-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/umbra-{spark.sparkContext.applicationId}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes from fewer files than there are cores; tables of many files stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

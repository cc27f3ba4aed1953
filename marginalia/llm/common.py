"""What the operators share: tables, the shared folder, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting for the bytes of an Arrow batch, and its value for the jobs of this package.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application: they may
    have neither the driver's working directory nor its search path."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="marginalia-")).resolve() / "marginalia_package.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(made))
    sc._marginalia_shipped = True
    # A batch of rows with long texts is cut by its bytes, whatever number of rows it has.
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session whose
    executors are threads of the driver gets a folder of its own; any other one is refused,
    as its executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages start
    from files that survive the loss of executors. Removed when the driver ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is going down; the folder's owner clears it
        return


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """Run make()(batch) over Arrow batches; each result is a dict of columns."""
    ship(df.sparkSession)
    target = F.from_json(F.lit("{}"), schema)  # parses the DDL in the JVM only
    struct = df.sparkSession.range(0).select(target.alias("x")).schema["x"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for cols in work(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:  # the worker lives on for other tasks
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, struct)


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]

"""What earlier runs found, and baselines of a voice: tables behind a pointer file.

Each save writes a table of its own into a new folder and then moves a small pointer file
over the last one, in one step. Who reads sees the old table or the new one as a whole,
whatever fails in between; a save that was cut short leaves a folder that nothing names."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as G
from . import runner

#: The rule by which findings get their keys; runs of another one can't be compared.
KEY_VERSION = 1
RUNS = "last-run"


class Shelf:
    """Named tables in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("x").getFileSystem(self.conf)

    def save(self, name: str, table: DataFrame, **facts) -> None:
        """Write the table and make it the current one of this name; facts go into its pointer."""
        made = f"{name}-{uuid.uuid4().hex}"
        table.write.option("compression", "zstd").parquet(f"{self.path}/{made}")
        fresh, current = self._at(f".{made}.json"), self._at(f"{name}.json")
        out = self._files().create(fresh, True)
        try:
            out.write(bytearray(json.dumps({"table": made, **facts}, sort_keys=True), "utf-8"))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.conf).rename(fresh, current, how)

    def facts(self, name: str) -> dict | None:
        """What the current pointer says; None where there is none or it can't be read."""
        current = self._at(f"{name}.json")
        if not self._files().exists(current):
            return None
        stream = self._files().open(current)
        try:
            said = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "ChecksumException":
                raise
            return None  # damaged
        finally:
            stream.close()
        return said if isinstance(said, dict) and isinstance(said.get("table"), str) else None

    def load(self, name: str) -> DataFrame | None:
        """The current table; None where there is none, or its pointer is damaged or names a folder that is gone."""
        said = self.facts(name)
        if said is None or not self._files().exists(self._at(f"{said['table']}/_SUCCESS")):
            return None
        return self.spark.read.parquet(f"{self.path}/{said['table']}")


def remember(shelf: Shelf, findings: DataFrame, at: str = "") -> None:
    """Keep a run's keys and titles, no more: what the next run needs to tell old from new."""
    shelf.save(RUNS, findings.groupBy("key").agg(F.min("title").alias("title")), version=KEY_VERSION, at=at)


def previous(shelf: Shelf) -> DataFrame | None:
    """(key, title) of the last run; None without one that these keys can be compared with."""
    said = shelf.facts(RUNS)
    return shelf.load(RUNS) if said and said.get("version") == KEY_VERSION else None


@dataclass
class Compared:
    report: runner.Report
    states: DataFrame  # key, title, state: fresh, shown, hidden or gone
    first: bool  # nothing to compare with: all that isn't hidden is shown


def compared(ctx: runner.Context, shelf: Shelf, dismissed: DataFrame | None = None, at: str = "", **options) -> Compared:
    """Run the checks, tell what is new and what is gone since the run before, and remember this one.

    A run in which a check failed is compared over the checks that ran, and isn't remembered:
    what the failed check would find must not look new the next time."""
    report = runner.run(ctx, **options)
    spark = ctx.located.sparkSession
    if report.findings is None:
        raise RuntimeError("no check ran: " + "; ".join(f"{k}: {v}" for k, v in report.failed.items()))
    now = runner.leaf(report.findings.groupBy("key").agg(F.min("title").alias("title")))
    none = spark.createDataFrame([], "key string, title string")
    last = previous(shelf)
    first = last is None
    # Read before the new run is saved: the last table stays where it is.
    last = now if first else runner.leaf(last)
    states = G.triage(now, last, dismissed if dismissed is not None else none)
    titles = now.withColumn("_o", F.lit(0)).unionByName(last.withColumn("_o", F.lit(1))).groupBy("key").agg(F.min_by("title", "_o").alias("title"))
    states = runner.leaf(states.join(titles, "key").select("key", "title", "state"))
    if not report.failed:
        remember(shelf, now, at)
    return Compared(report, states, first)


def save_baseline(shelf: Shelf, name: str, fingerprint: DataFrame, fitted_on: str = "") -> None:
    """Keep a fingerprint under a name."""
    shelf.save(f"baseline-{name}", fingerprint, fitted_on=fitted_on)


def load_baseline(shelf: Shelf, name: str) -> DataFrame | None:
    return shelf.load(f"baseline-{name}")

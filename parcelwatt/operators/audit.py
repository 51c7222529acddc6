"""Run audit: one row per job, counted while the data is written."""

from __future__ import annotations

import json
from contextlib import contextmanager
from datetime import datetime, timezone
from threading import Thread

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

SCHEMA = (
    "run_id string, run_type string, params string, started_at timestamp, ended_at timestamp, "
    "rows_upserted long, rows_skipped long, rows_failed long, status string, error_message string"
)


class Run:
    """Collects the row counts of the frames passed through ``watch``."""

    def __init__(self, run_type: str, params: dict, wait: float = 30.0):
        self.run_type, self.params, self.wait, self._seen = run_type, params, wait, {}

    def watch(self, df: DataFrame, kind: str = "upserted") -> DataFrame:
        """Count rows of ``df`` as it is written; ``kind``: upserted, skipped or failed."""
        seen = Observation(f"{self.run_type}_{kind}")
        self._seen[kind] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def counts(self, *kinds: str) -> list[int | None]:
        """Rows counted of each kind; null for a frame that was never written, known after ``wait`` seconds."""
        found: dict[str, int] = {}

        def read(kind: str) -> None:
            found[kind] = self._seen[kind].get["n"]

        # an observation without an action blocks for ever, so it is read beside the job
        readers = [Thread(target=read, args=(k,), daemon=True) for k in kinds if k in self._seen]
        for reader in readers:
            reader.start()
        for reader in readers:
            reader.join(self.wait)
        return [found.get(k) for k in kinds]


@contextmanager
def record(spark: SparkSession, path: str, run_type: str, params: dict | None = None, clock=lambda: datetime.now(timezone.utc), wait: float = 30.0):
    """Append one audit row to ``path`` when the block ends, also when it fails."""
    run, started = Run(run_type, params or {}, wait), clock()
    status, message = "success", None
    try:
        yield run
    except Exception as error:
        status, message = "failed", str(error)[:1000]
        raise
    finally:
        text = json.dumps(run.params, sort_keys=True, default=str)
        row = (None, run_type, text, started, clock(), *run.counts("upserted", "skipped", "failed"), status, message)
        frame = spark.createDataFrame([row], SCHEMA).withColumn(
            "run_id", F.sha2(F.concat_ws("|", "run_type", "params", F.col("started_at").cast("string")), 256)
        )
        frame.coalesce(1).write.mode("append").parquet(path)

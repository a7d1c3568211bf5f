"""Session defaults, the shared checkpoint folder, deadlines and counts."""
from __future__ import annotations

import contextlib
import json
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library is tested with."""
    builder = (
        SparkSession.builder.master(master)
        .appName("engram")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only where none is set (tests), make one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="engram-ckpt-"))


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[dict]:
    """Jobs that start inside are cancelled when the time is up. Yields a record: expired tells whether that came about; the error that
    the cancelled job raised is then swallowed, so that a step that is too slow is one without a result."""
    group, record = uuid.uuid4().hex, {"expired": False, "seconds": 0.0}
    context, began = spark.sparkContext, time.monotonic()

    def stop() -> None:
        record["expired"] = True
        context.cancelJobGroup(group)

    timer = threading.Timer(max(0.0, seconds), stop)
    context.setJobGroup(group, "with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        yield record
    except Exception:
        if not record["expired"]:
            raise
    finally:
        timer.cancel()
        record["seconds"] = time.monotonic() - began
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def metered(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and counts that are known once an action has read them: numbers of a step, never its content."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), seen


def log_line(event: str, **numbers: float) -> str:
    """A line of JSON for a log; texts other than the event's name are refused."""
    if bad := [n for n, v in numbers.items() if not isinstance(v, (int, float))]:
        raise TypeError(f"{bad} are no numbers")
    return json.dumps({"event": event, **numbers}, sort_keys=True)

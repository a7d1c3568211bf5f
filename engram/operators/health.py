"""Load control: sliding figures per scope, and the mode they lead to."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fixed values of the guard.
WINDOW, SLOW_ENTER, SLOW_EXIT, SKIP, HEALTHY, STREAK = 50, 0.2, 0.1, 0.8, 0.6, 10
FULL, LITE, LEX_ONLY = "full", "extract_lite", "lex_only"


def figures(samples: DataFrame, budget: float) -> DataFrame:
    """samples: scope, seq, elapsed, overran. Adds slow_ratio and p50 (the upper median) of the last WINDOW samples."""
    w = Window.partitionBy("scope").orderBy("seq").rowsBetween(-(WINDOW - 1), 0)
    slow = (F.col("overran") | (F.col("elapsed") > budget)).cast("int")
    ordered = F.array_sort(F.collect_list("elapsed").over(w))
    return samples.withColumn("slow_ratio", F.avg(slow).over(w)).withColumn("p50", F.element_at(ordered, (F.size(ordered) / 2).cast("int") + 1))


class Guard:
    """The mode after each sample of one scope."""

    def __init__(self, budget: float, window: int = WINDOW, streak: int = STREAK):
        self.budget, self.streak, self.healthy, self.mode = budget, streak, 0, FULL
        self.samples: deque[tuple[float, bool]] = deque(maxlen=window)

    def observe(self, elapsed: float, overran: bool) -> str:
        self.samples.append((elapsed, overran or elapsed > self.budget))
        slow = sum(s for _, s in self.samples) / len(self.samples)
        near = sorted(e for e, _ in self.samples)[len(self.samples) // 2] / self.budget if self.budget > 0 else 1.0
        if near > SKIP or slow > SLOW_ENTER:
            self.mode, self.healthy = (LEX_ONLY if near > SKIP else LITE), 0
        elif slow < SLOW_EXIT and near < HEALTHY:
            self.healthy += 1
            self.mode = FULL if self.healthy >= self.streak else (LITE if self.mode == LEX_ONLY else self.mode)
        return self.mode


def modes(samples: DataFrame, budget: float) -> DataFrame:
    """samples: scope, seq, elapsed, overran. Adds mode. Rows stream by in order of (scope, seq); a task holds the state of one
    scope at a time, whatever the length of its history."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, guard = object(), None
        for batch in batches:
            out = []
            for s, elapsed, overran in zip(*(batch.column(c).to_pylist() for c in ("scope", "elapsed", "overran"))):
                if guard is None or s != scope:
                    scope, guard = s, Guard(budget)
                out.append(guard.observe(elapsed or 0.0, bool(overran)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "mode"])

    return samples.repartition("scope").sortWithinPartitions("scope", "seq").mapInArrow(each, T.StructType([*samples.schema.fields, T.StructField("mode", T.StringType())]))

"""What the operators of this subpackage share."""
from __future__ import annotations

import base64
import ctypes
import functools
import gc
import time
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.session import ensure_checkpoint_dir

#: A word: a run of anything but blank and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def kept(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that later stages survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Some 20 MB as a hashed relation.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(narrow: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """narrow (a kept table), to be broadcast if its rows are counted and few, and their values as text are measured and short; else
    as it is, for a shuffle join."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in narrow.columns]))))
    rows, length = narrow.limit(most_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(narrow) if rows <= most_rows and (length or 0) <= most_bytes else narrow


def aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under names that clash with nothing, and a function that selects the columns of docs
    from a table with those and gives them their names back."""
    names = [c if c in used else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda rows: rows.select(*names).toDF(*docs.columns)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished stages now: Spark deletes them when the driver's JVM collects its garbage, which
    may be long after a checkpoint has made them useless. The first round frees what Python holds in the JVM, the later ones
    what that held."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def kept_alone(df: DataFrame) -> DataFrame:
    """kept(df), with the shuffle files that it was made from deleted at once, whenever the JVM collects its garbage. Only for a df
    that is not computed again."""
    out = kept(df)
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":  # another plan doesn't list its shuffles
        release(df.sparkSession)
        return out
    files = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
    for shuffle in list(plan.context().shuffleIds().keySet()):
        try:
            files.removeShuffle(shuffle, True)
        except Py4JJavaError:  # an executor went meanwhile; what others hold goes when Spark's cleaner finds it
            pass
    return out


def fold_of(doc_id, folds: int) -> int:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % folds


def fold_column(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def tokenizer_path(name: str) -> str:
    """The default place of a public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def trim() -> None:
    """Give memory that a task has freed back to the system: idle workers stay beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows whose values are Python objects at a time.
STEP_ROWS = 256
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def with_computed(rows: DataFrame, inputs: tuple[str, ...], start: Callable[[], Callable[..., tuple]], new: dict[str, str], without: tuple[str, ...] = ()) -> DataFrame:
    """rows with the columns `new` (name to type) added, whose names must be free. start runs once in each task and returns a function
    from the lists of the inputs' values to the new columns' values; the other columns pass through as they are, but for those in
    `without`, which don't travel back from Python."""
    if taken := set(new) & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} exist already")
    at = [rows.columns.index(c) for c in inputs]
    stay = [i for i, c in enumerate(rows.columns) if c not in without]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for whole in batches:
            for start_row in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(start_row, STEP_ROWS)
                found = compute(*[batch.column(i).to_pylist() for i in at])
                columns = [pa.array(v, ARROW[t]) for v, t in zip(found, new.values())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *columns], names=[*(batch.schema.names[i] for i in stay), *new])
        del compute
        trim()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields if f.name not in without] + [T.StructField(c, T._parse_datatype_string(t), True) for c, t in new.items()])
    return rows.mapInArrow(each, schema)

"""Readers and writers: tables, legacy vector lines, publications with a manifest."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 9
#: Times come as variants, so that validation can tell a number from a text.
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("timestamp", T.VariantType())]))
ADD_REQUEST = T.StructType([T.StructField(c, T.StringType()) for c in ("request_id", "user_id", "session_id")] + [T.StructField("messages", MESSAGES)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a task's share of an input, below which more tasks only cost.
SHARE_BYTES = 1 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """rows read from files, dealt over the cores if the files are small: a file of one row group is one task, however many cores
    there are. Larger inputs have row groups enough and stay as they are."""
    context = rows.sparkSession.sparkContext
    cores, path = context.defaultParallelism, context._jvm.org.apache.hadoop.fs.Path
    files = rows.inputFiles()
    if not files or len(files) >= cores:
        return rows
    hadoop = context._jsc.hadoopConfiguration()
    size = sum(path(f).getFileSystem(hadoop).getFileStatus(path(f)).getLen() for f in files)
    tasks = min(cores, size // SHARE_BYTES)
    return rows.repartition(int(tasks)) if tasks > 1 and size < cores * SHARE_BYTES * 64 else rows


def add_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of Add requests; malformed lines give rows of nulls, which validation rejects."""
    return spark.read.schema(ADD_REQUEST).json(path, mode="PERMISSIVE")


def add_request_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ADD_REQUEST).json(path)


def vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """Legacy {"k", "v"} lines of one file or folder: key, vector. Lines that aren't such are passed over; of a key's lines the last wins."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("at"))
    parsed = lines.select(F.from_json("value", "k string, v array<double>", {"mode": "PERMISSIVE"}).alias("j"), "at")
    good = parsed.where(F.col("j.k").isNotNull() & F.col("j.v").isNotNull() & ~F.exists("j.v", lambda x: x.isNull()))
    return good.groupBy(F.col("j.k").alias("key")).agg(F.max_by("j.v", "at").alias("vector"))


def response_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON document per row, without null fields."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("json"))


class Publications:
    """Tables that are replaced as a whole, or added to: files of a publication are written first, then a manifest that names each
    table's publications replaces the live one in a single rename. Readers resolve the manifest once, so they see one state of all
    tables. Paths go through Hadoop's file systems, so any store that Spark reads will do. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        at = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(at):
            return {"schema_version": SCHEMA_VERSION, "tables": {}}
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).collect()))
        if found.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {found.get('schema_version')}, not {SCHEMA_VERSION}")
        return found

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write the tables under one publication and make them live together."""
        return self._make_live(tables, uuid.uuid4().hex, replace=True)

    def append(self, tables: dict[str, DataFrame], publication: str) -> str:
        """Add rows to tables, all of them together. A publication of the same name (a batch that is tried again) is written anew and counts
        once."""
        return self._make_live(tables, publication, replace=False)

    def once(self, marker: str, tables: dict[str, DataFrame]) -> bool:
        """append() for an import that may happen once only; whether it has happened now."""
        if marker in self.manifest().get("imports", []):
            return False
        self._make_live(tables, f"import-{marker}", replace=False, marker=marker)
        return True

    def _make_live(self, tables: dict[str, DataFrame], publication: str, replace: bool, marker: str | None = None) -> str:
        live = self.manifest()
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/pub={publication}")
            before = [] if replace else live["tables"].get(name, [])
            live["tables"][name] = [*(p for p in before if p != publication), publication]
        if marker:
            live["imports"] = [*live.get("imports", []), marker]
        self._swap(live)
        return publication

    def stamp(self, version: int) -> None:
        """Give the store another schema version: the last step of a migration, behind which older readers refuse it."""
        self._swap(self.manifest() | {"schema_version": version})

    def _swap(self, live: dict) -> None:
        staged, target = self._path(f"{self.root}/manifest.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(live).encode()))
        out.close()
        self._replace(staged, target)

    def _replace(self, staged, target) -> None:
        """One rename over what is there, so that readers find the old manifest or the new one."""
        context, hadoop = self.spark.sparkContext, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        how = context._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(staged), self._fs.makeQualified(target), how)

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        live = (manifest or self.manifest())["tables"]
        if name not in live:
            raise KeyError(name)
        return self.spark.read.parquet(*[f"{self.root}/{name}/pub={p}" for p in live[name]])

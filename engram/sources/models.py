"""Models behind tables: embedders, writers of answers, rerankers. A model is any function that a worker can call; what fails is absent
(or null) and leaves the order of results as it was, so results stay reproducible from the tables.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.operators import retrieval

Embed = Callable[[list[str]], list[list[float]] | None]
Complete = Callable[[str], str | None]
RESULT = "array<struct<index:int,relevance_score:double,score:double>>"
BATCH = 64


def hashed_embedder(dim: int = 64) -> Embed:
    """A local embedder without a model: signed hashes of words, to unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                row[h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1.0)).tolist()

    return embed


def cache_key(text: Column, model: str, dim: int) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(dim)), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def missing_vectors(items: DataFrame, cache: DataFrame, embed: Embed, model: str, dim: int) -> DataFrame:
    """items: item_id, text; cache: key, vec. The entries (key, vec) that the cache lacks, each text embedded once; a failed batch,
    or a vector of another length, gives none."""
    wanted = items.select(cache_key(F.col("text"), model, dim).alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                try:
                    vectors = embed(part["text"].tolist())
                except Exception:  # a model that can't be reached is one without vectors
                    vectors = None
                if vectors is not None and len(vectors) == len(part):
                    good = [(k, v) for k, v in zip(part["key"], vectors) if v is not None and len(v) == dim]
                    yield pd.DataFrame(good, columns=["key", "vec"])

    return wanted.mapInPandas(each, "key string, vec array<double>")


def vectors(items: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """item_id, vec: the items whose text the cache holds; of repeated keys one entry counts."""
    held = cache.groupBy("key").agg(F.min("vec").alias("vec"))
    return items.select("item_id", cache_key(F.col("text"), model, dim).alias("key")).join(held, "key").select("item_id", "vec")


def answers(prompts: DataFrame, complete: Complete, attempts: int = 2) -> DataFrame:
    """prompts: prompt_id, prompt. Adds answer: the first that isn't empty, null after `attempts` without one."""
    id_type = prompts.schema["prompt_id"].dataType.simpleString()

    def ask(prompt: str) -> str | None:
        for _ in range(attempts):
            try:
                if said := complete(prompt):
                    return said
            except Exception:  # as for vectors
                continue
        return None

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=[ask(p or "") for p in frame["prompt"]])

    return prompts.select("prompt_id", "prompt").mapInPandas(each, f"prompt_id {id_type}, prompt string, answer string")


def repaired(prompts: DataFrame, complete: Complete, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """prompts: prompt_id, prompt; check: from (prompt_id, answer) to (prompt_id, notes) of those that are refused. Adds answer and calls: an
    answer that is refused is asked for once more, with the notes behind the prompt, and the second answer counts."""
    first = retrieval.kept(answers(prompts, complete, attempts=1))
    refused = retrieval.kept(check(first.select("prompt_id", "answer")).select("prompt_id", "notes"))
    again = first.join(refused, "prompt_id").select("prompt_id", F.concat("prompt", F.lit("\n"), "notes").alias("prompt"))
    second = answers(again, complete, attempts=1).select("prompt_id", F.col("answer").alias("_second"), F.lit(2).alias("_calls"))
    return first.join(second, "prompt_id", "left").select("prompt_id", "prompt", F.when(F.col("_calls") == 2, F.col("_second")).otherwise(F.col("answer")).alias("answer"), F.coalesce("_calls", F.lit(1)).alias("calls"))


def limited(prompts: DataFrame, models: int) -> DataFrame:
    """prompts in at most so many partitions: no more calls run at a time, however many cores there are."""
    return prompts.coalesce(models) if prompts.rdd.getNumPartitions() > models else prompts


def unjudged(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """requests: query_id, request (all that a judge is told); verdicts: key of those judged before. Adds key; requests whose verdicts
    are known go."""
    keyed = requests.withColumn("key", F.sha2(F.col("request").cast("binary"), 256))
    return keyed.join(verdicts.select("key").distinct(), "key", "left_anti")


def rerank_scores(response: Column, documents: Column) -> Column:
    """A reranker's response (either dialect: results, or output.results) as a map of position to score between 0 and 1; null unless
    each of `documents` positions has a score."""
    parsed = F.from_json(response, f"output struct<results:{RESULT}>, results {RESULT}")
    rows = F.transform(F.coalesce(parsed["output"]["results"], parsed["results"]), lambda r: F.struct(r["index"].alias("index"), F.coalesce(r["relevance_score"], r["score"]).alias("score")))
    rows = F.filter(rows, lambda r: r["index"].between(0, documents - 1) & r["score"].isNotNull())
    whole = (F.size(rows) == documents) & (F.size(F.array_distinct(F.transform(rows, lambda r: r["index"]))) == documents)
    return F.when(whole, F.map_from_entries(F.transform(rows, lambda r: F.struct(r["index"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["score"]))))))


def _json_in(answer: str | None) -> str | None:
    body = (answer or "").strip()
    rows = body.splitlines()
    if body.startswith("```") and len(rows) >= 3:
        body = "\n".join(rows[1:-1] if rows[-1].strip().startswith("```") else rows[1:]).strip()
    for text in (body, *(body[body.find(a) : body.rfind(b) + 1] for a, b in ("{}", "[]") if a in body)):
        try:
            json.loads(text)
            return text
        except ValueError:
            continue
    return None


def loose_json(answer: Column) -> Column:
    """The JSON text in an answer: the whole, or what a fence holds, or from the first brace to the last, or else bracket to bracket; null
    where none of these parses."""

    @F.arrow_udf(T.StringType())
    def found(answers: pa.Array) -> pa.Array:
        return pa.array(map(_json_in, answers.to_pylist()), pa.string())

    return found(answer)


def parsed_answer(answer: Column, schema: str) -> Column:
    """An answer's JSON (loose_json) as a struct; null where it holds none."""
    return F.from_json(loose_json(answer), schema)

"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws u from a hash of its id; its Efraimidis-Spirakis key is -ln(u) / w for a quality weight w, and a
source gives its documents in ascending key order. A source with target t and size s takes floor(t / s) complete epochs
of all its documents; what remains of the target goes to the prefix of documents whose running size fits, and the
document on the edge gives the part that still fits.

The running sum never sorts a whole source: keys fall into KEY_BUCKETS buckets, bucket sizes are pre-aggregated, a window
over at most KEY_BUCKETS rows per source finds the bucket that holds the edge, and only the documents of that one bucket
are sorted. So a source with a third of all rows costs its window about a 1/KEY_BUCKETS share of them.

Nulls and edges: a null text has size 0; a null source is a source of its own, last in order; a null id draws like the
empty text; sources whose documents are all empty have target 0; repeated rows count each time, and equal rows on the edge
share what it gives; ties in the key go by id, then size; very long texts only count words; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import aside, broadcast_if_small, kept, word_count

KEY_BUCKETS = 8192
#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SYMBOLS = "#*$%&|<>!"


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.5 and 1: falls with the number of symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + F.coalesce(symbols, F.lit(0)) / F.greatest(size, F.lit(1)))


def draw(doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5 of the id as text."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: one row (m_source, m_source_size) per source. Adds m_target: shares by weight of the total, capped at
    max_epochs times the source, the excess reshared among the rest. The level at which the caps bind comes in closed
    form from the sources in order of cap per unit of weight. One row per source is all that meets in one task."""
    by_name = Window.orderBy(F.col("m_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("m_at", F.row_number().over(by_name))
    s = s.withColumn("m_weight", F.element_at(cycle, ((F.col("m_at") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("m_cap", F.col("m_source_size") * F.lit(max_epochs))
    s = s.withColumn("m_full_at", F.col("m_cap") / F.col("m_weight"))
    by_cap = Window.orderBy("m_full_at", "m_at")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    spent = F.coalesce(F.sum("m_cap").over(before), F.lit(0))
    weighed = F.coalesce(F.sum("m_weight").over(before), F.lit(0.0))
    s = s.withColumn("m_level", (F.sum("m_source_size").over(everywhere) - spent) / (F.sum("m_weight").over(everywhere) - weighed))
    level = F.min(F.when(F.col("m_level") <= F.col("m_full_at"), F.struct("m_full_at", "m_at", "m_level"))).over(everywhere)
    s = s.withColumn("m_target", F.least(F.col("m_cap").cast("double"), F.col("m_weight") * level["m_level"]))
    return s.select("m_source", "m_source_size", F.coalesce("m_target", F.lit(0.0)).alias("m_target"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with m_source, m_size and the sampling key m_key."""
    size = word_count(F.col("text"))
    rows = docs.withColumn("m_source", F.col("source").cast("string")).withColumn("m_size", size)
    return rows.withColumn("m_key", -F.ln(draw(F.col("doc_id"))) / quality_weight(F.col("text"), F.col("m_size")))


def _plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """rows: doc_id, m_source, m_size, m_key. One row per source: its size, target, complete epochs, and m_cut: the first
    row in the order (key, id, size) that the rest of the target doesn't cover, with what each such row gives. Sources whose
    rest covers nothing more (or that have no rest) have a cut all the same; only where a source is empty there is none."""
    rows = rows.withColumn("m_bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("m_key"))) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int"))
    buckets = kept(rows.groupBy("m_source", "m_bucket").agg(F.sum("m_size").alias("m_words")))
    sources = source_targets(buckets.groupBy("m_source").agg(F.sum("m_words").alias("m_source_size")), weights, max_epochs)
    sources = sources.withColumn("m_epochs", F.when(F.col("m_source_size") > 0, F.floor(F.col("m_target") / F.col("m_source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = kept(sources.withColumn("m_rest", F.floor(F.col("m_target") - F.col("m_epochs") * F.col("m_source_size")).cast("long")))
    run = Window.partitionBy("m_source").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = buckets.withColumn("m_upto", F.sum("m_words").over(run)).alias("b")
    edge = upto.join(sources.alias("s"), F.col("b.m_source").eqNullSafe(F.col("s.m_source"))).where(F.col("m_upto") > F.col("m_rest"))
    edge = edge.groupBy(F.col("s.m_source").alias("e_source"), "m_rest").agg(F.min(F.struct("m_bucket", (F.col("m_upto") - F.col("m_words")).alias("m_before"))).alias("m_edge"))
    near = rows.join(edge, F.col("m_source").eqNullSafe(F.col("e_source")) & (F.col("m_bucket") == F.col("m_edge")["m_bucket"]))
    near = near.groupBy("m_source", "m_key", "doc_id", "m_size", "m_rest", F.col("m_edge")["m_before"].alias("m_before")).count()
    sort = Window.partitionBy("m_source").orderBy("m_key", "doc_id", "m_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("m_upto", F.col("m_before") + F.sum(F.col("m_size") * F.col("count")).over(sort)).where(F.col("m_upto") > F.col("m_rest"))
    gives = F.floor((F.col("m_rest") - (F.col("m_upto") - F.col("m_size") * F.col("count"))) / F.col("count")).cast("long")
    cut = near.groupBy(F.col("m_source").alias("c_source")).agg(F.min(F.struct("m_key", "doc_id", "m_size", gives.alias("m_gives"))).alias("m_cut"))
    plan = sources.join(cut, F.col("m_source").eqNullSafe(F.col("c_source")), "left")
    return kept(plan.select(F.col("m_source").alias("p_source"), "m_source_size", "m_target", "m_epochs", "m_cut"))


def _taken() -> Column:
    """Words that a row of _keyed, joined to its source's plan, gives. In the order of keys a null id comes first."""
    key, doc, size = F.col("m_key"), F.col("doc_id"), F.col("m_size")
    cut = F.col("m_cut")
    at = F.struct(key.alias("m_key"), doc.alias("doc_id"), size.alias("m_size"))
    edge = F.struct(cut["m_key"].alias("m_key"), cut["doc_id"].alias("doc_id"), cut["m_size"].alias("m_size"))
    part = F.when(cut.isNull() | (at > edge), F.lit(0)).when(at < edge, size).otherwise(cut["m_gives"])
    return (F.col("m_epochs") * size + part).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = kept(_keyed(docs.select("doc_id", "text", "source")).select("doc_id", "m_source", "m_size", "m_key"))
    placed = rows.join(broadcast_if_small(_plan(rows, weights, max_epochs)), F.col("m_source").eqNullSafe(F.col("p_source")))
    return placed.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), _taken().alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: rows of docs, each as many times as its taken words hold it (the part on the edge counts from one
    half on). Texts are not shuffled: the plan is one row per source, broadcast unless there are very many sources."""
    docs, restored = aside(docs, ("doc_id", "text", "source"))
    rows = kept(_keyed(docs.select("doc_id", "text", "source")).select("doc_id", "m_source", "m_size", "m_key"))
    placed = _keyed(docs).join(broadcast_if_small(_plan(rows, weights, max_epochs)), F.col("m_source").eqNullSafe(F.col("p_source")))
    copies = F.when(F.col("m_size") > 0, F.round(_taken() / F.col("m_size"))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("m_copies", copies).where("m_copies > 0")
    return restored(placed.withColumn("m_copy", F.explode(F.sequence(F.lit(1), "m_copies"))))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0) AS symbols,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (0.5 + 0.5 / (1.0 + symbols::DOUBLE / greatest(size, 1))) AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s0),
s2 AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / w AS full_at FROM s2),
s4 AS (SELECT *, ((SUM(source_size) OVER ())::DOUBLE - coalesce(SUM(cap) OVER b, 0)::DOUBLE) / ((SUM(w) OVER ()) - coalesce(SUM(w) OVER b, 0)) AS level
       FROM s3 WINDOW b AS (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(level, (full_at, pos)) AS level FROM s4 WHERE level <= full_at),
s5 AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT level FROM lv)) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s5),
s7 AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM s6),
r AS (SELECT doc_id, size, source_size, target, epochs, rest,
        (SUM(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS prior
      FROM k JOIN s7 ON k.source IS NOT DISTINCT FROM s7.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - prior)))::BIGINT AS taken FROM r
"""

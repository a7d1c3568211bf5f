"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints with at most 3 differing bits differ in at most 3 of
8 bytes, so they share at least 5 bytes at the same position. The index posts each distinct fingerprint under every
three-byte part of either half of its bytes (8 postings): of 5 shared positions at least 3 fall in one half, so every
linked pair meets in some posting list, and lists stay 2**24 times shorter than the table. Within a list, each pair's
shared positional bytes are tallied, pairs below the guaranteed 5 go, and the rest are verified on bits.

Skew: exact copies fall together before the index is built (one row per distinct fingerprint, combined on the map side).
Lists longer than LIST_LIMIT are cut into parts by hash and every two parts meet in a task of their own, so no link is
lost and no task holds more than two parts. A task returns the links of a spanning forest of its pairs, never all pairs.
Components come from rounds of contraction to a random neighbour over the links, each round written to the shared
checkpoint folder; nothing but counts reaches the driver.

Nulls and edges: a null text has no words; texts without words have fingerprint zero and link like others; texts with
fewer words than a shingle are one shingle; very long texts are read whole, their hashes in steps; a null id has its component like others but is never the smallest id (the
component of null ids only has a null id); repeated rows give one row each; an empty table gives an empty result; other
columns are ignored or, in keep_one, kept as they are, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, broadcast_if_small, kept, trim, with_computed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
LEAST_SHARED = 8 - MAX_BITS
LIST_LIMIT = 2048
HOT = 1000
#: The three-byte parts of each half.
PARTS = tuple(tuple(b for b in range(half, half + 4) if b != out) for half in (0, 4) for out in range(half, half + 4))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))), dtype=">u8", count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8)).reshape(len(block), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _with_fingerprint(rows: DataFrame, name: str, shingle: int, without: tuple[str, ...] = ()) -> DataFrame:
    def start():
        return lambda texts: (np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64),)

    return with_computed(rows, ("text",), start, {name: "long"}, without)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row."""
    return _with_fingerprint(docs.select("doc_id", "text"), "fp", shingle, without=("text",))


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs of fps that the count filter and the check on bits leave."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            x = fps[rest] ^ fps[at]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = (shared >= LEAST_SHARED) & (np.bitwise_count(x) <= MAX_BITS)
            if near.any():
                hit = rest[near]
                left.append(np.full(len(hit), fps[at], dtype=np.uint64))
                right.append(fps[hit])
                queue.extend(hit.tolist())
                rest = rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links within each list; keys (three columns) tell the lists apart and are sorted."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(keys)])
    two = starts[sizes == 2]
    x = fps[two] ^ fps[two + 1]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = (shared >= LEAST_SHARED) & (np.bitwise_count(x) <= MAX_BITS)
    left, right = [fps[two[near]]], [fps[two[near] + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        u, v = _forest(fps[s : s + n])
        left.append(u)
        right.append(v)
    return np.concatenate(left), np.concatenate(right)


def _links_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, a, b, fp) sorted by (key, a, b): the links within each list. What is held back of a batch is its last
    list, which the next batch may go on with."""

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        u, v = _links(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    held_keys: list[np.ndarray] = []
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        fps = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        first = int(np.argmax((keys == keys[-1]).all(axis=1)))  # where the batch's last list begins
        if held and (first or (held_keys[-1][-1] != keys[-1]).any()):
            yield out(np.concatenate([*held_keys, keys[:first]]), np.concatenate([*held, fps[:first]]))
            held_keys, held = [], []
        elif first:
            yield out(keys[:first], fps[:first])
        held_keys.append(keys[first:].copy())
        held.append(fps[first:].copy())
    if held:
        yield out(np.concatenate(held_keys), np.concatenate(held))
    trim()


def candidate_links(distinct: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """distinct: one row per fingerprint (fp). Returns u, v: links whose components are those of all linked pairs."""
    byte = lambda b: F.shiftrightunsigned("fp", 56 - 8 * b).bitwiseAND(F.lit(255))
    part = lambda k, bytes_: F.lit(k << 24) + F.shiftleft(byte(bytes_[0]), 16) + F.shiftleft(byte(bytes_[1]), 8) + byte(bytes_[2])
    postings = distinct.select("fp", F.explode(F.array(*[part(k, p) for k, p in enumerate(PARTS)])).alias("key"))
    # Only long lists are told their size, so that no key's postings meet but in the parts of its list.
    long = broadcast_if_small(kept(postings.groupBy("key").count().where(F.col("count") > list_limit)))
    parts = F.coalesce(F.ceil(F.col("count") / F.lit(list_limit)), F.lit(1)).cast("int")
    lists = postings.join(long, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    lists = lists.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    lists = lists.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    return lists.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_links_of_lists, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: every node of links with the label of its component (one of its nodes). Each round every node moves
    to the neighbour (or itself) of least salted hash, and links between what remains go on; expected to shrink by a
    constant factor a round, whatever the shape."""
    links = kept(links.where("u != v"))
    labels = kept(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")))
    salt = 0
    while links.limit(1).count():
        salt += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        moves = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", order("u"))["n"].alias("to"))
        # A node may point at one that moves as well; one more step shortens the chain.
        hop = moves.select(F.col("node").alias("mid"), F.col("to").alias("far"))
        moves = kept(moves.join(hop, moves["to"] == hop["mid"]).select("node", F.col("far").alias("to")))
        left, right = moves.select(F.col("node").alias("u"), F.col("to").alias("nu")), moves.select(F.col("node").alias("v"), F.col("to").alias("nv"))
        links = links.join(left, "u").join(right, "v").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).where("u != v").distinct()
        links = kept(links)
        labels = kept(labels.join(moves.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    return labels


def placed(docs: DataFrame, shingle: int = SHINGLE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fp, label (tells the components apart), component_id (the smallest doc_id reachable) of every row."""
    prints = kept(fingerprints(docs, shingle))
    distinct = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    labels = components(candidate_links(distinct.select("fp"), list_limit))
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "rows", F.coalesce("label", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    place = kept(linked.join(least, "label").select("fp", "rows", "label", "component_id"))
    # Fingerprints of more than a HOT-th of all rows are less than HOT in number: they are broadcast, so that a group of copies of
    # any size isn't shuffled to one task.
    often = F.col("rows") * HOT > prints.count()
    columns = ("doc_id", "fp", "label", "component_id")
    hot = F.broadcast(place.where(often))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(place.where(~often), "fp")
    return prints.join(hot, "fp").select(*columns).unionByName(rest.select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    return placed(docs, shingle, list_limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without the near copies: of each component the row with the smallest id stays (of several texts under that id the
    one with the smallest fingerprint). Rows without an id all stay. The ids that go are joined to the texts, so texts move once
    at most; only rows whose id occurs again are told apart by id and fingerprint, which is taken from their texts once more."""
    docs, restored = aside(docs, ("doc_id", "text"))
    found = kept(placed(docs, shingle).select(F.col("doc_id").alias("m_id"), F.col("fp").alias("m_fp"), "label", "component_id").where("m_id IS NOT NULL"))
    gone = found.where("m_id != component_id").select("m_id")
    again = kept(found.groupBy("m_id").count().where("count > 1").select("m_id"))
    match = F.col("doc_id") == F.col("m_id")
    if not again.limit(1).count():
        return restored(docs.join(broadcast_if_small(kept(gone)), match, "left_anti"))
    out = docs.join(broadcast_if_small(kept(gone.unionByName(again).distinct())), match, "left_anti")
    again = broadcast_if_small(again)
    stay = found.join(again, "m_id", "left_semi").where("m_id = component_id").groupBy("label", "m_id").agg(F.min("m_fp").alias("m_fp")).select("m_id", "m_fp")
    rows = _with_fingerprint(docs.join(again, match, "left_semi"), "m_own", shingle)
    rows = rows.join(broadcast_if_small(kept(stay)), match & (F.col("m_own") == F.col("m_fp")), "left_semi").dropDuplicates(["doc_id", "m_own"])
    return restored(out.unionByName(rows.drop("m_own")))

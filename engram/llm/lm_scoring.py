"""Language-model scoring with a weighted backoff automaton.

The model is a Dirichlet-smoothed n-gram model of order ORDER: with the count c of an n-gram h w and the count of its
context h, p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu), where h' is h without its first token and the lowest level is
the add-half unigram estimate. As an automaton: a state for every seen context; an arc for every seen n-gram, weighted by its log
probability and leading to the longest seen suffix; and on every state a failure arc to h' weighted log(mu / (c(h) + mu)).
A text is read left to right: the state is carried, missing arcs take failure arcs, and the weights add up to the log
probability.

The model of the whole corpus is never in one place. Texts are packed into blocks of about BLOCK_BYTES. A block sends the
hashes of its distinct n-grams, with their counts in its training texts, to ranges of the hash space; a range adds up the
counts of its n-grams over all blocks, which is the exact corpus count, and sends each block the counts of what the block asked
for. The block then builds the part of the automaton that its texts can reach and reads all of them. So every n-gram of
every training text counts, a task holds one block or one range (ranges grow in number with the corpus), and an n-gram
that occurs in each document is still one row per block. Blocks send in rounds, tokens and pairs in the first and each longer
length in one of its own; what a round sent is deleted as soon as its totals are kept, so one round's messages are on disk at a time.

Long texts are cut into pieces for the traversal, which runs over all pieces in step; as a state depends on the last
ORDER - 1 tokens only, a piece that starts that many tokens early reaches the same states.

Nulls and edges: a null text is empty and has one token, its end; a null id hashes like the empty text; tokens that the
training texts lack have count 0; without training texts N and V are 0, and the score of a token is log10(1); repeated
rows count and are scored each time; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, kept_alone

ORDER = 3
FOLDS = 5
HELD_OUT = 1
#: Prior weight by length of the context.
MU = (0.0, 500.0, 8.0)
BLOCK_BYTES = 8 << 20
#: n-grams of all blocks that meet in a range, about.
RANGE_ENTRIES = 5_000_000
#: Bits of an n-gram's hash beyond single tokens, at every corpus size: an n-gram shares its hash with another of 2**30 with
#: chance 2**-26, of 2**45 with chance 2**-11. Single tokens keep 64.
HASH_BITS = 56
PIECE = 512
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _compress(array: np.ndarray) -> bytes:
    """Bytes of an integer array, by planes."""
    import zstandard

    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T) if len(array) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX2
    return h ^ (h >> np.uint64(29))


def sort_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts keys of so many bits. Key and index are sorted as one number; where both don't fit, the key's
    lowest bits stay out and runs that differ in those alone are put right afterwards."""
    at_bits = max(1, len(keys).bit_length())
    low = max(0, bits + at_bits - 64)
    packed = (keys.astype(np.uint64) >> np.uint64(low)) << np.uint64(at_bits) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << at_bits) - 1)).astype(np.int64)
    if low:
        top, done = packed >> np.uint64(at_bits), -1
        for i in np.flatnonzero(keys[order[:-1]] > keys[order[1:]]):
            if i > done:
                a, b = np.searchsorted(top, top[i], "left"), np.searchsorted(top, top[i], "right")
                order[a:b] = order[a:b][np.argsort(keys[order[a:b]], kind="stable")]
                done = b
    return order


def gram_hashes(tokens: np.ndarray, ends: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For n = 1 .. order the hash of the n tokens up to each place, 0 where fewer lie in the text. tokens: the hash of
    each place's token; ends: whether a text ends here."""
    out = [tokens]
    starts = np.concatenate([[True], ends[:-1]]) if len(ends) else ends
    short = starts.copy()
    for n in range(2, order + 1):
        h = np.zeros_like(tokens)
        h[1:] = _mix(out[-1][:-1] * MIX + tokens[1:] + np.uint64(n)) >> np.uint64(64 - bits)
        h[1:] |= np.uint64(1)
        h[short] = 0
        out.append(h)
        short = short | np.concatenate([[True], short[:-1]])[: len(short)]
    return out


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Packer:
    """Token ids, hashes and ids of the documents of a block."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict(counter().__next__)
        self.end = self.vocabulary[b" "]  # no word holds a blank
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.held: list[bool] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        words = _tokens(text)
        place = self.vocabulary.__getitem__
        self.ids.append(np.fromiter(map(place, words), dtype=np.int32, count=len(words)))
        self.lengths.append(len(words))
        self.docs.append(doc_id)
        self.held.append(fold_of(doc_id, FOLDS) == HELD_OUT)
        self.size += len(text or "") + 64

    def row(self, block: int) -> dict:
        import xxhash

        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocabulary), dtype=np.uint64, count=len(self.vocabulary))
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        nulls = np.array([d is None for d in self.docs])
        numbers = np.array([0 if d is None else int(d) for d in self.docs], dtype=np.int64)
        return {
            "block": block, "tokens": _compress(ids), "vocabulary": hashes.tobytes(), "doc_ids": _compress(numbers), "nulls": np.packbits(nulls).tobytes(),
            "held": np.packbits(np.array(self.held)).tobytes(), "lengths": _compress(np.array(self.lengths, dtype=np.int64)), "n_docs": len(self.docs), "n_tokens": len(ids) + len(self.docs),
        }


PACKED = "block long, tokens binary, vocabulary binary, doc_ids binary, nulls binary, held binary, lengths binary, n_docs long, n_tokens long"


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of consecutive rows of a partition."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, packer, n = TaskContext.get().partitionId() << 24, _Packer(), 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                packer.add(None if pd.isna(doc_id) else doc_id, text)
                if packer.size >= block_bytes:
                    yield pd.DataFrame([packer.row(base + n)])
                    packer, n = _Packer(), n + 1
        if packer.docs:
            yield pd.DataFrame([packer.row(base + n)])

    return docs.select("doc_id", "text").mapInPandas(each, PACKED)


class _Block:
    """A packed block, unpacked: tokens with an end after each text."""

    def __init__(self, row, bits: int, order: int = ORDER) -> None:
        self.bits = bits
        lengths = _expand(row["lengths"], np.int64)
        self.n_docs = int(row["n_docs"])
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8))[: self.n_docs].astype(bool)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[: self.n_docs].astype(bool)
        self.doc_ids = _expand(row["doc_ids"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.lengths = lengths + 1
        last = np.cumsum(self.lengths) - 1
        self.ends = np.zeros(int(self.lengths.sum()), dtype=bool)
        self.ends[last] = True
        self.tokens = np.zeros(len(self.ends), dtype=np.int64)  # id 0 is the end
        self.tokens[~self.ends] = _expand(row["tokens"], np.int32)
        self.hashes = gram_hashes(self.vocabulary[self.tokens], self.ends, order, bits)

    def distinct(self, n: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams by hash, and (counted) their counts in the training texts or (else) the index of each place's."""
        if n == 1:
            order = np.argsort(self.vocabulary)
            if not counted:
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                return self.vocabulary[order], place[self.tokens]
            train = np.repeat(~self.held, self.lengths)
            return self.vocabulary[order], np.bincount(self.tokens[train], minlength=len(order))[order]
        h = self.hashes[n - 1]
        if counted:  # the lowest bit tells training texts
            marked = h << np.uint64(1) | np.repeat(~self.held, self.lengths)
            marked.sort()
            starts = _starts(marked >> np.uint64(1))
            return marked[starts] >> np.uint64(1), np.add.reduceat((marked & np.uint64(1)).astype(np.int64), starts)
        order = sort_order(h, self.bits)
        ranked = h[order]
        starts = _starts(ranked)
        new = np.zeros(len(h), dtype=np.int64)
        new[starts] = 1
        place = np.empty(len(h), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return ranked[starts], place


def _starts(ranked: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))


def _range_edges(n: int, ranges: int, bits: int) -> np.ndarray:
    top = 64 if n == 1 else bits
    return np.array([(r << top) // ranges for r in range(1, ranges)], dtype=np.uint64)


COUNTS = "range int, n int, block long, hashes binary, counts binary"


#: Lengths of the n-grams that are sent and added up at a time; of three the first two take about as much as the third.
ROUNDS = (tuple(range(1, min(ORDER, 2) + 1)), *((n,) for n in range(3, ORDER + 1)))


def _send(ranges: int, bits: int, lengths: tuple[int, ...]):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                block = _Block(row, bits, max(lengths))
                for n in lengths:
                    hashes, counts = block.distinct(n, True)
                    cuts = np.concatenate([[0], np.searchsorted(hashes, _range_edges(n, ranges, bits)), [len(hashes)]])
                    out = [(r, n, row["block"], _compress(np.diff(hashes[a:b], prepend=np.uint64(0))), _compress(counts[a:b].astype(np.int32)))
                           for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                    yield pd.DataFrame(out, columns=["range", "n", "block", "hashes", "counts"])

    return each


TOTALS = "block long, n int, range int, counts binary, seen long, total long"


def _total(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one range and order: the counts over all blocks, for each block in the order it asked; the first row also tells how
    many n-grams the training texts hold here, and how often."""
    asked = [np.cumsum(_expand(x, np.uint64), dtype=np.uint64) for x in frame["hashes"]]
    counts = [_expand(x, np.int32) for x in frame["counts"]]
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, asked)])
    n, r = int(frame["n"].iloc[0]), int(frame["range"].iloc[0])
    seen, mass = int((total > 0).sum()), int(total.sum())
    return pd.DataFrame([(b, n, r, _compress(total[place[s:e]]), seen * (i == 0), mass * (i == 0)) for i, (b, s, e) in enumerate(zip(frame["block"], cuts[:-1], cuts[1:]))],
                        columns=["block", "n", "range", "counts", "seen", "total"])


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block that the training texts hold. State 0 is the empty context."""

    def __init__(self, block: _Block, counts: list[np.ndarray], places: list[np.ndarray], n_total: int, v_total: int, mu: tuple[float, ...] = MU):
        self.width = len(block.vocabulary)
        tokens, order = block.tokens, len(counts)
        unigram = counts[0]
        # places[0] numbers tokens by hash; from here on a token is that number
        self.read = places[0]
        end = places[0][-1]
        base = (unigram + 0.5) / (n_total + 0.5 * (v_total + 1))
        self.base_log = np.log10(base)
        state_of: list[np.ndarray] = []  # per length, the state of each distinct n-gram, or -1
        states = 1
        for n in range(1, order):
            ok = counts[n - 1] > 0
            if n == 1:
                ok = ok.copy()
                ok[end] = False
            else:  # n-grams that end a text lead nowhere
                closing = np.unique(places[n - 1][tokens == 0])
                ok = ok.copy()
                ok[closing] = False
            number = np.full(len(ok), -1, dtype=np.int64)
            number[ok] = states + np.arange(int(ok.sum()))
            states += int(ok.sum())
            state_of.append(number)
        self.fail, self.backoff = np.zeros(states, dtype=np.int64), np.zeros(states)
        keys, weights, targets = [self.read_keys(np.zeros(self.width, dtype=np.int64), np.arange(self.width))], [self.base_log], [np.maximum(state_of[0], 0) if order > 1 else np.zeros(self.width, dtype=np.int64)]
        probability = base  # of each distinct n-gram of the length before
        for n in range(2, order + 1):
            first = np.empty(len(counts[n - 1]), dtype=np.int64)  # a place of each distinct n-gram
            first[places[n - 1]] = np.arange(len(tokens))
            live = counts[n - 1] > 0
            at = first[live]
            context, suffix, word = places[n - 2][at - 1], places[n - 2][at], places[0][at]
            back = probability[suffix]
            p = (counts[n - 1][live] + mu[n - 1] * back) / (counts[n - 2][context] + mu[n - 1])
            here = np.zeros(len(live))
            here[live] = p
            source = state_of[n - 2][context]
            keys.append(self.read_keys(source, word))
            weights.append(np.log10(p))
            longest = state_of[n - 1][live] if n < order else np.full(len(at), -1, dtype=np.int64)
            shorter = state_of[n - 2][suffix]
            if n == 2:
                targets.append(np.where(longest >= 0, longest, np.maximum(shorter, 0)))
            else:
                shortest = state_of[n - 3][places[n - 3][at]]
                targets.append(np.where(longest >= 0, longest, np.where(shorter >= 0, shorter, np.maximum(shortest, 0))))
            probability = here
            if n < order:  # failure arcs of the states of this length
                ok = state_of[n - 1][live] >= 0
                self.fail[state_of[n - 1][live][ok]] = np.maximum(state_of[n - 2][suffix[ok]], 0)
        for n in range(1, order):
            number = state_of[n - 1]
            ok = number >= 0
            self.backoff[number[ok]] = np.log10(mu[n] / (counts[n - 1][ok] + mu[n]))
        key = np.concatenate(keys)
        sort = sort_order(key, int(key.max()).bit_length())
        self.keys, self.weights, self.targets = key[sort], np.concatenate(weights)[sort], np.concatenate(targets)[sort]

    def read_keys(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return state * self.width + word

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights of reading one token in each of many states."""
        weight, out = np.zeros(len(state)), np.empty(len(state), dtype=np.int64)
        rest, at = np.arange(len(state)), state
        while len(rest):
            key = self.read_keys(at, word[rest])
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            done = rest[hit]
            weight[done] += self.weights[place[hit]]
            out[done] = self.targets[place[hit]]
            rest, at = rest[~hit], at[~hit]
            weight[rest] += self.backoff[at]
            at = self.fail[at]
        return out, weight

    def traverse(self, lengths: np.ndarray, piece: int = PIECE, warm: int = ORDER - 1) -> np.ndarray:
        """The log10 probability of each text, read left to right in pieces."""
        starts = np.cumsum(lengths) - lengths
        pieces = -(-lengths // piece)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + k * piece
        stop = np.minimum(begin + piece, starts[owner] + lengths[owner])
        lead = np.minimum(k * piece, warm)
        at, state, sums = begin - lead, np.zeros(len(owner), dtype=np.int64), np.zeros(len(owner))
        live = np.arange(len(owner))
        while len(live):
            where = at[live]
            state[live], weight = self.step(state[live], self.read[where])
            sums[live] += np.where(where >= begin[live], weight, 0.0)
            at[live] += 1
            live = live[at[live] < stop[live]]
        return np.bincount(owner, weights=sums, minlength=len(lengths))


def _score_block(packed: pd.DataFrame, totals: pd.DataFrame, bits: int, n_total: int, v_total: int, mu: tuple[float, ...]) -> pd.DataFrame:
    block = _Block(packed.iloc[0], bits)
    counts, places = [], []
    for n in range(1, ORDER + 1):
        mine = totals[totals["n"] == n].sort_values("range")
        counts.append(np.concatenate([_expand(x, np.int64) for x in mine["counts"]]))
        places.append(block.distinct(n, False)[1])
        if n > 1:
            counts[-1] = counts[-1].copy()
            short = block.hashes[n - 1] == 0
            if short.any():
                counts[-1][places[-1][np.argmax(short)]] = 0
    automaton = Automaton(block, counts, places, n_total, v_total, mu)
    starts = np.cumsum(block.lengths) - block.lengths
    known = np.add.reduceat((counts[0][places[0]] > 0).astype(np.int64), starts)
    base = np.add.reduceat(automaton.base_log[places[0]], starts)
    ids = pd.Series(block.doc_ids, dtype="Int64")
    ids[block.nulls] = pd.NA
    return pd.DataFrame({"doc_id": ids, "held_out": block.held, "n_tokens": block.lengths, "n_known": known, "train_tokens": np.full(block.n_docs, n_total), "base_score": base, "score": automaton.traverse(block.lengths)})


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE_ENTRIES, mu: tuple[float, ...] = MU) -> DataFrame:
    """docs: doc_id (an integer), text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    packed = kept_alone(pack(docs, block_bytes))
    tokens = packed.agg(F.sum("n_tokens")).first()[0] or 0
    ranges, bits = max(1, -(-int(tokens) * ORDER // range_entries)), HASH_BITS
    rounds = [kept_alone(packed.mapInPandas(_send(ranges, bits, lengths), COUNTS).groupBy("range", "n").applyInPandas(_total, TOTALS)) for lengths in ROUNDS]
    totals = functools.reduce(DataFrame.union, rounds)
    stats = rounds[0].where("n = 1").agg(F.sum("total"), F.sum("seen")).first()
    n_total, v_total = int(stats[0] or 0), int(stats[1] or 0)

    def each(packed_rows: pd.DataFrame, total_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(packed_rows):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return _score_block(packed_rows, total_rows, bits, n_total, v_total, mu)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(each, schema)

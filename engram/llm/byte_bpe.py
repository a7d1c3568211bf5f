"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised here straight from a rank file: each token's bytes are mapped to one character each and the piece
is scored by its negative rank, so sentencepiece merges in rank order; ids stay equal to ranks and the unknown piece
comes last. Normalisation is the identity, with no dummy prefix and no escaping of blanks. A text is cut into pre-tokens
by the vocabulary's pattern; each is encoded by itself (a pre-token that is a token as a whole is that token), and ids go
back to bytes by the inverse table. Pre-tokens repeat, so each different one is encoded once as long as it is remembered.

Nulls and edges: a null or empty text has no tokens (the hashes are those of the empty string); special tokens in a text
are ordinary text; very long pre-tokens are encoded whole; rows are judged alone, so repeated rows need nothing; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice
from itertools import count as counter

import numpy as np
from pyspark.sql import DataFrame

from .common import load_ranks, tokenizer_path, with_computed

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Byte b is the character FIRST + b: a block of letters, none of them special to sentencepiece.
FIRST = 0x100
#: A worker remembers so many pre-tokens, of so many ids in all; texts are worked so many characters at a time.
CACHE_ENTRIES = 200_000
CACHE_IDS = 2_000_000
PART_CHARS = 1 << 20
#: The characters of all bytes.
CHARACTERS = "".join(chr(FIRST + b) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: a length-delimited one for bytes, a varint for int."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_characters(token: bytes) -> str:
    return token.decode("latin-1").translate(CHARACTERS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto. Field numbers are those of sentencepiece_model.proto: pieces 1 (piece 1, score 2,
    type 3), trainer_spec 2 (model_type 3, unk_piece 45), normalizer_spec 3 (name 1, charsmap 2, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5)."""
    normal, unknown, bpe = 1, 2, 2
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for token, rank in ordered:
        out += _field(1, _field(1, as_characters(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe))
    out += _field(3, _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder for one rank file. Pre-tokens are numbered as they are met; new ones are encoded in one call and decoded by the
    inverse table once. Between texts what is remembered of them is dropped when full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(counter().__next__)
        self.ids, self.starts = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self.raw: list[bytes] = []

    def _learn(self, new: list[str]) -> None:
        raw = [pre.encode("utf-8", "surrogatepass") for pre in new]
        found: list = [self.ranks.get(r) for r in raw]
        cut = [k for k, whole in enumerate(found) if whole is None]
        encoded = self.pieces.encode([as_characters(raw[k]) for k in cut], num_threads=1)
        found = [[whole] for whole in found]
        for k, ids in zip(cut, encoded):
            found[k] = ids
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), dtype="<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))])
        self.raw += [self.decode(ids) for ids in found]

    def read(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids of each text, and the bytes that they decode to."""
        at = 0
        while at < len(texts):
            if len(self.numbers) > CACHE_ENTRIES or self.starts[-1] > CACHE_IDS:
                self.clear()
            part, size = [], 0
            while at < len(texts) and (not part or size < PART_CHARS):
                part.append(self.split(texts[at]))
                size, at = size + len(texts[at]), at + 1
            lengths = list(map(len, part))
            places = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(part)), dtype=np.int64, count=sum(lengths))
            if len(self.numbers) > len(self.raw):
                self._learn(list(islice(self.numbers, len(self.raw), None)))
            stop = 0
            for n in lengths:
                start, stop = stop, stop + n
                mine = places[start:stop]
                sizes = self.starts[mine + 1] - self.starts[mine]
                within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield self.ids[np.repeat(self.starts[mine], sizes) + within], b"".join(map(self.raw.__getitem__, mine.tolist()))

    def encode(self, text: str) -> np.ndarray:
        return next(self.read([text]))[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids also ids (array<int>), with_decoded
    also decoded (binary)."""
    path, pattern = path or tokenizer_path(VOCABULARY), pattern or _public_pattern()

    def start():
        bpe = coder(path, pattern)

        def compute(texts: list[str | None]) -> tuple:
            counts, id_hashes, raw_hashes, all_ids, all_raw = [], [], [], [], []
            for ids, raw in bpe.read([text or "" for text in texts]):
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                raw_hashes.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                if with_decoded:
                    all_raw.append(raw)
            return (counts, id_hashes, raw_hashes, *([all_ids] * with_ids), *([all_raw] * with_decoded))

        return compute

    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "binary"} if with_decoded else {})
    return with_computed(docs.select("doc_id", "text"), ("text",), start, new, without=("text",))


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN

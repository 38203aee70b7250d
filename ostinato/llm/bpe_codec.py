"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The vocabulary becomes a sentencepiece BPE model without any training: every token's bytes are mapped to printable
characters, its score is its negative rank, and normalisation is the identity. sentencepiece then merges the best-ranked
neighbours first, leftmost on ties, which is the order of byte-level BPE. Each pre-token of the pattern is encoded by
itself. Decoding maps ids back to bytes.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows give repeated results; columns of
the input besides the key and the text are ignored, whatever their names; a text of any length is one row, whole (its ids take a few
times its size in memory); null keys and repeated ones are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers at most; then it starts anew.
CACHE = 400_000
#: Texts encoded together.
GROUP = 128
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for each byte, none of them white space or one that sentencepiece treats on its own."""
    return [chr(0x4E00 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: an int as varint, a float as fixed32, bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the token of rank i, the last piece stands for unknown symbols."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    chars = byte_characters()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(map(chars.__getitem__, token)).encode()
        pieces[rank] = _field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, _NORMAL))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, float(-len(ranks))) + _field(3, _UNKNOWN))
    trainer = _field(3, _BPE) + _field(40, len(ranks))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and ids to bytes; one per worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pattern = regex.compile(pattern)
        self.chars = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.between = chr(0x4E00 + 256)
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encodes pre-tokens, many in one call: a symbol outside the vocabulary stands between them and never merges."""
        for k in range(0, len(new), 256):
            part = new[k : k + 256]
            joined = self.between.join([w.encode().decode("latin-1").translate(self.chars) for w in part])
            ids = np.array(self.model.encode(joined), dtype="<u4")
            cuts = np.flatnonzero(ids == len(self.tokens))
            raw, left = ids.tobytes(), 0
            for word, right in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                self.known[word] = raw[4 * left : 4 * right]
                left = right + 1

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        parts = [self.pattern.findall(x or "") for x in texts]
        if new := set().union(*parts).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set().union(*parts)
            self._learn(list(new))
        known = self.known.__getitem__
        return [b"".join(map(known, x)) for x in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_column(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Per row: the key, and the ids of its text as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP):
                part = batch.slice(k, GROUP)
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in own.encode_many(part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """Per row: the key, and the bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [own.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, type=pa.binary())], names=["key", "bytes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, bytes binary")


def codec_digests(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Per row: the key, the number of ids, and digests of the ids and of the bytes that they decode to.

    Encodes and decodes in one pass; texts and ids are held for GROUP rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP):
                part = batch.slice(k, GROUP)
                ids = own.encode_many(part.column(1).to_pylist())
                of_text = [hashlib.sha256(own.decode(np.frombuffer(x, dtype="<u4"))).hexdigest() for x in ids]
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array(of_text, pa.string()),
                    ],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("key", key)

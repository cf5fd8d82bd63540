"""Byte-level BPE by a sentencepiece model that is written straight from a rank file. Nothing is trained.

The vocabulary's byte strings are spelled with one printable character a byte, each becomes a piece whose score is its
negative rank, and normalisation is the identity. Highest score first and leftmost on ties is then exactly the merge
order of the ranks. Pre-tokens are encoded one by one (a pre-token that is itself in the vocabulary is that one id), and
decoding maps the ids back to the pieces' bytes.

Defined cases: null or empty text has no ids; its digests are those of no bytes. Rows are independent, so repeated rows
give repeated results; a null id stays null. Texts are encoded whole; one of over `LONG` characters goes through in blocks
of matches, with the same result. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

#: Pre-tokens whose ids a worker remembers, and the longest of them in characters; the memory is emptied when full.
REMEMBERED, LONGEST = 400_000, 64
LONG = 1 << 20
BLOCK = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def alphabet() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol-buffers message: varint, 32-bit float, or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is the unknown, piece r + 1 the byte string of the r-th smallest rank."""
    letters = alphabet()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, "".join(letters[b] for b in piece).encode()) + _field(2, -float(rank)) + _field(3, normal) for piece, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encode and decode with a serialised model; made once in each worker.

    Ids are decimal text joined by spaces, or with `dtype` the bytes of a flat array.
    """

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str, dtype: str | None = None):
        import regex
        import sentencepiece

        self._find = regex.compile(pattern)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._rank = [0, *sorted(ranks.values())]
        letters = alphabet()
        self._spell = {b: letters[b] for b in range(256)}
        self._glue = b"" if dtype else " "
        self._write = (lambda ids: np.array(ids, dtype).tobytes()) if dtype else (lambda ids: " ".join(map(str, ids)))
        self._whole = {piece.decode("latin-1"): self._write([rank]) for piece, rank in ranks.items()}
        self._bytes = {str(rank): piece for piece, rank in ranks.items()}
        self._known: dict[str, str | bytes] = {}

    def _learn(self, tokens: Iterable[str]) -> dict[str, str | bytes]:
        out, spelled = {}, []
        for token in tokens:
            raw = token.encode().decode("latin-1")
            if (one := self._whole.get(raw)) is not None:
                out[token] = one
            else:
                spelled.append((token, raw.translate(self._spell)))
        rank = self._rank
        for (token, _), ids in zip(spelled, self._model.encode([s for _, s in spelled], out_type=int, num_threads=1) if spelled else [], strict=True):
            out[token] = self._write([rank[i] for i in ids])
        return out

    def _join(self, tokens: list[str]) -> str | bytes:
        known = self._known
        try:
            return self._glue.join([known[t] for t in tokens])
        except KeyError:
            pass
        new = self._learn({t for t in tokens if t not in known})
        text = self._glue.join([known[t] if t in known else new[t] for t in tokens])
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        return text

    def blocks(self, text: str) -> Iterator[str | bytes]:
        """The ids of a text in non-empty blocks, one unless it is long."""
        if len(text) <= LONG:
            if text:
                yield self._join(self._find.findall(text))
            return
        found = (m.group() for m in self._find.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield self._join(block)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.split(" "))) if ids else b""


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(df: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", with_ids: bool = False) -> DataFrame:
    """`df` with n_tokens, digests of the ids and of the bytes they decode to, and on request token_ids.

    The rank file is read on the driver (its size is that of a vocabulary) and its model broadcast.
    """
    spark = df.sparkSession
    ranks = read_ranks(ranks_path)
    sent = spark.sparkContext.broadcast((serialise(ranks), ranks, pattern))
    made: list[Codec] = []
    fields = [*FIELDS, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))] if with_ids else FIELDS

    def run(piece: pa.RecordBatch) -> list:
        if not made:
            made.append(Codec(*sent.value))
        counts, ids_hex, bytes_hex, all_ids = [], [], [], []
        for value in piece.column(text).to_pylist():
            n, ids_sha, bytes_sha, glue, parts = 0, hashlib.sha256(), hashlib.sha256(), "", []
            for ids in made[0].blocks(value or ""):
                n += ids.count(" ") + 1
                ids_sha.update((glue + ids).encode())
                bytes_sha.update(made[0].decode(ids))
                glue = " "
                if with_ids:
                    parts.append(np.array(ids.split(" "), dtype=np.int32))
            counts.append(n)
            ids_hex.append(ids_sha.hexdigest())
            bytes_hex.append(bytes_sha.hexdigest())
            if with_ids:
                all_ids.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        out = [pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(bytes_hex)]
        return [*out, pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else out

    return core.append(df, fields, run, text)


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(documents.select(F.col("doc_id"), F.col("text")), ranks_path, pattern).drop("text")

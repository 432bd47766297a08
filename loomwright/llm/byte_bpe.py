"""Byte-level BPE encoding and decoding through a sentencepiece model that is written from a rank file.

A rank file lists byte strings by merge rank. Each byte string becomes a piece by the usual map from
bytes to printable characters, with score -rank; normalisation is the identity. sentencepiece then merges,
among all neighbours, the pair whose union has the best score, and the leftmost of equals: the merges
of the rank file. A piece's id is its rank. Texts are cut by the tokenizer's pattern first and each
match is encoded by itself; decoding maps ids back to their byte strings.

The vocabulary's size is fixed by its file, a few MB at most, so the model is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import text_groups, tidy

CACHE = 100_000  # matches remembered by a worker, then forgotten all at once
UNKNOWN = "unknown piece"  # no byte stands as a space, so no text has it


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible in Latin-1, else the next free one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(b) for b, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps or repeats")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1) of text (1), score (2) and type (3); trainer_spec (2) with model_type BPE (3); normalizer_spec (3)."""
    chars = byte_chars()
    model = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(chars[b] for b in piece).encode()
        model += _bytes_field(1, _bytes_field(1, text) + b"\x15" + struct.pack("<f", -rank) + _int_field(3, 1))
    model += _bytes_field(1, _bytes_field(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2))
    off = (1 << 64) - 1  # -1: no such piece
    model += _bytes_field(2, _int_field(3, 2) + _int_field(4, len(pieces) + 1) + _int_field(40, len(pieces)) + _int_field(41, off) + _int_field(42, off) + _int_field(43, off) + _bytes_field(45, UNKNOWN.encode()))
    model += _bytes_field(3, _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0))
    return bytes(model)


#: The letters, numbers and white space up to U+00FF, for the standard library's faster matcher.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = {public_tokenizers.PATTERN: f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"}


class ByteBPE:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, pieces: list[bytes], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, self.find = pieces, regex.compile(pattern).findall
        self.find_latin = re.compile(LATIN[pattern]).findall if pattern in LATIN else self.find
        self.chars = dict(enumerate(byte_chars()))
        self.known: dict[str, bytes] = {}  # packed ids: a list of them takes several times the room

    def matches(self, text: str) -> list[str]:
        """The pattern's matches. They cover the text; a pattern that leaves gaps would lose what is in them."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Matches that are new to this worker are encoded together."""
        found = [self.matches(t) for t in texts]
        new = set().union(*found)
        if len(self.known) > CACHE:
            self.known.clear()
        new = [m for m in new if m not in self.known]
        mapped = [m.encode().decode("latin-1").translate(self.chars) for m in new]
        self.known.update((m, struct.pack(f"<{len(ids)}I", *ids)) for m, ids in zip(new, self.model.encode(mapped, num_threads=1)))
        for matches in found:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, matches)), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode_documents(docs: DataFrame, *, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (binary, little-endian unsigned 32-bit).

    A null text counts as empty and has no tokens. Texts of any length are encoded whole; repeated rows
    give equal rows; other columns are ignored and an empty table gives an empty result. The ids are decoded
    for each row, and decoded_sha256 is of those bytes.
    """
    pieces = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((serialise(pieces), pieces, pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBPE(*shared.value)
        columns = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids]
        for batch in batches:
            at = 0
            for texts in text_groups(batch["text"]):
                out = []
                for ids in bpe.encode_all(texts):
                    packed = np.array(ids, dtype="<u4").tobytes()
                    row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                    out.append((*row, packed) if with_ids else row)
                part = batch[["id"]].iloc[at : at + len(texts)]
                yield pd.concat([part, pd.DataFrame(out, columns=columns, index=part.index)], axis=1)
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    done = own.mapInPandas(tidy(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    return done.withColumnRenamed("id", id_col)

"""Byte-level BPE over a rank file, run by sentencepiece.

The ranks are turned into a sentencepiece BPE model at once: every token's bytes are
mapped to visible characters, a token's score is its negative rank, and normalisation is
the identity, so merging by highest score is merging by lowest rank. Texts are cut into
pre-tokens, each encoded alone; decoding maps the pieces' characters back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import parts, slices
from tidemark.session import ship_package

#: Pre-tokens kept per task with their ids; beyond it the memory starts anew.
ROOM = 600_000

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: A text with other characters than these is cut by the full Unicode pattern.
_UNUSUAL = re.compile(r"[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def latin_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for texts without unusual characters: its classes spelled out for the faster matcher."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}0-9]").replace(r"[\p{L}]", rf"[{_LETTER}]")
    return re.compile(plain.replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", "[0-9]"))


class Cutter:
    """Cuts texts into the matches of a pattern."""

    def __init__(self, pattern: str) -> None:
        self._latin, self._full = latin_pattern(pattern).findall, regex.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        return self._full(text) if _UNUSUAL.search(text) else self._latin(text)


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 ones stand for themselves, the rest for 256 and up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file of ``base64 rank`` lines."""
    found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    return [found[i] for i in range(len(found))]


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol-buffer field: text and messages by length, whole numbers as varints, floats as four bytes."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model file of the ranked tokens; ids are ranks, and the unknown piece, never met, is last."""
    # Field numbers and enum values below are fixed by the public model format.
    unknown, normal, bpe = 2, 1, 2
    shown = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        pieces.append(_field(1, _field(1, "".join(shown[b] for b in token)) + _field(2, float(-rank)) + _field(3, normal)))
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    no = (1 << 64) - 1  # a signed -1
    trainer += _field(41, no) + _field(42, no) + _field(43, no)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class _Known(dict):
    """Packed ids by pre-token; a new one is encoded when first asked for."""

    def __init__(self, model, ranks: dict[bytes, int]) -> None:
        self._encode, self._ranks = model.encode, ranks
        self._shown = dict(enumerate(byte_characters()))

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        rank = self._ranks.get(raw)
        ids = [rank] if rank is not None else self._encode(raw.decode("latin-1").translate(self._shown))
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Codec:
    """Encoder and decoder of one rank file; ids come and go as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, pattern: str) -> None:
        self.tokens = read_ranks(path)
        self.cut = Cutter(pattern)
        model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        back = {c: b for b, c in enumerate(byte_characters())}
        self._bytes = [bytes(back[c] for c in model.id_to_piece(i)) for i in range(len(self.tokens))]
        self._known = _Known(model, {t: i for i, t in enumerate(self.tokens)})

    def encode(self, text: str) -> bytes:
        if len(self._known) > ROOM:
            self._known.clear()
        return b"".join(map(self._known.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _run(path: str, pattern: str, of: str):
    def run(batches):
        work = getattr(_codec(path, pattern), of)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string() if of == "encode" else pa.large_binary())
            for lo, hi in slices(parts(column)[1]):
                values = column.slice(lo, hi - lo).to_pylist()
                out = [work(v if v is not None else ("" if of == "encode" else b"")) for v in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], ["doc_id", of])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text as packed little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids; repeated rows stay; other columns are ignored. ``path``
    must be readable on every executor.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(path, pattern, "encode"), "doc_id long, encode binary").withColumnRenamed("encode", "ids")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)``: the bytes behind packed ids; null ids give no bytes."""
    ship_package(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_run(path, pattern, "decode"), "doc_id long, decode binary").withColumnRenamed("decode", "decoded")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row in one pass, for checks of whole corpora."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        codec = _codec(path, pattern)
        for batch in _run(path, pattern, "encode")(batches):
            back = [codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")

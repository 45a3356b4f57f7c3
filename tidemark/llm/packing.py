"""Packing tokenised documents into training sequences by best-fit decreasing.

Every document is tokenised whole and cut into full windows and a remainder. Pieces are
dealt by hash into groups of about ``PER_GROUP``, whatever the corpus, and each group is
packed alone: longest piece first, into the open sequence that it fills best, found in a
segment tree indexed by remaining capacity. With that many pieces in a group the
sequences left half empty do not count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bytebpe import byte_characters
from tidemark.llm.textbytes import parts, slices, word_hashes
from tidemark.session import ship_package, stage

PER_GROUP = 20_000
#: Distinct words kept a task with their ids; beyond it the memory starts anew.
ROOM = 1 << 18


# Classes of the bytes of plain Latin texts: white space, letters, digits, other signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that send a text to the tokenizer whole: controls, apostrophes (contractions), letters beyond Latin-1.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(9), *range(14, 32), 39, 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True


class WordTokenizer:
    """Ids of whole texts by a word-level tokenizer file, each distinct word encoded once.

    The file lower-cases, drops white space and never merges across its pre-tokens (runs of
    letters, single digits, runs of other signs), so the ids of a text are those of its
    words in order. Words are cut, hashed (64 bits) and looked up a block of texts at a
    time; texts with other than plain Latin characters go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._shown = dict(enumerate(byte_characters()))
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[int, int] = {}
        self._begin, self._width = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._ids, self._used = np.zeros(1 << 18, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        """Merge new words; the file's byte alphabet stands for their bytes."""
        merge, shown = self._tokenizer.model.tokenize, self._shown
        each = [[t.id for t in merge(w.decode("latin-1").translate(shown))] for w in words]
        width = np.array([len(x) for x in each], np.int64)
        n, total = len(self._slot), int(width.sum())
        while n + len(words) > len(self._begin):
            self._begin, self._width = (np.concatenate([x, np.zeros_like(x)]) for x in (self._begin, self._width))
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._width[n : n + len(words)] = width
        self._begin[n : n + len(words)] = self._used + np.cumsum(width) - width
        self._ids[self._used : self._used + total] = [i for x in each for i in x]
        self._used += total
        self._slot.update(zip(hashes, range(n, n + len(words))))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block of UTF-8 bytes."""
        if not len(raw):
            return [np.zeros(0, np.uint32)] * (len(at) - 1)
        odd = _OTHER[raw]
        after = np.zeros(len(raw), bool)
        after[1:] = raw[:-1] == 0xC3
        odd |= after & ((raw == 0x97) | (raw == 0xB7))
        low = _LOWER[raw]
        low[after & (low >= 0x80) & (low <= 0x9E)] += 32
        kind = _CLASS[low]
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        change[at] = True
        begins = np.flatnonzero(change[:-1] & (kind > 0))
        ends = np.flatnonzero(change[1:] & (kind > 0)) + 1
        odds = np.concatenate([[0], np.cumsum(odd)])[at]
        if len(self._slot) + len(begins) > ROOM:
            self._forget()
        h, first, inverse = np.unique(word_hashes(low, begins, ends), return_index=True, return_inverse=True)
        hashes = h.tolist()
        fresh = [i for i, x in enumerate(hashes) if x not in self._slot]
        text = low.tobytes()
        self._learn([hashes[i] for i in fresh], [text[begins[first[i]] : ends[first[i]]] for i in fresh])
        slot = np.fromiter(map(self._slot.__getitem__, hashes), np.int64, len(hashes))[inverse]
        width = self._width[slot]
        until = np.concatenate([[0], np.cumsum(width)])
        ids = self._ids[np.repeat(self._begin[slot] - until[:-1], width) + np.arange(until[-1])]
        per_text = until[np.searchsorted(begins, at)]
        return [
            ids[per_text[i] : per_text[i + 1]] if odds[i] == odds[i + 1]
            else self.whole(raw[at[i] : at[i + 1]].tobytes().decode())
            for i in range(len(at) - 1)
        ]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
        with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full windows from its begin, then the rest; ``with_ids`` adds the packed ids.

    A document's ids end with ``end_id``; null and empty texts have that id alone.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        encode, end = _tokenizer(path).encode, np.array([end_id], "<u4")
        for batch in batches:
            raw, at = parts(batch.column(1))
            for lo, hi in slices(at):
                rows = []
                each = encode(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                for doc, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), each):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for start in range(0, len(ids), window):
                        own = ids[start : start + window].tobytes()
                        rows.append((doc, start, len(own) // 4, zlib.crc32(own), len(ids), own))
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([r[5] for r in rows], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECE + ", ids binary" * with_ids)


class OpenWindows:
    """Open sequences by remaining capacity, in a segment tree that counts them."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ids: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.ids[room].append(sequence)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest open sequence with room for ``size``: (room, sequence)."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not count[node]:
                    node += 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.ids[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; ``lengths`` descend and are at most ``window``."""
    tree, sequences, offsets, n = OpenWindows(window), [], [], 0
    for size in lengths:
        found = tree.take(size)
        room, sequence = found if found else (window, n)
        n += found is None
        sequences.append(sequence)
        offsets.append(window - room)
        if room > size:
            tree.put(room - size, sequence)
    return sequences, offsets


def pack(pieces: DataFrame, window: int = 2048, per_group: int = PER_GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in every sequence.

    Pieces of no length get no place and are not expected. A sequence id holds the group in
    its upper bits. Pieces are dealt by their values and their place in the written table, so
    pieces of one id, of null ids or of copies spread like all others. Repeated rows are
    pieces each, and null ids stay null.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    pieces = stage(pieces, "pieces")
    groups = max(1, round(pieces.count() / per_group))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    order = [("length", "descending")] + [(c, "ascending") for c in ("doc_id", "start", "ids_crc32") if c in pieces.columns]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order))
        sequence, offset = best_fit(table.column("length").to_pylist(), window)
        group = table.column("bin").to_numpy().astype(np.int64) << 32
        table = table.drop_columns(["bin"]).append_column("sequence_id", pa.array(np.array(sequence, np.int64) + group))
        return table.append_column("offset", pa.array(np.array(offset, np.int64)))

    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("bin").applyInArrow(run, f"{schema}, sequence_id long, offset long")

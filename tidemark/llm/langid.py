"""Language of texts: per-word scores of byte trigrams, and Viterbi over the words of a text.

A model is fitted on a sample of labelled rows of at most about ``fit_rows`` a language,
taken by hash. A word's score for a language is the sum of its trigrams' log shares there.
The script of a word's letters narrows the languages to those that wrote it in the sample.
Viterbi then labels the words: changing language between two words costs ``penalty``, so a
text falls into spans, and its language is the one with the most letters in them.

All texts of a block take their Viterbi steps together; a text of any length is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import parts, slices, words_of
from tidemark.session import ship_package

SLOTS, FIT_ROWS, PENALTY, BLOCK = 1 << 16, 3000, 12.0, 1 << 21
NEVER = -1e4

# Scripts by first code point of their ranges; 0 is no letter. Fixed values of the public character database.
SCRIPT_STARTS = (
    (0x00C0, 1), (0x0250, 2), (0x0370, 3), (0x0400, 4), (0x0530, 5), (0x0590, 6), (0x0600, 7), (0x0700, 2), (0x0900, 8),
    (0x0980, 2), (0x0E00, 9), (0x0E80, 2), (0x10A0, 10), (0x1100, 11), (0x1200, 2), (0x1E00, 1), (0x1F00, 3), (0x2000, 0),
    (0x3040, 12), (0x3100, 13), (0x3130, 11), (0x3190, 13), (0xA000, 2), (0xAC00, 11), (0xD7B0, 2), (0xF900, 13), (0xFB00, 2),
    (0xFE00, 0), (0xFF21, 1), (0xFF66, 12), (0xFFA0, 11), (0xFFE0, 0), (0x10000, 2), (0x1F000, 0), (0x20000, 13),
)
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT = np.array([0] + [s for _, s in SCRIPT_STARTS], np.uint8)
SCRIPTS = int(_SCRIPT.max()) + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fold(raw: np.ndarray) -> np.ndarray:
    """Small letters for Latin-1 capitals."""
    low = _LOWER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    low[after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 32
    return low


def _scripts(raw: np.ndarray) -> np.ndarray:
    """Script of the character that begins at each byte; 0 for none and within characters."""
    out = np.zeros(len(raw), np.uint8)
    out[((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)] = 1
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        b = [np.concatenate([raw, np.zeros(3, np.uint8)])[lead + i].astype(np.int64) for i in range(4)]
        two = (b[0] & 31) << 6 | b[1] & 63
        three = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
        four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
        point = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
        script = _SCRIPT[np.searchsorted(_STARTS, point, side="right")]
        script[(point == 0xD7) | (point == 0xF7)] = 0
        script[(point == 0xAA) | (point == 0xB5) | (point == 0xBA)] = 1
        out[lead] = script
    return out


def features(raw: np.ndarray, at: np.ndarray):
    """Of a block: trigram slot of each word byte, its word, and per word: script, letters; words before each text."""
    begins, ends, before = words_of(raw, at)
    low = np.concatenate([[32], _fold(raw), [32]]).astype(np.uint32)
    inside = np.zeros(len(raw) + 1, np.int32)
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    place = np.flatnonzero(np.cumsum(inside)[:-1])
    word = np.repeat(np.arange(len(begins)), ends - begins)
    left, right = low[place].copy(), low[place + 2].copy()
    width = np.cumsum(ends - begins)
    left[width - (ends - begins)], right[width - 1] = 32, 32  # a neighbouring text's byte is not a neighbour
    slot = ((left * 0x9E3779B1 ^ low[place + 1] * 0x85EBCA77 ^ right * 0xC2B2AE3D) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    script = _scripts(raw)[place]
    letters = np.bincount(word, weights=script > 0, minlength=len(begins)).astype(np.int64)
    kind = np.zeros(len(begins), np.uint8)
    np.maximum.at(kind, word[script > 0], script[script > 0])
    return slot, word, kind, letters, before


def viterbi(scores: np.ndarray, before: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``scores`` has the words of all texts, text i from ``before[i]`` on."""
    n = np.diff(before)
    order = np.argsort(-n, kind="stable")
    start, n = before[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
    k = scores.shape[1]
    stay, came = np.zeros((len(scores), k), bool), np.zeros(len(scores), np.int32)
    best = np.zeros((len(n), k))
    for t, a in enumerate(active):
        d, w = best[:a], start[:a] + t
        came[w] = d.argmax(1)
        change = d.max(1)[:, None] - penalty
        stay[w] = d >= change
        np.maximum(d, change, out=d)
        d += scores[w]
    label, now = np.zeros(len(scores), np.int32), best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        w, c = start[:a] + t, now[:a]
        label[w] = c
        now[:a] = np.where(stay[w, c], c, came[w])
    return label


def _labelled(docs: DataFrame, learn: Column, fit_rows: int) -> tuple[list[str], DataFrame]:
    """Learned languages, most frequent first, and a bounded sample of (language number, text)."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").collect()  # a row a language
    langs = [r["lang"] for r in counts]
    if not langs:
        return [], rows
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, fit_rows / r["count"]))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / F.lit(1 << 30)
    return langs, rows.where(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("k"), "text")


def fit(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS):
    """(languages, trigram scores, scripts of each language). Only sums of counts reach the driver."""
    langs, sample = _labelled(docs, learn, fit_rows)
    k = len(langs)
    if not k:
        return langs, np.zeros((SLOTS, 0)), np.zeros((SCRIPTS, 0), bool)

    def count(batches):
        grams, scripts = np.zeros((k, SLOTS), np.int64), np.zeros((k, SCRIPTS), np.int64)
        for batch in batches:
            raw, at = parts(batch.column(1))
            own = np.array(batch.column(0).to_pylist(), np.int64)
            for lo, hi in slices(at):
                slot, word, kind, letters, before = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                text = np.searchsorted(before, np.arange(len(kind)), side="right") - 1
                np.add.at(grams, (own[lo:hi][text][word], slot), 1)
                np.add.at(scripts, (own[lo:hi][text], kind), 1)
        both = np.concatenate([grams, scripts], axis=1)
        a, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(both[a, b])], ["k", "slot", "n"])

    rows = sample.mapInArrow(count, "k long, slot long, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((k, SLOTS + SCRIPTS))
    table[rows["k"].to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    grams, scripts = table[:, :SLOTS] + 0.05, table[:, SLOTS:]
    scores = np.log(grams / grams.sum(1, keepdims=True)).T
    return langs, scores, (scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)).T & (scripts.T > 0)


def _rate(column: pa.Array, langs: list[str], scores: np.ndarray, writes: np.ndarray, penalty: float) -> list[tuple[str, float, str]]:
    """(language, score, spans) of every text of an Arrow column."""
    k, out = len(langs), []
    raw, at = parts(column)
    for lo, hi in slices(at, BLOCK):
        block, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        each, kinds, letters, before = [], [], [], [np.zeros(1, np.int64)]
        for a, b in slices(own):
            slot, word, kind, letter, words = features(block[own[a] : own[b]], own[a : b + 1] - own[a])
            each.append(np.stack([np.bincount(word, scores[slot, j], len(kind)) for j in range(k)], 1) if k else np.zeros((len(kind), 0)))
            kinds.append(kind)
            letters.append(letter)
            before.append(words[1:] + before[-1][-1])
        value, kind, letter, first = map(np.concatenate, (each, kinds, letters, before))
        may = writes[kind] & (kind > 0)[:, None]
        known = may.any(1)
        value = np.where(may, value, np.where(known[:, None], NEVER, 0.0))
        named = viterbi(value, first, penalty) if k else np.zeros(len(kind), np.int32)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            text = block[own[i] : own[i + 1]]
            if not k or not _has_letter(text, letter[a:b]):
                out.append(("und", 0.0, ""))
                continue
            weight = letter[a:b] * known[a:b]
            share = np.bincount(named[a:b], weights=weight, minlength=k)
            best = int(share.argmax())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(named[a:b])) + 1, [b - a]])
            spans = ",".join(f"{langs[named[a + x]]}:{x}:{y}" for x, y in zip(cuts[:-1], cuts[1:]))
            out.append((langs[best], float(share[best] / max(1, letter[a:b].sum())), spans))
    return out


def _model(docs: DataFrame, learn: Column, fit_rows: int, id_col: str, text_col: str, lang_col: str):
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs, scores, writes = fit(rows, learn, fit_rows)
    return rows, langs, docs.sparkSession.sparkContext.broadcast((scores.astype(np.float32), writes))


def label(docs: DataFrame, learn: Column, penalty: float = PENALTY, fit_rows: int = FIT_ROWS,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` of every row; ``learn`` names the rows whose language may be learned.

    ``lang_pred`` is ``und`` for a null text and one without a letter, or if nothing could be
    learned; texts in scripts that no learned language writes get the most frequent language
    with score 0. ``score`` is the share of the text's letters in spans of that language.
    ``spans`` lists ``language:begin:end`` in words, comma-joined, empty for ``und``. Ties go to
    the more frequent language. Repeated rows are labelled each; other columns are ignored.
    """
    rows, langs, model = _model(docs, learn, fit_rows, id_col, text_col, lang_col)

    def run(batches):
        for batch in batches:
            if len(batch):
                cols = [pa.array(c) for c in zip(*_rate(batch.column(1), langs, *model.value, penalty))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "lang_pred", "score", "spans"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans string")


def keep_identified(docs: DataFrame, learn: Column, least: float = 0.5, penalty: float = PENALTY, fit_rows: int = FIT_ROWS,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not ``und`` and whose score is ``least`` or more.

    Each row is decided where it is read, by its own text: null and repeated ids do not matter.
    """
    _, langs, model = _model(docs, learn, fit_rows, id_col, text_col, lang_col)

    @F.arrow_udf("boolean")
    def sure(texts: pa.Array) -> pa.Array:
        return pa.array([lang != "und" and score >= least for lang, score, _ in _rate(texts, langs, *model.value, penalty)], pa.bool_())

    return docs.where(sure(F.col(text_col)))


def _has_letter(text: np.ndarray, letters: np.ndarray) -> bool:
    """By Unicode category where letters beyond ASCII decide it."""
    small = text | 32
    if ((small >= 97) & (small <= 122) & (text < 128)).any():
        return True
    return bool((text >= 128).any()) and any(c.isalpha() for c in set(text.tobytes().decode("utf-8", "replace")))

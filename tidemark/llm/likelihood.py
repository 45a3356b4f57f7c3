"""Quality rules: counts of a text, and how much likelier its n-grams are in trusted texts than in the corpus.

A text is cut into tokens (runs of letters, of digits, of other signs); its tokens and
pairs of neighbouring tokens are hashed into buckets. Two multinomials are counted over the
buckets: one of all texts of the corpus, one of trusted target texts. A bucket's weight is
the logarithm of its share in the target over its share in the corpus, both with ``PRIOR``
counts that they agree, so what is rare weighs little. A text's score is the mean weight of
its n-grams: the likelihood ratio, length-normalised. Every text is held against one
threshold; nothing is drawn.

The corpus is read twice, without a shuffle of texts: once to count, once to score. Tasks
exchange sums of buckets. Buckets grow with the number of documents; the table of weights
is 4 bytes times their number, at most ``MOST_BUCKETS``. Counts of all rules are made for
all texts of a block together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import EXACT_VALUE, IS_SPACE, mix, parts, slices, word_hashes, words_of
from tidemark.session import ship_package

TARGET_ROWS, PRIOR, THRESHOLD = 20_000, 32.0, -0.1
LEAST_BUCKETS, MOST_BUCKETS = 1 << 10, 1 << 18
MIN_WORDS, MOST_REPEATED = 50, 50

_SIGN, _DIGIT, _LETTER = 3, 2, 1
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[IS_SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_PAIR = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def buckets_for(documents: int) -> int:
    """A power of two near four buckets a document."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, (4 * documents - 1).bit_length())))


def ngrams(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token and pair of neighbouring tokens of a block, and the text each is of."""
    kind = _CLASS[raw]
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    begins = np.flatnonzero(change[:-1] & (kind > 0))
    ends = np.flatnonzero(change[1:] & (kind > 0)) + 1
    text = np.searchsorted(at, begins, side="right") - 1
    h = word_hashes(raw, begins, ends, EXACT_VALUE)
    same = text[1:] == text[:-1]
    both = mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])[same]
    return (np.concatenate([h, both]) % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[1:][same]])


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the flags of a block lie in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _again(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes stand more than once in their text, and which of them are not the first there."""
    own = mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse, count = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(h), bool)
    later[first] = False
    return count[inverse] > 1, later


def measure(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row a text: words, code points in words, symbols, repeated lines, words in repeated windows of three."""
    n = len(at) - 1
    begins, ends, before = words_of(raw, at)
    words = np.diff(before)
    chars = _per_text(~IS_SPACE[raw] & ((raw & 0xC0) != 0x80), at)
    symbols = _per_text(_SYMBOL[raw], at)
    # Lines: from a text's begin or a line feed to the next line feed or the text's end.
    feed = np.flatnonzero(raw == 10)
    inside = feed[np.searchsorted(at, feed, side="right") <= n]
    starts = np.unique(np.concatenate([at[:-1], inside + 1]))
    of = np.searchsorted(at, starts, side="right") - 1
    stops = np.minimum(np.append(starts[1:], len(raw)), at[np.minimum(of + 1, n)])
    stops = np.where((stops > starts) & (raw[np.maximum(stops - 1, 0)] == 10), stops - 1, stops) if len(raw) else stops
    filled = np.searchsorted(begins, stops) > np.searchsorted(begins, starts)
    starts, stops, of = starts[filled], stops[filled], of[filled]
    _, later = _again(word_hashes(raw, starts, stops, EXACT_VALUE), of)
    lines = np.bincount(of[later], minlength=n)
    # Windows of three words, none across texts.
    text = np.searchsorted(before, np.arange(len(begins)), side="right") - 1
    covered = np.zeros(len(begins) + 1, np.int64)
    if len(begins) > 2:
        h = word_hashes(raw, begins, ends, EXACT_VALUE)
        whole = np.flatnonzero(text[2:] == text[:-2])
        three = mix(mix(h[whole] * _PAIR[0] + h[whole + 1]) * _PAIR[1] + h[whole + 2])
        twice = whole[_again(three, text[whole])[0]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    repeated = np.bincount(text[np.cumsum(covered)[:-1] > 0], minlength=n)
    return np.stack([words, chars, symbols, lines, repeated], 1)


def weights(docs: DataFrame, target: DataFrame, target_rows: int = TARGET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weight of every bucket: counts of all texts, and of at most about ``target_rows`` trusted ones, taken by hash.

    ``target`` holds the ids of trusted documents in its first column. Sums of buckets reach the driver.
    """
    buckets = buckets_for(docs.count())
    trusted = target.select(F.col(target.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 30)) / F.lit(1 << 30)
    # The limit is the bound that makes the broadcast safe; the draw stays well below it.
    some = trusted.where(draw < min(1.0, target_rows / max(trusted.count(), 1))).limit(2 * target_rows).withColumn("trusted", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(some), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")

    def count(batches):
        seen, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            raw, at = parts(batch.column(1))
            trusted = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(at):
                bucket, text = ngrams(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], buckets)
                seen += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[trusted[lo:hi][text]], minlength=buckets)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own.astype(np.int32), seen[own], good[own])], ["bucket", "seen", "good"])

    sums = rows.mapInArrow(count, "bucket int, seen long, good long").groupBy("bucket").agg(
        F.sum("seen").alias("seen"), F.sum("good").alias("good")).toPandas()  # at most MOST_BUCKETS rows
    seen, good = np.zeros(buckets), np.zeros(buckets)
    seen[sums["bucket"].to_numpy(np.int64)] = sums["seen"].to_numpy(float)
    good[sums["bucket"].to_numpy(np.int64)] = sums["good"].to_numpy(float)
    if not good.sum():
        return np.zeros(buckets, np.float32)
    return np.log((good * (seen.sum() / good.sum()) + PRIOR) / (seen + PRIOR)).astype(np.float32)


def apply_rules(docs: DataFrame, target: DataFrame, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS, min_words: int = MIN_WORDS,
                most_repeated: int = MOST_REPEATED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)`` of every row.

    Words are cut at space and the bytes 9 to 13. ``base_failed`` marks texts of fewer words
    than ``min_words`` or with more than ``most_repeated`` per cent of them in repeated
    windows of three; those are not kept, all others are if ``score >= threshold``.
    ``score`` is the mean weight of the text's n-grams, 0 where it has none. Null texts are
    empty. Without trusted documents every score is 0. Repeated rows are rated and counted
    each; null ids are rated and never trusted; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(weights(rows, target, target_rows))

    def run(batches):
        weight = model.value
        for batch in batches:
            raw, at = parts(batch.column(1))
            counts, scores = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
            for lo, hi in slices(at):
                block, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                counts.append(measure(block, own))
                bucket, text = ngrams(block, own, len(weight))
                total = np.bincount(text, weight[bucket], hi - lo)
                scores.append(total / np.maximum(np.bincount(text, minlength=hi - lo), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in np.concatenate(counts).T.astype(np.int64)), pa.array(np.concatenate(scores))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    rated = rows.mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rated.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))

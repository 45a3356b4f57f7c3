"""Personal data: patterns, and terms that give protected values away.

The patterns find e-mail addresses, network addresses, card and phone numbers; their values
are the protected entities. The corpus is asked how strongly each term of the texts with a
mention, wherever it stands in them, reveals the entity: the pointwise mutual information of term and entity,
log(n(t, c) * N / (n(t) * n(c))), as a share of the entity's own information,
log(N / n(c)), with N and every n counting different texts, so copies count once. Terms
above ``threshold`` of it in ``support`` texts with the entity are disclosures: one that
reveals a single entity is removed, one that reveals several is generalised, at all its
places in all texts. Words that a pattern's span touches are no terms.

Texts are read twice: once for mentions and the distinct terms of texts that hold one, once
for the places of the candidate terms, which a bit filter of fixed size picks out. A pair is
a candidate unless the texts with mentions alone hold its term too often. What is known of a
text is kept under its digest, so copies share it. Both passes send rows for mentions and
candidate terms and the terms of texts with a mention, never other texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sparse import split
from tidemark.llm.textbytes import parts, slices
from tidemark.session import ship_package, stage

KINDS = ("email", "ip", "card", "phone")
SUPPORT, THRESHOLD = 3, 0.9
FILTER_BITS = 1 << 21

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's match never begins within a run of digits: what fails from the run's begin fails inside it.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"[^\s]+")
_EDGE = ".,;:!?()[]\"'"
#: Characters a long text is cut into at a time, at white space.
_STRETCH = 1 << 20


def term_of(word: str) -> str:
    """The term a word stands for. Both passes cut words by ``_WORD`` and name them by this."""
    return word.lower().strip(_EDGE)


def words_in(text: str) -> set[str]:
    """Distinct words of ``_WORD``; ``str.split`` parts at the same white space."""
    out: set[str] = set()
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + _STRETCH)
        end = gap.start() if gap else len(text)
        out.update(text[at:end].split())
        at = end
    return out


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) in code points, by kind and begin."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _value(kind: str, text: str) -> str:
    return kind + ":" + (text.lower() if kind == "email" else text if kind == "ip" else "".join(c for c in text if c.isdigit()))


def places(text: str, spans):
    """(term, begin, end) of the words that no span touches."""
    at, spans = 0, sorted((a, b) for _, a, b in spans)
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        # Spans of several kinds may overlap: those behind ``at`` that begin before the word ends.
        k, free = at, True
        while free and k < len(spans) and spans[k][0] < m.end():
            free = spans[k][1] <= m.start()
            k += 1
        if free and (term := term_of(m[0])):
            yield term, m.start(), m.end()


def key_of(text: str) -> bytes:
    """128 bits that name a text; copies share it. ``sanitise`` makes the same in Spark."""
    return hashlib.md5(text.encode(), usedforsecurity=False).digest()


MENTIONS = "array<struct<kind:string,start:long,stop:long>>"


def _find(batches):
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        column = batch.column(1).cast(pa.large_string())
        for lo, hi in slices(parts(column)[1]):
            spans, entities, terms, keys = [], [], [], []
            for text in column.slice(lo, hi - lo).to_pylist():
                text = text or ""
                own = base_spans(text)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in own])
                entities.append(list({_value(k, text[a:b]) for k, a, b in own}))
                terms.append(list({t for t, _, _ in places(text, own)}) if own else [])
                keys.append(key_of(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(spans, spans_type), pa.array(entities, pa.list_(pa.string())),
                 pa.array(terms, pa.list_(pa.string())), pa.array(keys, pa.binary())], ["doc_id", "base", "entities", "terms", "key"])


def _bit(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % FILTER_BITS


def _known_terms(allowed: bytes, room: int = 1 << 16):
    """A function from a word to its term if the bit filter lets that through, else None; remembers ``room`` words."""
    met: dict[str, str | None] = {}

    def get(word: str) -> str | None:
        if word not in met:
            if len(met) >= room:
                met.clear()
            term = term_of(word)
            bit = _bit(term)
            met[word] = term if term and allowed[bit >> 3] >> (bit & 7) & 1 else None
        return met[word]

    return get


def _term_filter(terms: DataFrame):
    """A broadcast bit filter of ``terms``."""

    def mark(batches):
        for batch in batches:
            bit = np.array([_bit(t) for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 3), pa.array(1 << (bit & 7))], ["word", "bits"])

    bits = terms.select("term").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = bits.toPandas()  # at most FILTER_BITS / 8 rows
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return terms.sparkSession.sparkContext.broadcast(table.tobytes())


def _term_places(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(key, term, start, stop)`` of all places of ``terms`` in all different texts, by a second pass over them."""
    shared = _term_filter(terms)

    def mark(batches):
        allowed = shared.value
        get, none = _known_terms(allowed), not any(allowed)
        for batch in batches:
            if none:
                continue
            column = batch.column(0).cast(pa.large_string())
            for lo, hi in slices(parts(column)[1]):
                out: list[tuple] = []
                for text in column.slice(lo, hi - lo).to_pylist():
                    if own := {get(w) for w in words_in(text or "")} - {None}:
                        key = key_of(text)
                        out += [(key, *p) for p in places(text, base_spans(text)) if p[0] in own]
                key, term, start, stop = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(term, pa.string()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
                    ["key", "term", "start", "stop"])

    found = texts.select("text").mapInArrow(mark, "key binary, term string, start long, stop long")
    return found.join(terms.select("term").distinct(), "term", "left_semi").distinct()


def _counted(name: str) -> Column:
    """The count ``name`` of a candidate, which the second pass must have met."""
    return F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit("no document holds the term "), F.col("term"))).cast("long")).otherwise(F.col(name))


def _found(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, base, key)`` of every row, and ``(key, added)`` of the texts with added spans."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_find, f"doc_id long, base {MENTIONS}, entities array<string>, terms array<string>, key binary")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "private")
    total = F.lit(float(rows.select("key").distinct().count()))
    # One row of each different text with a mention.
    first = rows.where(F.size("entities") > 0).groupBy("key").agg(F.min("row").alias("row")).select("row")
    first = stage(first, "private-first")
    each = rows.where(F.size("entities") > 0).select("row", F.explode("entities").alias("entity")).join(first, "row", "left_semi")
    entities = stage(each.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "private-entities")
    words = rows.where(F.size("terms") > 0).select("row", "terms")
    pairs = each.join(entities.select("entity"), "entity", "left_semi").join(words, "row").select("entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    # Texts with mentions hold a term no oftener than all texts do.
    least = words.join(first, "row", "left_semi").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    own = F.log(total / F.col("n_entity"))

    def tells(n: str) -> Column:
        return (own > 0) & (F.log(F.col("both") * total / (F.col(n) * F.col("n_entity"))) >= threshold * own)

    pairs = pairs.join(entities, "entity").join(least, "term").where(tells("least")).drop("least")
    pairs = stage(pairs, "private-pairs")
    hits = stage(_term_places(texts, pairs), "private-places")
    counts = hits.groupBy("term").agg(F.count_distinct("key").alias("n_term"))
    telling = pairs.join(counts, "term", "left").withColumn("n_term", _counted("n_term")).where(tells("n_term")).select("entity", "term")
    breadth = stage(
        telling.groupBy("term").agg(F.when(F.count("*") > 1, "generalised").otherwise("removed").alias("kind")), "private-telling")
    added = hits.join(breadth, "term").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "stop"))).alias("added"))
    return rows.select("doc_id", "base", "key"), added


def find(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)`` of every row: pattern spans, and spans of terms that disclose.

    ``base`` lists (kind, start, stop), ``added`` the same with kind ``removed`` or
    ``generalised``; places are code points, the end exclusive. Null texts are empty.
    Repeated rows stay, and equal texts share their added spans. Other columns are ignored.
    """
    rows, added = _found(docs, support, threshold, id_col, text_col)
    none = F.expr(f"cast(array() as {MENTIONS})")
    return rows.join(added, "key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.concat("base", "added")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with every span replaced: ``[email]`` and so on, ``[term]`` for generalised terms, nothing for removed ones.

    A null text stays null. Columns and rows are those of ``docs``. Spans belong to texts, so rows
    with null ids and different texts under one id are treated like all others.
    """
    ship_package(docs.sparkSession)
    _, added = _found(docs, id_col=id_col, text_col=text_col, **settings)
    text = F.col(text_col).cast("string")
    # Few texts have added spans: a filter by a hash tells the others, which are not shuffled.
    extra = stage(added.select(F.col("key").alias("_key"), _half(F.col("key")).alias("_half"), F.col("added").alias("_added")), "private-added")
    named = docs.withColumn("_key", F.unhex(F.md5(text.cast("binary"))))
    rest, some = split(named.withColumn("_half", _half(F.col("_key"))), "_half", extra)
    some = some.drop("_half").join(extra.drop("_half"), "_key", "left")
    none = F.lit(None).cast(MENTIONS)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, added: pa.Array) -> pa.Array:
        return pa.array([None if t is None else replaced(t, a or []) for t, a in zip(texts.to_pylist(), added.to_pylist())], pa.string())

    return rest.withColumn("_added", none).withColumn(text_col, cleaned(text, F.col("_added"))).select(docs.columns).union(
        some.withColumn(text_col, cleaned(text, F.col("_added"))).select(docs.columns))


def _half(key: Column) -> Column:
    """64 bits of a text's 128; -1 for a null text, which has no spans."""
    return F.coalesce(F.xxhash64(key), F.lit(-1))


def replaced(text: str, added: list[dict]) -> str:
    """``text`` with its pattern spans and the ``added`` ones replaced; overlapping spans go together, named by the first."""
    spans = base_spans(text) + [(s["kind"], s["start"], s["stop"]) for s in added]
    done, kept = 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < done:
            done = max(done, b)
            continue
        kept += [text[done:a], "" if kind == "removed" else "[term]" if kind == "generalised" else f"[{kind}]"]
        done = b
    return "".join(kept) + text[done:]

"""Raw post chunks to the cleaned post table.

A raw chunk is a gzip CSV whose author, view-count and link cells hold Python
literals as text. Everything but those three cells is plain Column work.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as K
from tidemark.session import shuffle_width

# Fixed pattern: a datetime call with three to seven whole numbers, optionally in UTC.
_DATETIME = re.compile(
    r"datetime\.datetime\(\s*(\d+(?:\s*,\s*\d+){2,6})\s*(?:,\s*tzinfo\s*=\s*datetime\.timezone\.utc\s*)?,?\s*\)"
)

_LONG_FIELDS = ("followersCount", "friendsCount", "statusesCount", "favouritesCount", "listedCount", "mediaCount")
_FLAG_FIELDS = ("verified", "blue")

PARSED = T.StructType(
    [
        T.StructField(
            f"user_{f}",
            T.LongType() if f in _LONG_FIELDS else T.BooleanType() if f in _FLAG_FIELDS else T.StringType(),
        )
        for f in K.USER_FIELDS
    ]
    + [T.StructField("view_count", T.LongType()), T.StructField("link_urls", T.ArrayType(T.StringType()))]
)


def iso_datetime(match: re.Match) -> str:
    """A quoted ISO text in UTC; missing time parts are 0, microseconds only when present."""
    parts = [int(p) for p in match.group(1).split(",")]
    year, month, day, hour, minute, second, micro = parts + [0] * (7 - len(parts))
    fraction = f".{micro:06d}" if micro else ""
    return f"'{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}{fraction}+00:00'"


def literal(text: object) -> object:
    """The value of a Python literal cell, None when it is empty or broken."""
    if not isinstance(text, str) or not text:
        return None
    try:
        return ast.literal_eval(_DATETIME.sub(iso_datetime, text))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def whole(value: object) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def links(value: object) -> list[str]:
    """Non-empty expanded addresses of a link list."""
    found = [v.get("expanded_url") for v in value if isinstance(v, dict)] if isinstance(value, (list, tuple)) else []
    return [u for u in found if isinstance(u, str) and u]


def _row(user: object, views: object, link_cell: object) -> dict:
    author, count = literal(user), literal(views)
    author = author if isinstance(author, dict) else {}
    row: dict = {}
    for f in K.USER_FIELDS:
        v = author.get(f)
        if f in _LONG_FIELDS:
            v = whole(v)
        elif f in _FLAG_FIELDS:
            v = None if v is None else bool(v)
        else:
            v = None if v is None else str(v)
        row[f"user_{f}"] = v
    row["view_count"] = whole(count.get("count")) if isinstance(count, dict) else None
    row["link_urls"] = links(literal(link_cell))
    return row


@F.pandas_udf(PARSED)
def parse_cells(user: pd.Series, views: pd.Series, link_cells: pd.Series) -> pd.DataFrame:
    """The three literal cells of a row as typed fields, one Arrow batch at a time."""
    rows = [_row(*cells) for cells in zip(user, views, link_cells)]
    frame = pd.DataFrame(rows, columns=PARSED.names)
    for f in PARSED.fields:
        if isinstance(f.dataType, T.LongType):
            frame[f.name] = frame[f.name].astype("Int64")
        elif isinstance(f.dataType, T.BooleanType):
            frame[f.name] = frame[f.name].astype("boolean")
    return frame


def datetime_literal_timestamp(text: Column) -> Column:
    """The same datetime literal read by Columns alone, as a timestamp."""
    inner = F.regexp_extract(text, r"datetime\.datetime\(\s*([\d,\s]+)", 1)
    parts = F.transform(F.split(F.rtrim(F.regexp_replace(inner, r"\s", ""), F.lit(",")), ","), lambda p: p.try_cast("int"))

    def at(i: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0))

    seconds = at(6) + F.coalesce(F.try_element_at(parts, F.lit(7)), F.lit(0)) / F.lit(1e6)
    return F.when(
        F.size(parts) >= 3,
        F.try_make_timestamp(at(1), at(2), at(3), at(4), at(5), seconds.cast("decimal(16,6)")),
    )


def _is_embedded(name: str) -> Column:
    """A quoted or reposted post sits here: not null, not empty, not the text false."""
    c = F.col(name).cast("string")
    return c.isNotNull() & (F.lower(c) != "false") & (c != "")


def clean(raw: DataFrame) -> DataFrame:
    """Cleaned posts from raw text columns; drops what later work never reads."""
    parsed = raw.withColumn("__p", parse_cells("user", "viewCount", "links"))
    numeric = [c for c in K.NUMERIC_COLUMNS if c in raw.columns]
    rest = [c for c in raw.columns if c not in (*K.DROPPED_COLUMNS, *numeric, "quotedTweet", "retweetedTweet", "id", "id_str")]
    number = {c: F.col(c).try_cast("double") for c in numeric}
    reply = number["in_reply_to_status_id_str"].isNotNull()
    quote, repost = _is_embedded("quotedTweet"), _is_embedded("retweetedTweet")
    user = [F.col(f"__p.user_{f}").alias(f"user_{f}") for f in K.USER_FIELDS if f != "created"]
    return parsed.select(
        *[F.col(c).cast("string").alias(c) for c in ("id", "id_str") if c in raw.columns],
        *[number[c].alias(c) for c in numeric],
        *rest,
        F.col("__p.view_count").alias("view_count"),
        F.coalesce("__p.link_urls", F.array().cast("array<string>")).alias("link_urls"),
        *user,
        F.try_to_timestamp("__p.user_created").alias("user_created_at"),
        quote.alias("quotedTweet"),
        repost.alias("retweetedTweet"),
        reply.alias("is_reply"),
        quote.alias("is_quote"),
        repost.alias("is_retweet"),
        (~(reply | quote | repost)).alias("is_original"),
        F.timestamp_micros((number["epoch"] * F.lit(1e6)).cast("long")).alias("created_at"),
    )


# ---- scans ---------------------------------------------------------------

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def chunk_paths(spark: SparkSession, folder: str, max_chunks: int | None = None) -> list[str]:
    """Sorted chunk files of a folder; an error when there is none. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").load(folder).select("path")
    paths = sorted(r["path"] for r in files.collect())
    if not paths:
        raise FileNotFoundError(f"no *.csv.gz chunk in {folder}")
    return paths[:max_chunks] if max_chunks else paths


def read_raw(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Raw text columns. Gzip files do not split, so rows are spread right after the read."""
    raw = spark.read.options(**_CSV).csv(paths if isinstance(paths, str) else list(paths))
    return spread(raw, partitions)


def spread(raw: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even partitions for the parse, which costs far more than moving its rows."""
    return raw.repartition(partitions or shuffle_width(raw.sparkSession))


def load_part(
    spark: SparkSession, folder: str, max_chunks: int | None = None, cache_path: str | None = None
) -> DataFrame:
    """Cleaned posts of a folder; with ``cache_path`` parsed once and read back after."""
    if cache_path and _exists(spark, cache_path):
        return spark.read.parquet(cache_path)
    posts = clean(read_raw(spark, chunk_paths(spark, folder, max_chunks)))
    if not cache_path:
        return posts
    posts.write.mode("overwrite").parquet(cache_path)
    return spark.read.parquet(cache_path)


def load_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of cleaned parts; a part lacking a column gets nulls."""
    parts = [spark.read.parquet(p) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def existing_parts(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of ``paths`` that hold a readable table; a run with a missing one is skipped."""
    return [p for p in paths if _exists(spark, p)]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True

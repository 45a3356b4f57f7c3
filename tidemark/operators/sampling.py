"""Repeatable samples: rows are ordered by a hash of (id, seed).

A sample depends on ids and seed alone, not on partitioning or run. A sample of n
rows is the n least hashes of its stratum: counts of the hash's leading bits, merged
over tasks, give a bound that few more than n rows pass, and only those are shuffled.
Ranks inside a stratum come from ordered counts of the hash, so a stratum of any size
is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.columns import count_or_zero, flag_or_false, interval_bucket, literal_doubles, no_nan
from tidemark.operators.profiles import quantile_edges
from tidemark.operators.ranks import exact_quantiles, first_by, ordered_counts, quantile_scalars
from tidemark.session import stage

_MODULUS = 2147483647
#: A hash has 31 bits; its leading 12 are counted.
_TAIL_BITS = 19


def hash_order(key: Column, seed: int) -> Column:
    """A 31-bit mix of an integer id and the seed, the same in every engine."""
    h = F.pmod(key.cast("long") + F.lit(seed), F.lit(_MODULUS))
    for factor in (48271, 69621, 1103515245):
        h = h.bitwiseXOR(F.shiftright(h, 15))
        h = F.pmod(h * F.lit(factor).cast("long") + F.lit(seed), F.lit(_MODULUS))
    return h


def group_key(columns: Sequence[str]) -> Column:
    """The columns as one text that is never null: nulls are equal, so a plain join on it keeps them."""
    return F.to_json(F.struct(*columns)) if columns else F.lit("")


def sample_order(df: DataFrame, key: str, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """Add ``sample_rank`` (1-based within stratum) and ``stratum_size``.

    The order is (hash, key): equal hashes are told apart by the key, folded into
    one sortable number. A null stratum is a stratum; rows with a null key are
    hashed by all their columns, and only equal ones among them are in no order.
    """
    return _ranked(_hashed(df, key, seed, strata), key).drop("__h", "__g")


def _hashed(df: DataFrame, key: str, seed: int, strata: Sequence[str]) -> DataFrame:
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(_MODULUS))
    return df.withColumn("__h", F.coalesce(hash_order(F.col(key), seed), spread).cast("double")).withColumn("__g", group_key(strata))


def _ranked(tied: DataFrame, key: str) -> DataFrame:
    ordered = ordered_counts(tied, "__h", ["__g"])
    base = ordered.select("__g", "__h", (F.col("cum_n") - F.col("n")).alias("__base"), F.col("tot_n").alias("stratum_size"))
    # Rows that share a hash are few: a 31-bit hash of distinct ids.
    same = Window.partitionBy("__g", "__h").orderBy(key)
    return (
        tied.join(base, ["__g", "__h"])
        .withColumn("sample_rank", F.col("__base") + F.row_number().over(same))
        .drop("__base")
    )


def least_ranked(df: DataFrame, key: str, seed: int, strata: Sequence[str], limits: int | DataFrame) -> DataFrame:
    """The rows that ``sample_order`` ranks up to a limit, with the same ``sample_rank`` and ``stratum_size``.

    ``limits`` is one number or a table ``(__g, limit)`` by ``group_key`` of the strata. No
    row beyond a stratum's bound leaves its task: the counts that give the bounds are at
    most 4,096 a stratum, and a bound lets through its n rows and about n_stratum / 4,096 more.
    """
    tied = _hashed(df, key, seed, strata)
    cell = F.shiftright(F.col("__h").cast("long"), _TAIL_BITS)
    counts = tied.groupBy("__g", cell.alias("__cell")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("__g")
    counts = counts.select(
        "__g", "__cell", F.sum("n").over(own.orderBy("__cell")).alias("upto"), F.sum("n").over(own).alias("__size"))
    counts = counts.withColumn("limit", F.lit(limits)) if isinstance(limits, int) else counts.join(limits, "__g")
    enough = F.min(F.when(F.col("upto") >= F.col("limit"), F.col("__cell")))
    bounds = counts.groupBy("__g").agg(
        F.coalesce(enough, F.max("__cell")).alias("__bound"), F.max("__size").alias("__size"), F.max("limit").alias("__limit"))
    kept = tied.join(stage(bounds, "sample-bounds"), "__g").where(cell <= F.col("__bound")).drop("__bound")
    ranked = _ranked(stage(kept, "sample-rows"), key).withColumn("stratum_size", F.col("__size"))
    return ranked.where(F.col("sample_rank") <= F.col("__limit")).drop("__h", "__g", "__size", "__limit")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = K.SEED) -> DataFrame:
    """``n`` rows without replacement; a smaller pool is repeated until n are drawn."""
    if n <= 0:
        raise ValueError("n must be positive")
    return stratified_sample(df.withColumn("__all", F.lit(1)), n, key, ["__all"], seed).drop("__all")


def originals(posts: DataFrame) -> DataFrame:
    return posts.where(flag_or_false("is_original"))


def seed_columns(posts: DataFrame, extra: Sequence[str] = ("user_created_at", "credibility_label")) -> DataFrame:
    """The seed columns a table has, plus ``extra`` ones."""
    return posts.select(*[c for c in (*K.SEED_COLUMNS, *extra) if c in posts.columns])


def stratified_sample(
    df: DataFrame, n: int, key: str, strata: Sequence[str], seed: int = K.SEED,
    replacement: bool = True,
) -> DataFrame:
    """``n`` rows per stratum; ``draw`` numbers the copies of a row.

    A stratum smaller than ``n`` is used again and again in hash order when
    ``replacement``, otherwise taken whole.
    """
    first = least_ranked(df, key, seed, strata, n)
    if not replacement:
        return first.withColumn("draw", F.lit(1)).drop("sample_rank", "stratum_size")
    copies = F.floor((F.lit(n) - F.col("sample_rank")) / F.col("stratum_size")) + 1
    return first.withColumn("draw", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop(
        "sample_rank", "stratum_size"
    )


def require_strata(df: DataFrame, column: str, values: Sequence[str]) -> None:
    """Raise when a wanted stratum has no row."""
    have = {r[0] for r in df.where(F.col(column).isin(list(values))).groupBy(column).agg(F.count(F.lit(1))).collect()}
    missing = sorted(set(values) - have)
    if missing:
        raise ValueError(f"no rows with {column} in {missing}")


def label_sample(posts: DataFrame, n: int, key: str, label: str = "credibility_label", seed: int = K.SEED) -> DataFrame:
    """``n`` rows from each of the two classes, with replacement when short."""
    require_strata(posts, label, (K.LOW, K.HIGH))
    return stratified_sample(posts.where(F.col(label).isin(K.LOW, K.HIGH)), n, key, [label], seed)


def unlabelled_sample(posts: DataFrame, n: int, key: str, label: str = "credibility_label", seed: int = K.SEED) -> DataFrame:
    """``n`` rows without a label; ``mixed`` is a label."""
    return sample_rows(posts.where(F.col(label).isNull()), n, key, seed)


def claim_sample(posts: DataFrame, n: int, key: str, text: str, label: str = "credibility_label", seed: int = K.SEED) -> DataFrame:
    """Up to ``n`` rows per class among texts of usable length, never repeated."""
    usable = posts.where(F.col(label).isin(K.LOW, K.HIGH) & (F.length(text) >= K.MIN_TEXT_LENGTH))
    return stratified_sample(usable, n, key, [label], seed, replacement=False)


def baseline_sample(posts: DataFrame, n: int, key: str, part: str, seed: int = K.SEED) -> DataFrame:
    """Up to ``n`` rows of every part, never repeated."""
    return stratified_sample(posts, n, key, [part], seed, replacement=False)


def follower_strata(users: DataFrame, count: str, key: str, bins: int = 5, seed: int = K.SEED) -> DataFrame:
    """Add ``stratum``: equal-frequency follower bin, right-closed, equal edges collapsed.

    When fewer than two bins are left, positions in (count, hash) order decide.
    """
    filled = users.withColumn("__count", count_or_zero(count))
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = sorted(set(exact_quantiles(filled, "__count", names).select(*names).first()) - {None})
    if len(edges) > 2:
        bucket = interval_bucket(F.col("__count"), literal_doubles(edges), "right")
        return filled.withColumn("stratum", bucket).drop("__count")
    base = ordered_counts(filled, "__count").select(
        "__count", (F.col("cum_n") - F.col("n")).alias("__base"), F.col("tot_n").alias("__all")
    )
    position = F.col("__base") + F.col("sample_rank")
    bucket = F.floor(position / F.col("__all") * F.lit(bins)).cast("int")
    return (
        sample_order(filled, key, seed, ["__count"])
        .join(base, "__count")
        .withColumn("stratum", F.least(F.greatest(bucket, F.lit(0)), F.lit(bins - 1)))
        .drop("__count", "__base", "__all", "sample_rank", "stratum_size")
    )


def user_sample(
    posts: DataFrame, n: int, user: str = "user_id_str", order: Sequence[str] = ("epoch", "id_str"),
    followers: str = "user_followersCount", blue: str = "user_blue", bins: int = 5, seed: int = K.SEED,
) -> DataFrame:
    """``n`` users spread evenly over follower bin by badge, first row per user.

    The remainder goes to the first cells in order; a short cell repeats users.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    users = first_by(posts, [user], order).withColumn(
        "__key", F.coalesce(F.col(user).try_cast("long"), F.xxhash64(user))
    )
    celled = follower_strata(users, followers, "__key", bins, seed).withColumn(
        "cell", F.concat_ws("_", F.col("stratum").cast("string"), flag_or_false(blue).cast("int").cast("string"))
    )
    celled = stage(celled, "celled-users")
    # At most bins x 2 cells: an allocation table, not data.
    in_order = Window.partitionBy(F.lit(1)).orderBy("cell")
    cells = celled.select("cell").distinct().withColumn("__i", F.row_number().over(in_order))
    n_cells = F.max("__i").over(Window.partitionBy(F.lit(1)))
    quota = cells.withColumn("__n", n_cells).select(
        group_key(["cell"]).alias("__g"),
        (F.floor(F.lit(n) / F.col("__n")) + F.when(F.col("__i") <= F.pmod(F.lit(n), F.col("__n")), 1).otherwise(0)).alias("limit"),
    )
    quota = stage(quota, "quota")
    picked = least_ranked(celled, "__key", seed, ["cell"], quota).withColumn("__g", group_key(["cell"])).join(quota, "__g")
    copies = F.floor((F.col("limit") - F.col("sample_rank")) / F.col("stratum_size")) + 1
    return picked.withColumn("draw", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop(
        "sample_rank", "stratum_size", "limit", "__g", "__key"
    )


def matched_controls(
    posts: DataFrame, cases: DataFrame, key: str, stratum: str, exact: Sequence[str] = (),
    per_case: int = K.CONTROLS_PER_CASE, seed: int = K.SEED,
) -> DataFrame:
    """Controls equal to the cases on ``stratum`` and ``exact``, ``per_case`` for each.

    Posts that are cases are out of the pool. A stratum with no candidate takes
    them one step lower, beside what that step's own cases need. No control is
    drawn twice.
    """
    pool = posts.join(cases.select(key), key, "left_anti")
    group = [stratum, *exact]
    need = (
        posts.join(cases.select(key), key, "left_semi").groupBy(*group)
        .agg((F.count(F.lit(1)) * per_case).alias("need"))
    )
    sizes = pool.select(group_key(group).alias("__g")).distinct().withColumn("present", F.lit(True))
    demand = need.withColumn("__g", group_key(group)).join(sizes, "__g", "left").select(
        F.when(F.col("present"), F.col(stratum)).otherwise(F.col(stratum) - 1).cast(posts.schema[stratum].dataType).alias(stratum),
        *exact, "need",
    )
    # Two strata may draw on one pool stratum.
    total = demand.groupBy(group_key(group).alias("__g")).agg(F.sum("need").alias("limit"))
    return least_ranked(pool, key, seed, group, total).drop("sample_rank", "stratum_size")


def values_at(df: DataFrame, columns: Sequence[str], position: int) -> dict[str, tuple[int, int, int]]:
    """Per hash column, the value at a 1-based position in order, the rows below it and the rows that share it.

    Counts of the leading bits find the cell of the position; only its values are counted one by one. No row is shuffled.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("long").alias("h")) for c in columns])
    long = df.select(F.inline(cells)).where(F.col("h").isNotNull()).withColumn("cell", F.shiftright("h", _TAIL_BITS))
    counts = long.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c").orderBy("cell")))  # at most 4,096 rows a column
    found = counts.where((F.col("upto") >= position) & (F.col("upto") - F.col("n") < position)).collect()
    here = F.lit(False)
    for r in found:
        here = here | ((F.col("c") == r["c"]) & (F.col("cell") == r["cell"]))
    near = long.where(here).groupBy("c", "h").agg(F.count(F.lit(1)).alias("n")).orderBy("c", "h").collect()
    below, out = {r["c"]: r["upto"] - r["n"] for r in found}, {}
    for r in near:
        if r["c"] not in out and below[r["c"]] + r["n"] >= position:
            out[r["c"]] = r["h"], below[r["c"]], r["n"]
        below[r["c"]] += r["n"]
    return out


def train_split(df: DataFrame, key: str, val_share: float = 0.1, seed: int = K.SEED) -> DataFrame:
    """Add ``is_val``: the first floor(n * share) rows in hash order.

    The hash at that place splits the rows without ranking them; only if rows on both sides share it are all ranked.
    """
    cut = math.floor(df.count() * val_share)
    hashed = _hashed(df, key, seed, [])
    at, below, same = values_at(hashed, ["__h"], cut)["__h"] if cut else (-1, 0, 0)
    if below + same == cut:
        return hashed.withColumn("is_val", F.col("__h") <= at).drop("__h", "__g")
    ranked = sample_order(df, key, seed)
    return ranked.withColumn(
        "is_val", F.col("sample_rank") <= F.floor(F.col("stratum_size") * F.lit(val_share))
    ).drop("sample_rank", "stratum_size")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = K.SEED) -> DataFrame:
    """Add ``fold``: hash order dealt round-robin within each label."""
    ranked = sample_order(df, key, seed, [label])
    return ranked.withColumn("fold", F.pmod(F.col("sample_rank"), F.lit(folds)).cast("int")).drop(
        "sample_rank", "stratum_size"
    )


# ---- binning -------------------------------------------------------------


def quantile_bins(df: DataFrame, value: str, bins: int = 5, name: str = "bin") -> DataFrame:
    """Equal-frequency bins [e_i, e_i+1), the last closed; nulls go to the last bin."""
    clean = df.withColumn("__v", no_nan(value))
    return (
        clean.withColumn("__edges", quantile_edges(clean, "__v", bins))
        .withColumn(name, interval_bucket(F.col("__v"), F.col("__edges"), "left"))
        .drop("__v", "__edges")
    )


def level_strata(df: DataFrame, value: str, bins: int = 5, name: str = "stratum") -> DataFrame:
    """Equal-frequency strata (e_i, e_i+1], the minimum included, numbered from 1."""
    return (
        df.withColumn("__edges", quantile_edges(df, value, bins))
        .withColumn(name, interval_bucket(F.col(value), F.col("__edges"), "right") + 1)
        .drop("__edges")
    )


def tertile(df: DataFrame, value: str, name: str = "tertile") -> DataFrame:
    """low at or below the first third's quantile, mid at or below the second's, else high."""
    q = quantile_scalars(df, value, {"a": 1.0 / 3.0, "b": 2.0 / 3.0})
    v = F.col(value)
    return df.withColumn("__q", q).withColumn(
        name, F.when(v <= F.col("__q.a"), "low").when(v <= F.col("__q.b"), "mid").otherwise("high")
    ).drop("__q")

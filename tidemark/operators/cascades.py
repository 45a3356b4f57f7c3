"""Reply trees: roots, levels, and one row of shape and timing per conversation.

Input rows carry ``conversation_id``, ``id_num``, ``parent`` and ``epoch``.
Every step groups on (conversation, ...) with partial sums, so one very large
conversation is spread over tasks like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import count_or_zero, no_nan, share
from tidemark.operators.ranks import quantile_scalars
from tidemark.session import stage


def with_numeric_id(df: DataFrame, source: str = "id_str") -> DataFrame:
    """Add ``id_num``: the id as a double, the precision parent ids are stored in."""
    return df if "id_num" in df.columns else df.withColumn("id_num", F.col(source).try_cast("double"))


def reply_rows(
    df: DataFrame,
    conversation: str = "conversationId",
    parent: str = "in_reply_to_status_id_str",
    min_size: int = 1,
) -> DataFrame:
    """The four tree columns, null conversations out, small conversations out."""
    rows = with_numeric_id(df).select(
        no_nan(conversation).alias("conversation_id"),
        no_nan("id_num").alias("id_num"),
        no_nan(parent).alias("parent"),
        no_nan("epoch").alias("epoch"),
    ).where(F.col("conversation_id").isNotNull())
    if min_size > 1:
        big = rows.groupBy("conversation_id").count().where(F.col("count") >= min_size)
        rows = rows.join(big, "conversation_id", "left_semi")
    return rows


def conversation_roots(rows: DataFrame, rtol: float | None = None) -> DataFrame:
    """Root per conversation: the post whose id is the conversation id, else the earliest.

    ``rtol`` widens the id match to a relative tolerance; ties go to the smaller
    distance, then the earlier post, then the smaller id.
    """
    gap = F.abs(F.col("id_num") - F.col("conversation_id"))
    slack = F.lit(0.0) if rtol is None else F.lit(1e-8) + F.lit(rtol) * F.abs(F.col("conversation_id"))
    match = gap <= slack
    order = F.struct(
        (~F.coalesce(match, F.lit(False))).cast("int"),
        F.when(match, gap).otherwise(F.lit(0.0)),
        F.coalesce("epoch", F.lit(float("inf"))),
        "id_num",
    )
    return rows.groupBy("conversation_id").agg(
        F.min_by(F.struct("id_num", "epoch"), order).alias("r")
    ).select("conversation_id", F.col("r.id_num").alias("root_id"), F.col("r.epoch").alias("root_epoch"))


def reply_edges(rows: DataFrame) -> DataFrame:
    """Distinct (conversation, parent, child); ``attached`` is false for an orphan.

    Counts of repeated posts stay in ``n`` so that orphan totals are whole.
    """
    replies = (
        rows.where(F.col("parent").isNotNull() & F.col("id_num").isNotNull())
        .groupBy("conversation_id", "parent", F.col("id_num").alias("child"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    present = rows.select("conversation_id", F.col("id_num").alias("parent"), F.lit(True).alias("attached")).distinct()
    return replies.join(present, ["conversation_id", "parent"], "left").withColumn(
        "attached", F.coalesce("attached", F.lit(False))
    )


def node_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Distance from the root of every post the root reaches (conversation, node, level).

    A post normally has one parent, so its path up is unique and can be shortened
    by pointer doubling: after k rounds each post knows its ancestor 2^k up, and
    rounds grow with the logarithm of the depth. Conversations where a post
    appears with several parents need shortest paths, which double as well (see
    ``shortest_levels``). Each round is written to the shared folder, so a lost executor costs a re-read.
    """
    links = edges.where("attached").select("conversation_id", "parent", "child").join(
        roots.select("conversation_id", "root_id"), "conversation_id"
    )
    links = stage(links, "links")
    several = (
        links.groupBy("conversation_id", "child").agg(F.count(F.lit(1)).alias("c"))
        .where("c > 1").select("conversation_id").distinct()
    )
    several = stage(several, "several-parents")
    start = roots.select("conversation_id", F.col("root_id").alias("node"), F.lit(0).alias("level"))
    reached = start.unionByName(_double(links.join(several, "conversation_id", "left_anti")))
    if not several.isEmpty():
        reached = reached.unionByName(shortest_levels(links.join(several, "conversation_id", "left_semi")).where("level > 0"))
    return reached


def _double(links: DataFrame) -> DataFrame:
    """Levels by pointer doubling over single-parent links."""
    jumps = links.where(F.col("child") != F.col("root_id")).select(
        "conversation_id", F.col("child").alias("node"), F.col("parent").alias("up"),
        F.lit(1).alias("level"), "root_id",
    )
    at_root = F.col("up") == F.col("root_id")
    settled, open_rows = None, None
    current = stage(jumps, "jumps")
    while True:
        ahead = current if settled is None else settled.unionByName(current)
        done = current.where(at_root)
        settled = done if settled is None else settled.unionByName(done)
        step = ahead.select(
            "conversation_id", F.col("node").alias("up"),
            F.col("up").alias("further"), F.col("level").alias("more"),
        )
        # A chain that ends at an orphan finds no further step and leaves here.
        moved = current.where(~at_root).join(step, ["conversation_id", "up"]).select(
            "conversation_id", "node", F.col("further").alias("up"),
            (F.col("level") + F.col("more")).alias("level"), "root_id",
        )
        current = stage(moved, "jumps")
        left = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(at_root, 1).otherwise(0)).alias("reached")
        ).first()
        # Only a cycle keeps every open row open for a whole round.
        if left["n"] == 0 or (not left["reached"] and left["n"] == open_rows):
            return settled.select("conversation_id", "node", "level")
        open_rows = left["n"]


def shortest_levels(links: DataFrame, most_pairs: int = 256) -> DataFrame:
    """Distance from the root of every post it reaches, roots included, by min-plus doubling.

    After k rounds the distances below 2^k are known, and ``hops`` holds, for every post
    without one, its ancestors exactly 2^k replies up, over any of its parents. One join adds
    the distances up to 2^(k+1): 2^k more than the least known one among those ancestors;
    another doubles the hops. So rounds grow with the logarithm of the depth. Posts with many
    parents at many depths have many ancestors at one distance: should ``hops`` outgrow
    ``most_pairs`` times the links, the distances still open go on a level at a time.
    """
    links = stage(links.select("conversation_id", "parent", "child", "root_id").distinct(), "multi-links")
    bound = most_pairs * links.count()
    levels = links.select("conversation_id", F.col("root_id").alias("node")).distinct().withColumn("level", F.lit(0))
    hops = links.where(F.col("child") != F.col("root_id")).select("conversation_id", F.col("child").alias("node"), F.col("parent").alias("up"))
    hops, step = stage(hops, "hops"), 1
    on = ["conversation_id", "up"]
    while True:
        known = levels.select("conversation_id", F.col("node").alias("up"), "level")
        found = hops.join(known, on).groupBy("conversation_id", "node").agg((F.min("level") + step).alias("level"))
        found = stage(found, "levels")
        # A post farther up the shortest path than these would have one of these on it.
        if found.isEmpty():
            return levels
        levels = levels.unionByName(found)
        far = hops.join(found, ["conversation_id", "node"], "left_anti")
        ahead = hops.select("conversation_id", F.col("node").alias("up"), F.col("up").alias("further"))
        hops = stage(far.join(ahead, on).select("conversation_id", "node", F.col("further").alias("up")).distinct(), "hops")
        step *= 2
        if hops.count() > bound:
            return _by_level(links, levels, step)


def _by_level(links: DataFrame, levels: DataFrame, level: int) -> DataFrame:
    """Distances from ``level`` on, a round each; smaller ones are known."""
    frontier = levels.where(F.col("level") == level - 1)
    while True:
        nxt = (
            links.join(frontier.select("conversation_id", F.col("node").alias("parent")), ["conversation_id", "parent"])
            .select("conversation_id", F.col("child").alias("node")).distinct()
            .join(levels.select("conversation_id", "node"), ["conversation_id", "node"], "left_anti")
            .withColumn("level", F.lit(level))
        )
        frontier = stage(nxt, "frontier")
        if frontier.isEmpty():
            return levels
        levels, level = levels.unionByName(frontier), level + 1


def peak_hours(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Hour after the root with most posts, root and negative hours included.

    Ties go to the smallest hour; null with fewer than two timed posts.
    """
    timed = rows.where(F.col("epoch").isNotNull()).join(roots, "conversation_id")
    hours = timed.where(F.col("root_epoch").isNotNull()).groupBy(
        "conversation_id",
        F.floor((F.col("epoch") - F.col("root_epoch")) / F.lit(3600.0)).alias("hour"),
    ).agg(F.count(F.lit(1)).alias("c"))
    return hours.groupBy("conversation_id").agg(
        F.sum("c").alias("n"), F.max_by("hour", F.struct(F.col("c"), -F.col("hour"))).alias("hour")
    ).select(
        "conversation_id",
        F.when(F.col("n") >= 2, F.col("hour") * F.lit(3600.0)).alias("time_to_peak_seconds"),
    )


def cascade_stats(df: DataFrame, min_size: int = 2, rtol: float | None = None, **columns: str) -> DataFrame:
    """Size, orphans, depth, breadth, direct replies, peak and duration per conversation."""
    rows = stage(reply_rows(df, min_size=min_size, **columns), "reply-rows")
    roots = stage(conversation_roots(rows, rtol), "roots")
    edges = stage(reply_edges(rows), "edges")
    per_level = node_levels(edges, roots).groupBy("conversation_id", "level").agg(
        F.count(F.lit(1)).alias("width")
    )
    shape = per_level.groupBy("conversation_id").agg(
        F.max("level").alias("depth"), F.max("width").alias("breadth")
    )
    base = rows.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.when(F.count("epoch") >= 2, F.max("epoch") - F.min("epoch")).alias("duration_seconds"),
    )
    linked = edges.join(roots.select("conversation_id", "root_id"), "conversation_id")
    replies = linked.groupBy("conversation_id").agg(
        F.sum(F.when(F.col("attached"), 0).otherwise(F.col("n"))).alias("n_orphans"),
        F.sum(F.when(F.col("attached") & (F.col("parent") == F.col("root_id")), 1).otherwise(0)).alias("direct_replies"),
    )
    return (
        base.join(roots.select("conversation_id", "root_id"), "conversation_id")
        .join(shape, "conversation_id", "left")
        .join(replies, "conversation_id", "left")
        .join(peak_hours(rows, roots), "conversation_id", "left")
        .select(
            "conversation_id", "root_id", "n_posts",
            F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.coalesce("breadth", F.lit(0)).alias("breadth"),
            F.coalesce("direct_replies", F.lit(0)).alias("direct_replies"),
            "time_to_peak_seconds", "duration_seconds",
        )
    )


def tree_quality(stats: DataFrame) -> DataFrame:
    """Shares of deep and wide trees, size quantiles and mean orphan share; zeros when empty."""
    zero = F.lit(0.0)
    size = quantile_scalars(stats, "n_posts", {"median": 0.5, "p95": 0.95})
    out = stats.agg(
        F.count(F.lit(1)).alias("n_cascades"),
        F.coalesce(share(F.col("depth") >= 2), zero).alias("share_depth_ge_2"),
        F.coalesce(share(F.col("breadth") >= 2), zero).alias("share_breadth_ge_2"),
        F.coalesce(F.avg("n_posts"), zero).alias("mean_size"),
        F.coalesce(F.avg(F.col("n_orphans") / F.greatest(F.col("n_posts"), F.lit(1))), zero).alias("mean_orphan_share"),
    )
    return out.select(
        "*",
        F.coalesce(size.getField("median"), zero).alias("median_size"),
        F.coalesce(size.getField("p95"), zero).alias("p95_size"),
    )


# ---- observed distributions ----------------------------------------------


def root_reply_counts(df: DataFrame, conversation: str = "conversationId", replies: str = "replyCount") -> DataFrame:
    """Reply count of every post that is its own conversation's root."""
    return with_numeric_id(df).where(F.col("id_num") == F.col(conversation)).select(
        F.col(conversation).alias("conversation_id"), count_or_zero(replies).alias("reply_count")
    )


def aggregate_engagement(df: DataFrame, conversation: str = "conversationId") -> DataFrame:
    """Replies, retweets and quotes summed per conversation."""
    total = count_or_zero("replyCount") + count_or_zero("retweetCount") + count_or_zero("quoteCount")
    return (
        df.where(no_nan(conversation).isNotNull())
        .groupBy(F.col(conversation).alias("conversation_id"))
        .agg(F.sum(total).alias("engagement"))
    )


def reply_ratio() -> Column:
    """Replies over (retweets + quotes + 1) of one post: reflective over reactive."""
    return count_or_zero("replyCount") / (
        count_or_zero("retweetCount") + count_or_zero("quoteCount") + F.lit(1.0)
    )


def observed_time_to_peak(df: DataFrame, conversation: str = "conversationId", distinct_roots: bool = False) -> DataFrame:
    """Modal hour after an in-table root, root excluded, negative hours dropped.

    Needs two replies, and two at or after the root. A root stored twice counts
    its replies twice unless ``distinct_roots``.
    """
    rows = with_numeric_id(df).select(
        no_nan(conversation).alias("conversation_id"), "id_num", count_or_zero("epoch").alias("epoch")
    ).where(F.col("conversation_id").isNotNull())
    is_root = F.col("id_num") == F.col("conversation_id")
    roots = rows.where(is_root).select("conversation_id", F.col("epoch").alias("root_epoch"))
    if distinct_roots:
        roots = roots.groupBy("conversation_id").agg(F.min("root_epoch").alias("root_epoch"))
    hours = (
        rows.where(~F.coalesce(is_root, F.lit(False)))
        .join(roots, "conversation_id")
        .groupBy("conversation_id", F.floor((F.col("epoch") - F.col("root_epoch")) / F.lit(3600.0)).alias("hour"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    valid = F.col("hour") >= 0
    return (
        hours.groupBy("conversation_id")
        .agg(
            F.sum("c").alias("n"),
            F.sum(F.when(valid, F.col("c"))).alias("n_valid"),
            F.max_by(F.when(valid, F.col("hour")), F.when(valid, F.struct(F.col("c"), -F.col("hour")))).alias("peak_hour"),
        )
        .where((F.col("n") >= 2) & (F.col("n_valid") >= 2))
        .select("conversation_id", "peak_hour")
    )

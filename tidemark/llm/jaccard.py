"""N-gram Jaccard join: which documents share three quarters of their word shingles.

T-occurrence search over an inverted index, made for a shuffle:

1. Sets are hashed 64-bit word shingles. Equal sets fall into one class (128-bit digest),
   so exact copies cost one set whatever their number.
2. Every set shows its smallest shingles, enough that two linked sets must both show
   ``margin`` of theirs (see ``shown``). Lists of one set are dropped, and then every set
   whose remaining lists are too few to reach its required overlap: unlike texts stop here.
3. Lists longer than ``long_list`` are the long ones. As in DivideSkip a set with fewer
   long lists than its required overlap needs only the short ones to be found, so a
   passage that a third of all texts quote brings nobody together; only sets made
   mostly of such passages meet through long lists.
4. Each remaining list names a block by its smallest set. A set leaves the blocks it knows
   by its fewest lists, as many lists as it and a linked set can both miss and still meet,
   and those where no set is of like size. Whole sets (a second pass over
   the texts, only those a bounded bit filter lets through) travel to their blocks, and
   every block is searched by DivideSkip: short lists merged, long ones probed by
   binary search, required overlap counted in full. Blocks over ``chunk`` sets, or
   over a million shingles, are dealt as pairs of chunks.
5. Links become components (see ``components``).

Sets within one component are not compared again, so a group of thousands of near copies
costs a spanning forest. Shingles travel as 48 bits of their hash. Sets are named by 64 bits of their digest and their size
until they have numbers, and by all 128 where they are fetched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import Forest, components
from tidemark.llm.sparse import BitFilter, bit_filter, row_key, split
from tidemark.llm.textbytes import mix, parts, slices, word_hashes, words_of
from tidemark.session import ship_package, shuffle_width, stage

MARGIN = 0.13
LONG_LIST = 32
CHUNK = 1024
CHUNK_SHINGLES = 1 << 20
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column, words: int):
    """Sorted distinct shingle hashes (uint64) of every text of an Arrow column, in order."""
    raw, at = parts(column)
    place = [np.uint64(pow(int(_PLACE), j, 1 << 64)) for j in range(words)]
    for lo, hi in slices(at):
        block, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        begins, ends, before = words_of(block, own)
        h = word_hashes(block, begins, ends)
        full = np.zeros(0, np.uint64)
        if len(h) >= words:
            full = np.zeros(len(h) - words + 1, np.uint64)
            for j in range(words):
                full += h[j : len(h) - words + 1 + j] * place[j]
            full = mix(full)
        for i in range(hi - lo):
            a, b = before[i], before[i + 1]
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                # The whole sequence is the shingle; its length is part of it.
                whole = (h[a:b] * np.array(place[: b - a], np.uint64)).sum(dtype=np.uint64)
                yield mix(np.array([whole + np.uint64(b - a)], np.uint64))
            else:
                yield full[:0]


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums of its differently mixed members."""
    n = np.uint64(len(s))
    a = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + n
    b = mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def least_overlap(n, percent: int):
    """Members of a set of n that any linked set must hold: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def margin_of(n, percent: int, margin: float):
    """Shown members that a set of n and a linked one must share: 1 and more, growing with n."""
    return 1 + (least_overlap(n, percent) * margin).astype(np.int64)


def shown(n: int, percent: int, margin: float) -> int:
    """How many of its smallest members a set of n shows.

    A linked set misses at most n - least_overlap of them. Showing that many and margin_of
    more leaves margin_of shared ones in the shown range that ends first, and those lie in
    the other's range too. That set has least_overlap(n') members or more if the other has n'.
    """
    need = int(least_overlap(n, percent))
    return min(n, n - need + int(margin_of(np.int64(n), percent, margin)))


def _digests(words: int):
    """Rows with their text, the last column, replaced by size and digest of its set."""

    def run(batches):
        for batch in batches:
            rows = [(len(s), *digest(s)) for s in shingle_sets(batch.column(batch.num_columns - 1), words)]
            n, d1, d2 = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (n, d1, d2))], [*batch.schema.names[:-1], "n", "d1", "d2"])

    return run


def _shown(words: int, percent: int, margin: float, room: int = 1 << 17):
    """Rows (shingle, set) of what each set shows; a set met before in the task is passed over."""

    def run(batches):
        met: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, owners, sizes = [], [], []
            for s in shingle_sets(batch.column(0), words):
                if not len(s) or (d := digest(s)) in met:
                    continue
                if len(met) >= room:
                    met.clear()
                met.add(d)
                p = shown(len(s), percent, margin)
                tokens.append(s[:p])
                owners.append(np.full(p, d[0], np.int64))
                sizes.append(np.full(p, len(s), np.int64))
                if len(sizes) >= 512:
                    yield _rows(tokens, owners, sizes)
                    tokens, owners, sizes = [], [], []
            if tokens:
                yield _rows(tokens, owners, sizes)

    return run


def _rows(tokens, owners, sizes):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes))],
        ["token", "d1", "n"])


def _whole_sets(words: int, allowed, room: int = 1 << 17):
    """(d1, d2, members as 6-byte numbers) of the texts whose key the filter lets through, each set once a task or so."""

    def run(batches):
        keys, met = BitFilter(allowed.value), set()
        for batch in batches:
            keep = np.flatnonzero(keys.may_hold(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            if not len(keep):
                continue
            texts = batch.column(1).cast(pa.large_string()).take(pa.array(keep))
            names, packed = [], []
            for s in shingle_sets(texts, words):
                if (d := digest(s)) not in met:
                    if len(met) >= room:
                        met.clear()
                    met.add(d)
                    names.append(d)
                    packed.append(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            d1, d2 = zip(*names) if names else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(packed, pa.binary())], ["d1", "d2", "members"])

    return run


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return np.sort(wide.view("<u8").ravel())


def divide_skip(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between ``sets`` that join components; pairs of equal ``side`` are skipped if it is given.

    T-occurrence search in ascending order of size, each set against those before it.
    T is the least overlap of the set with any linked smaller one. Of its lists, sorted by
    length, up to T - 1 of the longest are kept aside: a candidate must occur T - (those
    kept aside) times in the merged short lists, and is then looked up in the long ones by
    binary search. What reaches the overlap its own size requires is linked.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    owner = np.repeat(np.arange(len(order)), size)
    if not len(owner):
        return []
    _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    lists = owner[np.argsort(token, kind="stable")]  # each list ascends: owners do
    ends = np.cumsum(np.bincount(token))
    begins = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(size)])
    forest, found = Forest(), []
    group = np.arange(len(order))
    for q in range(1, len(order)):
        t = token[first[q] : first[q + 1]]
        lo = np.searchsorted(size, least_overlap(size[q], percent))  # smaller sets cannot be linked
        if lo >= q:
            continue
        b, e = begins[t], ends[t]
        many = e - b > 1
        b, e = b[many], e[many]
        need = int(least_overlap(size[q], percent))
        if len(b) < need:
            continue
        by = np.argsort(e - b, kind="stable")
        b, e = b[by], e[by]
        aside = min(need - 1, int(need / (0.0085 * np.log2(max(2, e[-1] - b[-1])) + 1)))
        b1, e1 = b[: len(b) - aside], e[: len(e) - aside]
        width = e1 - b1
        at = np.repeat(b1 - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        times = np.bincount(lists[at], minlength=len(order))[lo:q]
        c = np.flatnonzero(times >= need - aside) + lo
        c = c[group[c] != group[q]]
        if side is not None:
            c = c[side[order[c]] != side[order[q]]]
        if not len(c):
            continue
        total = times[c - lo].astype(np.int64)
        for x, y in zip(b[len(b) - aside :], e[len(e) - aside :]):
            part = lists[x:y]
            spot = np.minimum(np.searchsorted(part, c), len(part) - 1)
            total += part[spot] == c
        for x in c[100 * total >= percent * (size[c] + size[q] - total)]:
            if forest.join(int(x), q):
                found.append((int(order[x]), int(order[q])))
        root = forest.find(q)
        for x in {int(g) for g in group[c]} | {q}:
            if forest.find(x) == root:
                group[group == x] = root
    return found


def _search(percent: int):
    """One block, or one pair of chunks of a large block: links as ``(a, b)``."""

    def run(table: pa.Table) -> pa.Table:
        reps = table.column("cid").to_pylist()
        part = np.array(table.column("part").to_pylist(), np.int64)
        block = np.array(table.column("block").to_pylist(), np.int64)
        wanted = np.array(table.column("crossed").to_pylist(), bool)
        task = np.array(table.column("task").to_pylist(), np.int64)
        packed = table.column("members")
        out: list[tuple[int, int]] = []
        order = np.lexsort((task, block))
        cuts = np.flatnonzero(np.diff(block[order]) | np.diff(task[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                sets = [unpack(packed[int(i)].as_py()) for i in rows]
                side = part[rows] if wanted[rows[0]] else None
                out += [(reps[rows[i]], reps[rows[j]]) for i, j in divide_skip(sets, percent, side)]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked(texts: DataFrame, words: int, percent: int, margin: float, long_list: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``n, d1, d2`` for their ``text``, the last column; and ``(d1, d2, n, component)``, a number, of every set that has a shingle."""
    spark = texts.sparkSession
    ship_package(spark)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("text").schema.fields)
    members = stage(texts.mapInArrow(_digests(words), f"{kept}, n long, d1 long, d2 long"), "jaccard-sets")
    # Classes have numbers of their own: ids may be null, or stand for different texts.
    classes = members.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("t").alias("t"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")

    # Lists of two sets and more. Naming all columns on both sides lets them share one exchange.
    rows = texts.select("text").mapInArrow(_shown(words, percent, margin), "token long, d1 long, n long")
    rows = rows.repartition(shuffle_width(spark), "token")
    lists = rows.groupBy("token").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max("n").alias("most"))
    lists = lists.where("lo < hi and most > 0").select("token")
    shared = rows.join(lists, "token").distinct()
    shared = stage(shared, "jaccard-lists")

    # The least that a linked partner, as small as it may be, must share with the set.
    need = F.ceil(F.col("n") * percent / 100)
    least = 1 + F.floor(F.ceil(need * percent / 100) * margin)
    live = shared.groupBy("d1", "n").agg(F.count("*").alias("hits")).where(F.col("hits") >= least).select("d1", "n")
    kept = stage(shared.join(live, ["d1", "n"], "left_semi"), "jaccard-live")
    sizes = kept.groupBy("token").agg(F.count("*").alias("len"), F.min("d1").alias("block")).where("len > 1")
    hits = kept.join(sizes, "token").groupBy("d1", "n", "block").agg(
        F.count_if(F.col("len") > long_list).alias("long"), F.count_if(F.col("len") <= long_list).alias("short"))
    # A pair shares ``least`` lists of either set. Long ones fewer than that are left; half of what
    # then remains to spare may go too, so a set leaves the blocks it knows by its fewest lists.
    own = Window.partitionBy("d1", "n")
    upto = own.orderBy("short", "block").rowsBetween(Window.unboundedPreceding, 0)
    visits = hits.select(
        "d1", "n", "block", "long", F.sum("long").over(own).alias("longs"), F.sum("short").over(upto).alias("upto"), least.alias("least"))
    spare = F.greatest(F.lit(0), F.floor((F.col("least") - 1 - F.col("longs")) / 2))
    meets = visits.where((F.col("upto") > spare) | ((F.col("long") > 0) & (F.col("longs") >= F.col("least")))).select("block", "d1", "n")
    # Only sets of like size can be linked: who has none in its block stays away. Linked sizes
    # are one step apart at most; the step is a hair wider than needed, against rounding.
    step = max(1e-3, math.log(100 / percent) * 1.0001)
    meets = meets.join(classes, ["d1", "n"]).select("block", "cid", "n", F.floor(F.log("n") / step).alias("size"))
    meets = stage(meets, "jaccard-sized")
    tally = meets.groupBy("block", "size").agg(F.count("*").alias("here"))
    tally = tally.select("block", "here", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    alike = tally.groupBy("block", "size").agg(F.sum("here").alias("here")).where("here > 1").drop("here")
    meets = stage(meets.join(alike, ["block", "size"], "left_semi").drop("size"), "jaccard-meets")
    counts = meets.groupBy("block").agg(F.count("*").alias("in_block"), F.sum("n").alias("shingles")).where("in_block > 1")

    # Second pass: whole sets of those that meet somebody. The filter names texts; digests, read anew, name sets.
    wanted = stage(meets.select("cid").distinct().join(classes, "cid").select("t", "cid", "d1", "d2"), "jaccard-wanted")
    sets = texts.select("t", "text").mapInArrow(_whole_sets(words, bit_filter(wanted.select("t"))), "d1 long, d2 long, members binary")
    sets = wanted.join(sets.groupBy("d1", "d2").agg(F.first("members").alias("members")), ["d1", "d2"]).select("cid", "members")

    # A block of c chunks is c * (c + 1) / 2 tasks; a set goes to the c that name its chunk.
    dealt = (
        meets.join(counts, "block")
        .withColumn("chunks", F.ceil(F.greatest(F.col("in_block") / chunk, F.col("shingles") / CHUNK_SHINGLES)).cast("long"))
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(
            "cid", "block", "part", (F.col("part") != F.col("other")).alias("crossed"),
            (F.least("part", "other") * F.col("chunks") + F.greatest("part", "other")).alias("task"),
        )
    )
    work = dealt.join(sets, "cid").withColumn("bin", F.pmod(F.xxhash64("block", "task"), F.lit(64 * shuffle_width(spark))))
    links = work.groupBy("bin").applyInArrow(_search(percent), "a long, b long")
    found = components(links, "jaccard-components")
    return members, classes.join(found, classes["cid"] == found["node"], "left").select(
        "d1", "d2", "n", F.coalesce("component", "cid").alias("component"))


def ngram_jaccard_join(
    docs: DataFrame, words: int = 5, percent: int = 75, margin: float = MARGIN, long_list: int = LONG_LIST, chunk: int = CHUNK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: set size and smallest id reachable by links.

    ASCII capitals are folded; words are cut at space and the bytes 9 to 13. Null, empty and
    wordless texts have an empty set and are linked with nothing; shorter texts than ``words``
    are one shingle. Rows are linked by their texts: repeated rows give repeated rows, rows of
    one id with different texts have components each, and rows with null ids link others and
    get the smallest id reachable, null where all are null. Other columns are ignored.
    Lists of any length, groups of any size and texts of any length are handled in full.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    members, classes = _linked(texts, words, percent, margin, long_list, chunk)
    rows = members.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")).join(classes, ["d1", "d2", "n"])
    rows = stage(rows, "jaccard-named")
    names = rows.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = rows.join(names, "component").select("d1", "d2", "n", "component_id", F.lit(True).alias("linked"))
    return members.join(named, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75, margin: float = MARGIN, long_list: int = LONG_LIST, chunk: int = CHUNK,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links join: that of the smallest id, null ids last, ties by a hash of the row.

    Rows without words are in no group and stay, repeated ones too. Of equal rows in a group
    one stays. Whole rows are shuffled only if they may leave: the others are told by a filter.
    """
    text = F.col(text_col).cast("string")
    columns = docs.columns
    keys = {"_k1": row_key(columns, 1), "_k2": row_key(columns, 2)}
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[k.alias(n) for n, k in keys.items()], F.xxhash64(text).alias("t"), text.alias("text"))
    members, classes = _linked(texts, words, percent, margin, long_list, chunk)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")
    each = members.where("n > 0").groupBy("d1", "d2", "n", "doc_id", "_k1", "_k2").agg(F.count("*").alias("copies"))
    each = stage(each.join(classes, ["d1", "d2", "n"]).select("component", order.alias("row"), "copies"), "jaccard-rows")
    first = each.groupBy("component").agg(F.min("row").alias("first"))
    # What the filter must find: rows that go, and those of which copies go.
    facts = each.join(first, "component").where((F.col("row") != F.col("first")) | (F.col("copies") > 1)).select(
        F.col("row._k1").alias("_k1"), F.col("row._k2").alias("_k2"), (F.col("row") == F.col("first")).alias("_one"))
    facts = stage(facts, "jaccard-facts")
    rest, some = split(docs.withColumns(keys), "_k1", facts)
    some = some.join(facts, ["_k1", "_k2"], "left")
    one = some.where("_one").groupBy("_k1", "_k2").agg(F.first(F.struct(*columns)).alias("_row")).select("_row.*")
    return rest.select(columns).union(some.where("_one is null").select(columns)).union(one.select(columns))

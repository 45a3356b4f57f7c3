"""Hard negatives, quality rules and the Merkle manifest on small tables against brute force and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg, likelihood, merkle
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.plans.check import connect, normal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    df, cur = QUERIES[name](spark, SF), connect(SF).execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


# --- hard negatives ---

ROW = "vec_id long, embedding array<float>, label int, score string, slot int"


def brute_negatives(rows, positives, negatives, low, high):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
             if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {(i, lab, tuple(v)) for i, lab, v in whole if i % 100 == 0}
    for a, label, v in asked:
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in whole if i != a]
        for p, pos, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted((n, i) for n, i, lab in scored if lab != label and low * -p <= 100 * -n <= high * -p)[:negatives]
            out += [(a, pos, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6) * 0.3 + 0.2], i % 3) for i in range(320)]
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(40)]  # ties
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[101][1], 2), (55, rows[55][1], rows[55][2])]  # repeated rows, one id twice
    rows += [(2000, [0.0] * 6, 0), (2001, [0.0] * 6, 1), (2100, [-1.0] * 6, 0), (2200, [], 2), (2201, [0.5], 2)]
    rows += [(None, rows[0][1], 0), (2300, None, 1), (2400, rows[4][1], None), (2500, [float("nan")] * 6, 1), (2600, [None] * 6, 1),
             (2700, [float("inf")] * 6, 0)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"rows_per_block": 40, "anchors_per_block": 2}])
def test_hard_negatives_equal_brute_force(spark, settings):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROW)
    got = hardneg.mine(df, F.col("vec_id") % 100 == 0, **settings)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5, 10, 30, 90)


def test_hard_negatives_of_wide_numbers_and_empty_tables(spark):
    rows = [(i, [float(np.float32((i * 37 % 11) * 10.0**6)), float(i)], i % 2) for i in range(30)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROW)
    got = hardneg.mine(df, F.col("vec_id") % 100 == 0, positives=3, negatives=4, low=-50, high=100)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 3, 4, -50, 100)
    assert hardneg.mine(df.limit(0), F.lit(True)).count() == 0
    assert hardneg.mine(df, F.lit(False)).count() == 0


def test_slots_hold_each_score_once():
    score, ids = np.array([9, 7, 7, 5, 3, 1]), np.array([1, 5, 2, 3, 4, 6])
    found = hardneg.slot_lists(score, ids, np.array([8, 5]), 2, 2)
    assert [(s, ids[at].tolist()) for s, at in found] == [(0, [2, 5]), (1, [3, 4])]


# --- quality rules ---

DOC = "doc_id long, text string, n_words string, trusted int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[A-Za-z\x80-\U0010FFFF]+|[0-9]+|[^A-Za-z0-9\x80-\U0010FFFF\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def rule_texts():
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "naïve", "straße", "12"]) + rng.choice(["", "s", "."]) for _ in range(80)) for _ in range(40)]
    junk = [" ".join(rng.choice(["x##", "%%y", "ZZ!!", "|"]) for _ in range(90)) for _ in range(12)]
    odd = [None, "", " \n\t ", "a", "a a a a", "one\ntwo\none\n\n\none \none", "\n\none\none", "x y\r\nx y\r\nx y", "日本 語 日本 語 日本 語\n x", "same line\nsame line",
           "b\vc\fd", "#*$%&|<>", "word " * 30_000, "long" * 100_000, "aB ab aB ab aB ab"]
    return clean + junk + odd + clean[:3]


def test_base_rules_equal_plain_expressions(spark):
    texts = rule_texts()
    df = spark.createDataFrame([(i, t, "clash", 2) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in likelihood.apply_rules(df, df.where("doc_id < 20").select("doc_id")).collect()}
    for i, t in enumerate(texts):
        want = brute_rules(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, repr(t)[:60]
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= likelihood.THRESHOLD)
    assert all(got[i]["kept"] for i in range(40)) and not any(got[i]["kept"] for i in range(40, 52))


def test_scores_are_mean_log_ratios_of_both_multinomials(spark):
    texts = rule_texts()[:60]
    df = spark.createDataFrame([(i, t, "clash", 2) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r["score"] for r in likelihood.apply_rules(df, df.where("doc_id < 20").select("doc_id")).collect()}
    buckets = likelihood.buckets_for(len(texts))

    def bucket(gram):  # of one or two tokens, each hashed alone
        raw = np.frombuffer(" ".join(gram).encode(), np.uint8)
        both, _ = likelihood.ngrams(raw, np.array([0, len(raw)]), buckets)
        return int(both[-1])

    grams = []
    for t in texts:
        tokens = TOKEN.findall(t or "")
        # Neighbours without white space between them are joined by one here, which changes no token.
        grams.append([bucket([a]) for a in tokens] + [bucket(p) for p in zip(tokens, tokens[1:])])
    seen, good = Counter(g for own in grams for g in own), Counter(g for own in grams[:20] for g in own)
    share = sum(seen.values()) / sum(good.values())
    for i, own in enumerate(grams):
        want = np.mean([math.log((good[g] * share + likelihood.PRIOR) / (seen[g] + likelihood.PRIOR)) for g in own]) if own else 0.0
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_quality_rules_without_trust_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 40, "c", 0), (1, "a b " * 40, "c", 0), (None, "tail " + "x y z w v " * 20, "c", 0)], DOC)
    none = df.select("doc_id").limit(0)
    got = likelihood.apply_rules(df, none).collect()
    assert len(got) == 3 and all(r["score"] == 0.0 for r in got)
    assert likelihood.apply_rules(df, df.select("doc_id").union(df.select("doc_id"))).count() == 3
    assert likelihood.apply_rules(df.limit(0), df.select("doc_id")).count() == 0


def test_quality_query_keeps_clean_documents(spark):
    got = QUERIES["op12_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    kept = {q: [r["kept"] for r in got if r["quality"] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.5


# --- Merkle manifest ---

MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def brute_tree(leaves):
    """Root, and each leaf's (side, sibling) steps."""
    steps, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for own, p in zip(steps, at):
            other = p ^ 1
            own.append(("", "") if other >= len(level) else ("L" if p & 1 else "R", level[other]))
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], steps


def brute_manifest(rows, tampered):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in order:
        own = sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        built[k] = (own, *brute_tree([brute_leaf(r) for r in own]))
    root, tops = brute_tree([built[k][1] for k in order])
    out = []
    for k, top in zip(order, tops):
        own, subroot, steps = built[k]
        for row, s in zip(own, steps):
            s = s + top
            now = brute_leaf(row)
            if tampered(row):
                now = brute_leaf((*row[:3], None if row[3] is None else row[3] + 1, *row[4:]))
            for side, sibling in s:
                now = sha(sibling, now) if side == "L" else sha(now, sibling)
            out.append((row[0], brute_leaf(row), subroot, root, sha(*[x for _, x in s]), now, now == root))
    return sorted(out, key=repr)


def manifest_rows(n):
    rng = random.Random(n)
    langs = ["en"] * 5 + ["de", "ø", "z", None, ""]
    rows = [(i * 3, rng.choice(["a", None, "ü:1"]), rng.choice(langs), rng.choice([None, i, -5]), rng.choice(["", None, "text ü", "x" * 50]), "clash", 1)
            for i in range(n)]
    return rows + rows[:4] + [(None, None, "en", 1, None, "clash", 1), (None, None, None, None, None, "clash", 1), (3, "other", "en", 2, "t", "clash", 1)]


@pytest.mark.parametrize("n, height", [(0, 12), (40, 2), (90, 12), (130, 1)])
def test_manifest_equals_brute_force(spark, n, height):
    rows = manifest_rows(n)
    df = spark.createDataFrame(rows, MANIFEST)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.manifest(df, FIELDS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, hit, height)
    want = brute_manifest(rows, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_manifest_of_one_row_of_one_tree_and_of_none(spark):
    df = spark.createDataFrame(manifest_rows(0)[-1:], MANIFEST)
    (row,) = merkle.manifest(df, FIELDS, "lang", "doc_id").collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == sha()
    assert merkle.manifest(df.limit(0), FIELDS, "lang", "doc_id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6, 13, 32])
def test_appended_witnesses_fold_to_the_root(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    grown = merkle.Append()
    for digest in leaves:
        grown.add(digest)
    root = grown.close(None)
    assert root.hex() == brute_tree([x.hex() for x in leaves])[0]
    for digest, witness in zip(leaves, grown.witness):
        assert merkle.fold(digest, merkle.unpack(merkle.pack(witness))) == root

"""Null ids, ids that several rows share, and repeated rows: rows are decided by their content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import DOCS, brute_components, near_texts, words
from tidemark.llm import jaccard, langid, neardup, packing, private, quality, sparse

WIDE = 9007199254740993


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in rows], DOCS)


def near_pair(seed):
    base = words(80, seed)
    return " ".join(base), " ".join(base[:-2] + ["other", "end"])


def brute_named(rows):
    found = brute_components([t for _, t in rows])
    least = {}
    for k, (i, _) in enumerate(rows):
        n, c = found[k]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, found[k][0], least.get(found[k][1]) if found[k][0] else i) for k, (i, _) in enumerate(rows)), key=repr)


def odd_rows():
    a, b = near_pair(1)
    c, d = near_pair(2)
    e, f = near_pair(3)
    rows = [(None, a), (None, b), (7, c), (None, d), (5, e), (5, words(40, 9)[0] + " " + a[:5]), (WIDE, f), (WIDE + 2, e), (None, None), (None, ""), (3, None)]
    return rows + [(9, c)] * 3 + [(i, t) for i, t in enumerate(near_texts()[:40], 100)]


def test_links_of_null_shared_and_wide_ids(spark):
    rows = odd_rows()
    got = jaccard.ngram_jaccard_join(docs_of(spark, rows), chunk=8).collect()
    assert sorted(map(tuple, got), key=repr) == brute_named(rows)


def test_one_row_of_each_group_stays(spark):
    rows = odd_rows()
    kept = jaccard.keep_one(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    found, groups, want = brute_components([t for _, t in rows]), {}, []
    for k, row in enumerate(rows):
        if found[k][0]:
            groups.setdefault(found[k][1], []).append(row)
        else:
            want.append(row)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(want) + len(groups)
    for own in groups.values():
        first = min(own, key=lambda r: (r[0] is None, r[0] or 0))[0]
        inside = [r for r in got if r in own]
        assert len(inside) == 1 and inside[0][0] == first
    assert jaccard.keep_one(docs_of(spark, rows).limit(0)).count() == 0


def test_filter_splits_rows_without_losing_any(spark):
    rows = spark.range(5000).withColumn("k", F.xxhash64("id"))
    facts = rows.where("id % 50 = 0").select("k")
    rest, some = sparse.split(rows, "k", facts)
    assert rest.count() + some.count() == 5000 and some.where("id % 50 = 0").count() == 100 and some.count() < 300
    assert sparse.split(rows, "k", facts.limit(0))[1].count() == 0
    assert sparse.split(rows.limit(0), "k", facts)[0].count() == 0


def test_vectors_of_null_and_shared_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [5.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.02, 1.0]),
            (None, [1.0, 0.02, 0.0]), (None, None), (4, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    got = neardup.near_duplicates(df, recall=0.999999).collect()
    want = [(1, 3, 1, True), (1, 0, 1, True), (2, 3, 1, False), (3, 3, 1, False), (None, 1, None, None), (None, 1, None, None), (None, 3, 1, None),
            (None, 0, None, None), (4, 0, 4, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_signatures_do_not_depend_on_the_matrix():
    v = np.random.default_rng(2).standard_normal((200, 24))
    whole = neardup.signatures(v, 12, 5, 3)
    assert (np.concatenate([neardup.signatures(v[i : i + 1], 12, 5, 3) for i in range(200)]) == whole).all()


def test_packing_keeps_ids_as_they_are(spark):
    rows = [(None, 0, 5), (WIDE, 0, 7), (WIDE + 2, 0, 7), (WIDE, 0, 7), (None, 0, 5), (None, 2048, 30)]
    pieces = spark.createDataFrame([(i, s, n, 1, 50, "clash") for i, s, n in rows], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin2 string")
    got = packing.pack(pieces).collect()
    assert sorted(((r["doc_id"], r["start"], r["length"]) for r in got), key=repr) == sorted(rows, key=repr)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)


def test_more_languages_than_a_byte_holds():
    scores = np.full((3, 300), -5.0)
    scores[:, 299] = 0.0
    assert langid.viterbi(scores, np.array([0, 3]), 1.0).tolist() == [299] * 3


def test_stages_decide_each_row_by_its_text(spark):
    clean = [" ".join(words(60, i)) for i in range(30)]
    rows = [(None, clean[0]), (1, clean[1]), (1, "123 456"), (1, None), (None, ""), (2, clean[2]), (2, clean[2])]
    rows += [(i, t) for i, t in enumerate(clean[3:], 10)]
    docs = docs_of(spark, rows)
    got = langid.keep_identified(docs, F.lit(True))
    assert got.columns == docs.columns
    want = [r for r in rows if r[1] and r[1] != "123 456"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(10, 30)], "doc_id long, label long")
    scored = {r["score"] for r in quality.score(docs, labels).collect()}
    middle = sorted(scored)[len(scored) // 2]
    kept = quality.keep_good(docs, labels, middle)
    assert kept.count() == quality.score(docs, labels, middle).where("predicted = 1").count() and kept.columns == docs.columns
    for name, apply in corpus_pipeline.STAGES[2:3]:
        assert apply(spark, docs, None).where("doc_id is null and text <> ''").count() == 1, name


@pytest.mark.parametrize("null_text", [None, ""])
def test_sanitised_rows_keep_their_ids_and_columns(spark, null_text):
    name = "Quillfeather"
    rows = [(None, f"mail {name} at q@x.org now {i} " + " ".join(words(20, i))) for i in range(4)] + [(1, null_text), (1, f"call {name} today"), (1, "plain text")]
    rows += [(50 + i, " ".join(words(30, 40 + i))) for i in range(60)]
    docs = docs_of(spark, rows)
    got = private.sanitise(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = [r["text"] for r in got.where("doc_id is null or doc_id = 1").collect()]
    assert not any(t and (name in t or "q@x.org" in t) for t in texts) and "plain text" in texts and null_text in texts

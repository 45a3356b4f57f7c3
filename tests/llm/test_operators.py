"""Each operator on small tables against brute force: nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bytebpe, components, htmltext, jaccard, langid, licenses, neardup, packing, private, quality, topk
from tidemark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, langs=None):
    rows = [(i, t, langs[i % len(langs)] if langs else "en", "s", None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randint(0, 99)) for _ in range(n)]


def near_texts():
    out = [None, "", "  \n ", "one two", "One\ttwo", "one two three four five", "x" * 100_000]
    for g in range(6):
        base = words(60 + 40 * g, g)
        out.append(" ".join(base))
        out.append(" ".join(base).upper())
        for k in range(12):
            own = list(base)
            rng = random.Random(100 * g + k)
            for _ in range(k // 2):
                own[rng.randrange(len(own))] = f"new{k}{rng.random()}"
            out.append(" ".join(own))
    shared = words(70, 99)  # a passage that unlike texts quote
    out += [" ".join(words(30 + i, 1000 + i) + shared) for i in range(60)]
    return out


def brute_components(texts, size=5):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    forest = components.Forest()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
    return {i: (len(s), forest.find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("settings", [{}, {"long_list": 3, "chunk": 8}])
def test_jaccard_join_finds_every_link(spark, settings):
    texts = near_texts()
    got = jaccard.ngram_jaccard_join(table(spark, texts), **settings).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(texts)


def test_jaccard_join_repeated_rows_and_empty_table(spark):
    docs = table(spark, ["a b c d e f", "a b c d e f", None])
    assert jaccard.ngram_jaccard_join(docs.union(docs)).count() == 6
    assert jaccard.ngram_jaccard_join(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    got = components.components(edges).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 16))
    rows = [base[i % 20] + (0.12 * (i % 5)) * rng.standard_normal(16) for i in range(150)]
    rows = [[float(np.float32(x)) for x in r] for r in rows] + [[float(np.float32(x)) for x in rows[3]]] * 3
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return spark.createDataFrame([(i, v, "clash") for i, v in enumerate(rows + odd)], "vec_id long, embedding array<float>, n_links string"), rows


def test_near_duplicate_vectors(spark):
    df, rows = vectors(spark)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, chunk=16).collect()}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near, forest = unit @ unit.T >= 0.9, components.Forest()
    for i, j in zip(*np.nonzero(near)):
        forest.join(int(i), int(j))
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert found >= 0.99 * (near.sum() - len(rows))
    for i in range(len(rows)):
        assert got[i]["n_links"] <= near[i].sum() - 1 and got[i]["component_id"] >= forest.find(i)
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(rows), len(rows) + 7))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_top_k_is_exact(spark):
    df, rows = vectors(spark)
    whole = {i: np.floor(256 * np.array(v, float)) for i, v in enumerate(rows)}
    whole[len(rows) + 1] = np.zeros(16)  # an empty vector's components count as zero
    whole[len(rows) + 2] = np.zeros(16)
    whole[len(rows) + 6] = np.array([256.0, 512.0] + [0.0] * 14)
    got = topk.top_k(df, "vec_id % 50 = 0", rows_per_block=40, queries_per_block=2).collect()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [
            (k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), "true").count() == 0


TEXTS = [None, "", "Plain words, plain words.", "don't I'LL it's", "\x1c\x85 a\xa0b", "naïve É Ü ² ½ 日本語 🙂", "a" * 9000, "<|endoftext|>", "x y " * 6000,
         "Ä" * 300 + "!?" * 40, " \t\r\n a  b"]


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    docs = table(spark, TEXTS + words(300, 5))
    pieces = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(pieces, per_group=100).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and set(own.doc_tokens) == {len(ids)}
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048
    assert packing.pack(packing.cut(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit([7, 6, 4, 3, 2], 10) == ([0, 1, 1, 0, 2], [0, 0, 6, 7, 0])


def test_byte_bpe_equals_the_public_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, TEXTS)
    both = bytebpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()
    for r in both:
        t = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    encoded = bytebpe.encode(docs, path, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bytebpe.decode(encoded, path, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_language_spans(spark):
    rng = random.Random(2)
    vocabulary = {"aa": ["the", "this", "with", "that"], "bb": ["öst", "ünd", "äch", "ßei"], "cc": ["мир", "дом", "лес", "год"]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100, text("aa", 20) + " " + text("bb", 50), None), (101, None, "aa"), (102, "12 !! ", "aa"), (103, "日本", None), (104, "МИР", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.label(docs, F.col("doc_id") % 4 != 2).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:60])
    assert got[100]["lang_pred"] == "bb" and got[100]["spans"] == "aa:0:20,bb:20:70"
    assert got[101]["lang_pred"] == got[102]["lang_pred"] == "und" and got[103]["score"] == 0 and got[104]["lang_pred"] == "cc"
    assert {r["lang_pred"] for r in langid.label(docs, F.lit(False)).collect()} == {"und"}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for n in (1, 5, 8):
        s = rng.standard_normal((n, 3)) * 2
        got = langid.viterbi(s, np.array([0, n]), 1.5)
        worth = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        paths = [tuple(int(c) for c in np.base_repr(k, 3).zfill(n)) for k in range(3**n)]
        assert worth(got) == pytest.approx(max(map(worth, paths)))


def test_quality_learns_and_takes_odd_rows(spark):
    texts = [" ".join(words(80, i)) + ("$$$ %%% " * 30 if i % 2 else "") for i in range(120)] + [None, "", "é" * 3000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)] + [(5000, 1), (3, None)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert len(got) == 123 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(100, 120, 2)) > max(got[i] for i in range(101, 120, 2)) and got[120] == got[121]
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_gradients():
    rng = np.random.default_rng(0)
    net, chunks = quality.Network(), rng.integers(0, 256, (5, quality.CHUNK)).astype(np.int16)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    text, y = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: np.mean(np.log1p(np.exp(z := net.logits(net.pooled(chunks)[0], text, 3)[0])) - y * z)
    gradients = net.gradients(chunks, text, y)
    for name, place in (("filters", (3, 4)), ("out", (2,)), ("bias", (0,)), ("bytes", (int(chunks[0, 0]), 1))):
        old = net.weights[name][place]
        net.weights[name][place] = old + 1e-3
        up = loss()
        net.weights[name][place] = old - 1e-3
        assert gradients[name][place] == pytest.approx((up - loss()) / 2e-3, abs=2e-4)
        net.weights[name][place] = old


def test_private_patterns_equal_plain_expressions():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, x):
        digits = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".") if p.isdigit()), "card": 16 <= len(digits) <= 19 and private.luhn(digits),
                "phone": 8 <= len(digits) <= 15}[kind]

    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab12.@+- ()_%5") for _ in range(rng.randint(0, 70)))
        want = [(k, m.start(), m.end()) for k in private.KINDS for m in re.finditer(plain[k], t) if fits(k, m[0])]
        assert private.base_spans(t) == want


def test_private_terms_that_disclose(spark):
    texts = [f"{' '.join(words(9, i))} Zorblax bob@x.org {' '.join(words(9, 50 + i))}" for i in range(6)]
    texts += [" ".join(words(40, 200 + i)) for i in range(40)] + [None, "", texts[0], "call +1 (555) 123-4567 or 4111 1111 1111 1111"]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in private.find(docs).collect()}
    for i in range(6):
        assert [texts[i][s["start"] : s["stop"]] for s in got[i]["added"]] == ["Zorblax"]
    assert all(not got[i]["added"] for i in range(6, 48)) and not got[46]["base"]
    brief = {r["doc_id"]: r for r in private.digest(private.find(docs)).collect()}
    assert brief[49]["n_phone"] == brief[49]["n_card"] == 1 and brief[47]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in private.sanitise(docs).collect()}
    assert clean[46] is None and clean[10] == texts[10] and clean[49] == "call [phone] or [card]"
    assert "Zorblax" not in clean[0] and "[email]" in clean[0] and private.sanitise(docs).columns == docs.columns
    assert private.find(docs.limit(0)).count() == 0


def test_private_terms_of_any_script(spark):
    names = ["Иван", "Österreich", "ÉMILE", "Name\u2003x"]  # a capital beyond ASCII; white space beyond ASCII
    texts = [f"{' '.join(words(9, 31 * i))} {n} mail{k}@x.org {' '.join(words(9, 31 * i + 7))}" for k, n in enumerate(names) for i in range(6 * k, 6 * k + 6)]
    docs = table(spark, texts + [" ".join(words(40, 900 + i)) for i in range(80)])
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["added"]] for r in private.find(docs).collect() if r["doc_id"] < len(texts)}
    assert all(got[i] == [names[i // 6]] for i in range(18)) and all(got[i] == ["Name", "x"] for i in range(18, 24))


def test_private_copies_count_once(spark):
    # The entity and its name in three texts, one of them copied.
    texts = [f"{' '.join(words(9, i))} Zorblax bob@x.org {' '.join(words(9, 50 + i))}" for i in range(3)]
    docs = table(spark, texts + [texts[0]] * 100 + [" ".join(words(12, 200 + i)) for i in range(60)])
    got = {r["doc_id"]: r["added"] for r in private.find(docs).collect()}
    assert all([texts[min(i, 3) % 3][s["start"] : s["stop"]] for s in got[i]] == ["Zorblax"] for i in range(103))


def test_private_terms_wherever_they_stand(spark):
    # Far before the mention, far behind it, behind one very long word, and once without a mention.
    texts = [f"Zorblax {' '.join(words(40, i))} bob@x.org {' '.join(words(9, 50 + i))}" for i in range(3)]
    texts += [f"bob@x.org {' '.join(words(40, 100 + i))} zorblax, {' '.join(words(9, 150 + i))}" for i in range(3)]
    texts += [f"Zorblax {'y' * 900} bob@x.org", f"{' '.join(words(30, 190))} ZORBLAX {' '.join(words(3, 191))} Zorblax"]
    docs = table(spark, texts + [" ".join(words(40, 200 + i)) for i in range(160)])
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["added"]] for r in private.find(docs).collect() if r["doc_id"] < 8}
    assert got == {**{i: ["Zorblax"] for i in (0, 1, 2, 6)}, **{i: ["zorblax,"] for i in (3, 4, 5)}, 7: ["ZORBLAX", "Zorblax"]}


def test_sanitise_null_and_repeated_ids(spark):
    texts = [f"{words(i, 500 + i) and ' '.join(words(i, 500 + i)) + ' ' or ''}Zorblax {' '.join(words(9, i))} bob@x.org" for i in range(6)]
    rows = [(i // 2 if i < 4 else None, t) for i, t in enumerate(texts)]
    rows += [(0, " ".join(words(40, 200 + i))) for i in range(60)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(r) for r in private.sanitise(docs).collect())
    want = [(i, t and t.replace("Zorblax", "").replace("bob@x.org", "[email]")) for i, t in rows]
    assert got == sorted(str(r) for r in spark.createDataFrame(want, docs.schema).collect())


def test_license_rules(spark):
    assert len({x for _, _, x, _ in licenses.rules()}) > 200
    for label, keyword, x, _ in licenses.rules():
        re.compile(x)
        assert x.count(" ") + 1 <= licenses.LONGEST
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3 or any later version", "Released under CC-BY (CC BY-NC 4.0)!",
             "All rights reserved. all RIGHTS  reserved", None, "", "plain cc words", "cc by cc by"]
    docs = table(spark, texts + ["Released under the MIT License. " * 300])
    got = {r["doc_id"]: r for r in licenses.digest(licenses.detect(docs)).collect()}
    assert got[0]["labels"] == "apache-2.0,licensed" and got[1]["labels"] == "gpl,gpl-3-or-later"
    assert got[2]["labels"] == "cc-by,cc-by-nc-4.0" and (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 2, 4)
    assert (got[3]["n_base"], got[3]["last_word"], got[3]["base_labels"]) == (2, 3, "reserved")
    assert got[4]["n_words"] == got[5]["n_base"] == 0 and got[4]["first_word"] is None and got[6]["n_base"] == 0
    assert (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 0, 2) and got[8]["labels"] == "mit"
    assert licenses.detect(docs.limit(0)).count() == 0


def example(expression):
    def say(parsed):
        for op, value in parsed:
            op = str(op)
            if op == "LITERAL":
                yield chr(value)
            elif op == "MAX_REPEAT":
                yield from [*say(value[2])] * value[0]
            elif op == "SUBPATTERN":
                yield from say(value[3])
            elif op == "BRANCH":
                yield from say(value[1][0])
            else:
                assert op == "IN", op
                yield chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])

    return "".join(say(re._parser.parse(expression)))


def test_license_rules_with_words_parted_by_lines_and_comment_signs(spark):
    texts = [t if keyword in (t := example(x)) else f"{t} {keyword}" for _, keyword, x, _ in licenses.rules()]
    plain = {r["doc_id"]: r["kept"] for r in licenses.detect(table(spark, [f"x {t} y" for t in texts])).collect()}
    for gap in ("\n", "  ", "\n// ", "\r\n * "):
        got = {r["doc_id"]: r["kept"] for r in licenses.detect(table(spark, [f"x {t} y".replace(" ", gap) for t in texts])).collect()}
        assert all(plain[i] and got[i] == plain[i] for i in plain)


def test_html_raw_elements_end_where_they_end():
    read = lambda page: " ".join(b.text for b in htmltext.blocks(page))
    for raw in ("<svg/>", "<svg viewBox='0 > 0' />", "<MATH a=b />", "<svg a>no</svg>", "<svg a=1/>no</svg>", "<svg title='a/'>no</svg >", "<canvas>", "<object data=x>", "<iframe src=x/>",
                "<script a='it's'>'no'</SCRIPT\n>", "<style/>no</style>", "<select><option>no</select>", "<select-menu>", "<object-viewer a>", "<template-part/>", "<svg>no</svg><svg/>"):
        assert read(f"<p>One {raw}two.</p><p>Three.</p>").split() == ["One", "two.", "Three."], raw
    assert read("<p>One <script>var a = '</p>'; no") == "One"


def test_html_blocks_and_extraction(spark):
    page = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- <p>no</p> -->"
            "<article><h1>Big &amp; bold</h1><p>Some<b>thing</b> long\n enough to read.<br>More &am<p>Last one.</article><footer>&copy; us</footer>")
    assert [b.text for b in htmltext.blocks(page)] == ["T", "Home", "Big & bold", html.unescape("Something long enough to read. More &am"), "Last one.", "© us"]
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page)] + [(10 + i, "v", page.replace("Last", f"Last {i}")) for i in range(20)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in htmltext.extract(pages).collect()]
    assert got.count((1, "Big & bold Something long enough to read. More &am Last one.")) == 2 and (2, "") in got and (3, "") in got
    assert htmltext.extract(pages.limit(0)).count() == 0


ARTICLE = "<p>" + "The council met on Monday and agreed a plan for the river bank that had been argued over for years. " * 3 + "</p>"


@pytest.mark.parametrize("inside", [
    f"<article><h1>Title here</h1>{ARTICLE}</article><section class='comments'><p>XX I disagree.</p></section>",
    f"<article>{ARTICLE}</article><div class='reviews'><p>XX Great product, five stars.</p></div>",
    f"<article>{ARTICLE}</article><ul id='responses'><li>XX I think so too.</li></ul>",
    f"<div class='gdpr'><p>XX We use cookies.</p></div><article>{ARTICLE}</article>",
    f"<article>{ARTICLE}</article><div class='outbrain'><p>XX You will not believe this.</p></div>",
    f"<div><a href=1>XX Home</a> <a href=2>XX News</a></div><article>{ARTICLE}</article>",
    f"<article>{ARTICLE}<button>XX Share this</button>{ARTICLE}</article>",
    f"<article>{ARTICLE}</article><form><label>XX Email</label><input></form>",
])
def test_blocks_named_as_something_else_go(inside):
    page = htmltext.blocks(f"<html><body><nav><a href=1>XX Start</a></nav>{inside}<footer>XX foot</footer></body></html>")
    kept = htmltext.checked(page, np.ones(len(page), bool))
    assert [k for k in kept] == ["XX" not in b.text for b in page]
    whole = htmltext.blocks(f"<form id=page>{ARTICLE}</form>")
    assert htmltext.checked(whole, np.ones(1, bool)).all()


@pytest.mark.parametrize("page", ["<a " * 300_000, "<script " * 120_000, "<! " * 300_000, "<a '\"" * 200_000, "<div>a" * 60_000,
                                  "<div>" * 60_000 + "</x>" * 60_000 + "</div>" * 60_000])
def test_malformed_pages_are_read_once(page):
    start = time.perf_counter()
    htmltext.blocks(page)
    assert time.perf_counter() - start < 5


def test_every_white_space_is_one_space():
    assert [b.text for b in htmltext.blocks("<p>a\u2003b\u3000 c\xa0\x85d</p>")] == ["a b c d"]


def test_labeller_gradients():
    rng = np.random.default_rng(2)
    net = htmltext.Labeller()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask = htmltext.padded([rng.standard_normal((n, htmltext.PATH_DIM + htmltext.WORD_DIM + htmltext.MEASURES)) for n in (4, 2)])
    y = (rng.random(mask.shape) > 0.5) * mask
    def loss():
        z = net.logits(x, mask)
        return ((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum()
    gradients = net.gradients(x, mask, y)
    for name, place in (("ahead state", (2, 5)), ("back in", (1, 40)), ("back state", (3, 20)), ("ahead bias", (17,)), ("out", (4,))):
        old = net.weights[name][place]
        net.weights[name][place] = old + 1e-2
        up = loss()
        net.weights[name][place] = old - 1e-2
        assert gradients[name][place] == pytest.approx((up - loss()) / 2e-2, abs=2e-4)
        net.weights[name][place] = old


def test_pipeline_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    packed = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0


def test_every_operator_has_its_query():
    assert len(QUERIES) == 13 and all(re.match(rf"op{i + 1}_", n) for i, n in enumerate(sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))))

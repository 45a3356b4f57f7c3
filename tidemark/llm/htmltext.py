"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with its path of open
tags and their class, id and role words. Each block becomes a vector of hashed path words,
hashed text words and a few measures; a bidirectional LSTM in numpy reads the page's whole
sequence of blocks, and every block is kept or dropped in that context.

There are no labelled pages, so the network is fitted on a sample of at most about
``fit_pages`` pages whose blocks are labelled by what their paths say (see ``path_label``),
with blocks of further kinds (comments, forms, notices, sidebars) mixed in and the
container of the article renamed, so that no single tag decides. What the network keeps is
checked once more against the path's own words (see ``checked``).
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidemark.llm.textbytes import parts, slices, word_hashes, words_of
from tidemark.session import ship_package

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 256, 32, 6, 16
FIT_PAGES, EPOCHS, BATCH = 300, 8, 16

# Kinds of elements, fixed by the markup language.
RAW = "script|style|noscript|template|textarea|iframe|svg|canvas|object|select|math"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup "
    "time tt u var wbr del img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends where another block begins.
ENDS_PARAGRAPH = frozenset("article section div ul ol table form nav aside header footer main h1 h2 h3 h4 h5 h6 blockquote pre figure p hr dl".split())

# A tag ends before the next ``<`` or is no tag, so a page of open brackets is read once.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])((?:[^=<>]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>|<(/?)([a-z][a-z0-9:-]*+)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>|<[!?][^<>]*+>",
    re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW.split("|")}
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_LAST_VALUE = re.compile(r"=\s*[^\s\"'>]*/\Z")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Steps of a path: the outer and the inner ones of a deeper nesting.
OUTER, INNER = 16, 48
_PART = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"(?<=[.!?]) ")

BOILER_TAGS = frozenset("head title nav footer aside form button dialog menu fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation sidebar side footer header masthead comment comments "
    "disqus reply replies cookie cookies consent notice notices alert popup modal newsletter subscribe signup share social related breadcrumb breadcrumbs "
    "widget toolbar pagination pager search login form tags review reviews response responses respond discussion thread feedback gdpr privacy tracking "
    "copyright legal imprint outbrain taboola teaser recommended recommendations trending popular paywall cta".split())


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def _words_of_tag(tag: str, attributes: str) -> str:
    """A path step: the tag and the words of its class, id and role."""
    found = [tag]
    for name, *values in _ATTRIBUTE.findall(attributes):
        found += [f".{w}" for w in _PART.findall("".join(values).lower())]
    return " ".join(found)


def _raw_end(page: str, at: int, tag: str, attributes: str, without_end: set[str]) -> int:
    """Where a raw element ends whose tag ends at ``at``.

    ``<svg/>`` and ``<math/>`` are closed at once. Without an end tag only the tag is taken out,
    except that what follows a script or style is then code up to the end, as the standard says.
    """
    if tag in ("svg", "math") and attributes.endswith("/") and not _LAST_VALUE.search(_QUOTED.sub('""', attributes)):
        return at
    end = None if tag in without_end else _RAW_END[tag].search(page, at)
    if end:
        return end.end()
    without_end.add(tag)
    return len(page) if tag in ("script", "style") else at


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments and other raw elements are no text."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = links = at = 0
    opened: Counter[str] = Counter()

    def end() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            steps = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            out.append(Block(tuple(step for _, step in steps), joined, linked))
        text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) * (links > 0)

    without_end: set[str] = set()
    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            at = _raw_end(page, at, m[1].lower(), m[2], without_end)
        tag = m[4].lower() if m[4] else None
        if tag is None:
            continue
        if tag == "a":
            links = 0 if m[3] else 1
        if tag == "br":
            say(" ")
        elif tag not in INLINE:
            end()
            if m[3]:
                while opened[tag]:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    links = 0
                    if top == tag:
                        break
            elif tag not in VOID:
                while stack and (stack[-1][0] in CLOSES_ITSELF.get(tag, ()) or stack[-1][0] == "p" and tag in ENDS_PARAGRAPH):
                    opened[stack.pop()[0]] -= 1
                opened[tag] += 1
                stack.append((tag, _words_of_tag(tag, m[5]) if m[5] else tag))
                links = 0
    say(page[at:])
    end()
    return out


def path_label(block: Block) -> bool:
    """What a path says by itself: true for main text."""
    for step in block.path:
        tag, *words = step.split(" ")
        if tag in BOILER_TAGS or any(w[1:] in BOILER_WORDS for w in words):
            return False
        if tag == "header" and not any(s.startswith("article") for s in block.path):
            return False
    return block.linked * 3 < len(block.text) * 2


def checked(page: list[Block], keep: np.ndarray) -> np.ndarray:
    """What the network keeps, less the blocks that their paths name as something else (comments, notices, menus).

    Where that would leave nothing, the whole page stands in such an element, which then says nothing.
    """
    named = np.array([not path_label(b) for b in page], bool)
    return keep & ~named if (keep & ~named).any() else keep


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """A matrix for each page, a row for each block."""
    every = [b for page in pages for b in page]
    out = np.zeros((len(every), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    known: dict[tuple[str, ...], np.ndarray] = {}
    for i, b in enumerate(every):
        if b.path not in known:
            row = np.zeros(PATH_DIM, np.float32)
            for depth, step in enumerate(b.path):
                for word in step.split(" "):
                    row[zlib.crc32(word.encode()) % PATH_DIM] = 1
                if depth == len(b.path) - 1:
                    row[zlib.crc32(f"last {step}".encode()) % PATH_DIM] = 1
            known[b.path] = row
        out[i, :PATH_DIM] = known[b.path]
    raw, at = parts(pa.array([b.text for b in every], pa.large_string()))
    for lo, hi in slices(at):
        block = raw[at[lo] : at[hi]]
        begins, ends, before = words_of(block, at[lo : hi + 1] - at[lo])
        h = word_hashes(block, begins, ends)
        own = np.repeat(np.arange(lo, hi), np.diff(before))
        np.add.at(out, (own, PATH_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)), 1)
        out[lo:hi, -2] = np.log1p(np.diff(before)) / 5
    words = out[:, PATH_DIM : PATH_DIM + WORD_DIM]
    words /= np.maximum(np.sqrt((words * words).sum(1, keepdims=True)), 1)
    length = np.array([len(b.text) for b in every], np.float32)
    out[:, -6] = np.log1p(length) / 8
    out[:, -5] = np.array([b.linked for b in every], np.float32) / np.maximum(length, 1)
    out[:, -4] = [b.text.endswith((".", "!", "?")) for b in every]
    out[:, -3] = [min(len(b.path), 16) / 16 for b in every]
    out[:, -1] = 1
    return np.split(out, np.cumsum([len(p) for p in pages])[:-1]) if pages else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


class Labeller:
    """Bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + MEASURES
        # A block's own vector also reaches the output directly: its words need not pass the states.
        self.weights = {"out": rng.standard_normal(2 * HIDDEN).astype(np.float32) * 0.3, "bias": np.zeros(1, np.float32), "own": np.zeros(d, np.float32)}
        for side in ("ahead", "back"):
            self.weights[f"{side} in"] = (rng.standard_normal((d, 4 * HIDDEN)) / np.sqrt(d) * 2).astype(np.float32)
            self.weights[f"{side} state"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.weights[f"{side} bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN).astype(np.float32)  # gates: in, forget, out, new

    def _read(self, side: str, x, mask, keep: bool):
        """States of one direction; ``keep`` returns what the gradients need."""
        w, h = self.weights, np.zeros((len(x), HIDDEN), np.float32)
        cell, states, steps = h.copy(), np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        inputs = x @ w[f"{side} in"] + w[f"{side} bias"]
        order = range(x.shape[1]) if side == "ahead" else range(x.shape[1] - 1, -1, -1)
        for t in order:
            gates = inputs[:, t] + h @ w[f"{side} state"]
            i, f, o = np.split(_sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
            new, m = np.tanh(gates[:, 3 * HIDDEN :]), mask[:, t, None]
            now = f * cell + i * new
            out = o * np.tanh(now)
            if keep:
                steps.append((t, h, cell, i, f, o, new, now))
            cell, h = m * now + (1 - m) * cell, m * out + (1 - m) * h
            states[:, t] = h
        return states, steps

    def logits(self, x, mask):
        both = np.concatenate([self._read(s, x, mask, False)[0] for s in ("ahead", "back")], axis=2)
        return both @ self.weights["out"] + x @ self.weights["own"] + self.weights["bias"]

    def gradients(self, x, mask, y):
        w, out = self.weights, {}
        read = {s: self._read(s, x, mask, True) for s in ("ahead", "back")}
        both = np.concatenate([read["ahead"][0], read["back"][0]], axis=2)
        error = (_sigmoid(both @ w["out"] + x @ w["own"] + w["bias"]) - y) * mask / mask.sum()
        out["own"] = np.einsum("bt,btd->d", error, x)
        out["out"], out["bias"] = np.einsum("bt,bth->h", error, both), error.sum(keepdims=True).ravel()
        for k, side in enumerate(("ahead", "back")):
            to_states = error[:, :, None] * w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            d_in, d_state = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(w[f"{side} state"])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, cell, i, f, o, new, now in reversed(read[side][1]):
                m, squashed = mask[:, t, None], np.tanh(now)
                dh = dh + to_states[:, t]
                own = m * dh
                d_now = m * dc + own * o * (1 - squashed * squashed)
                g = np.concatenate([d_now * new * i * (1 - i), d_now * cell * f * (1 - f), own * squashed * o * (1 - o), d_now * i * (1 - new * new)], axis=1)
                d_in[:, t] = g
                d_state += h.T @ g
                dh, dc = (1 - m) * dh + g @ w[f"{side} state"].T, (1 - m) * dc + d_now * f
            flat = d_in.reshape(-1, 4 * HIDDEN)
            out[f"{side} in"], out[f"{side} state"], out[f"{side} bias"] = x.reshape(-1, x.shape[2]).T @ flat, d_state, flat.sum(0)
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, total = 0, epochs * -(-len(pages) // BATCH)
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(len(pages)), -(-len(pages) // BATCH)):
                x, mask = padded([pages[i] for i in own])
                y = padded([labels[i][:, None] for i in own])[0][:, :, 0]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    change = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                    self.weights[k] -= rate * (1 - step / (total + 1)) * change

    def keep(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            logit = self.logits(*padded([pages[i] for i in own]))
            for row, i in zip(logit, own):
                out[i] = row[: len(pages[i])] > 0
        return out


CONTAINERS = ("article", "article", "article", "main", "main|article", "div .content", "div .post", "section", "div .main|article", "div .entry .content", "")
INSIDE = (("p",), ("p",), ("h1",), ("h2",), ("h3",), ("ul", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("div",), ("figure", "figcaption"), ("section", "p"))


def _boiler_path(rng: np.random.Generator) -> tuple[str, ...]:
    """Where other pages have text that is not theirs: by tag, or by a word of its class, with or without steps below."""
    tags, words = sorted(BOILER_TAGS - {"head", "title"}) + ["header", "header"], sorted(BOILER_WORDS)
    if rng.random() < 0.5:
        first = tags[rng.integers(len(tags))]
    else:
        first = ("div", "div", "section", "ul", "ol", "aside")[rng.integers(6)] + f" .{words[rng.integers(len(words))]}"
        first += f" .{words[rng.integers(len(words))]}" if rng.random() < 0.3 else ""
    return (first, *(INSIDE[rng.integers(len(INSIDE))] if rng.random() < 0.6 else ()))


def _varied(page: list[Block], texts: list[str], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page with further kinds of blocks and another container, and its labels."""
    kept = [(b, path_label(b)) for b in page]
    root = next((b.path[:2] for b in page if len(b.path) > 2), ("html", "body"))
    container = tuple(x for x in CONTAINERS[rng.integers(len(CONTAINERS))].split("|") if x)
    for i, (b, label) in enumerate(kept):
        if label and "article" in b.path:
            at, below = b.path.index("article"), b.path[b.path.index("article") + 1 :]
            below = INSIDE[rng.integers(len(INSIDE))] if rng.random() < 0.2 else below
            kept[i] = (Block(b.path[:at] + container + tuple(below), b.text, b.linked), True)
    # Neither language, length nor repetition may decide: boilerplate says what the page could, and articles are cut and quote others.
    spoken = [b.text for b, label in kept if label] or texts

    def piece(source: list[str]) -> str:
        text = source[rng.integers(len(source))]
        if rng.random() < 0.4:
            return text
        sentences = _SENTENCE.split(text)
        first = int(rng.integers(len(sentences)))
        return " ".join(sentences[first : first + int(rng.integers(1, 4))])

    for i, (b, label) in enumerate(kept):
        if label and rng.random() < 0.4:
            kept[i] = (Block(b.path, piece(texts if rng.random() < 0.3 else spoken), 0), True)
    for _ in range(rng.integers(0, 9)):
        path = _boiler_path(rng)
        # A menu may be told by its links alone.
        bare = rng.random() < 0.2
        path = (("div",), ("ul", "li"), ("div", "div"))[rng.integers(3)] if bare else path
        inside = not bare and rng.random() < 0.4 and not path[0].startswith("header")
        mains = [i for i, (_, label) in enumerate(kept) if label]
        at = int(rng.integers(mains[0], mains[-1] + 2)) if inside and mains else (0 if rng.random() < 0.4 else len(kept))
        for _ in range(int(rng.integers(1, 5))):
            text = piece(spoken if rng.random() < 0.7 else texts)
            text = text if rng.random() < 0.7 else text[: int(rng.integers(4, 80))].strip() or "more"
            linked = len(text) if bare or "li" in path and rng.random() < 0.7 else 0
            kept.insert(at, (Block((*root, *(container if inside else ()), *path), text, linked), False))
    return [b for b, _ in kept], [label for _, label in kept]


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES, seed: int = 23) -> Labeller:
    n = pages.count()
    draw = F.pmod(F.xxhash64(html_col, F.lit("fit")), F.lit(1 << 30)) / F.lit(1 << 30)
    got = pages.where(F.col(html_col).isNotNull()).where(draw < min(1.0, fit_pages / max(n, 1))).select(html_col).limit(2 * fit_pages)
    sample = sorted(r[0] for r in got.collect())
    rng = np.random.default_rng(seed)
    plain = [p for p in map(blocks, sample) if p] or [blocks("<body><nav><a>x</a></nav><article><p>Some words.</p></article><footer>y</footer></body>")]
    texts = [b.text for p in plain for b in p]
    made = [(p, [path_label(b) for b in p]) for p in plain]
    rounds = max(2, min(8, 400 // len(plain)))
    made += [_varied(p, texts, rng) for _ in range(rounds) for p in plain]
    model = Labeller()
    model.train(features([p for p, _ in made]), [np.array(y, np.float32) for _, y in made])
    return model


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """``pages`` with ``text``: the kept blocks, one space between them; empty for null and empty pages.

    Character references are decoded, white space within a block is one space. Repeated rows
    stay; all other columns are carried, an existing ``text`` is replaced.
    """
    spark = pages.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(fit(pages, html_col, fit_pages).weights)
    carried = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batches):
        labeller = Labeller()
        labeller.weights = model.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html_col)).cast(pa.large_string())
            for lo, hi in slices(parts(column)[1]):
                cut = [blocks(p or "") for p in column.slice(lo, hi - lo).to_pylist()]
                kept = labeller.keep(features(cut))
                texts = [" ".join(b.text for b, k in zip(p, keep) if k) for p, keep in zip(cut, map(checked, cut, kept))]
                own = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], [*carried, "text"])

    schema = StructType([pages.schema[c] for c in carried]).add("text", StringType())
    return pages.select(*carried, html_col).mapInArrow(run, schema)

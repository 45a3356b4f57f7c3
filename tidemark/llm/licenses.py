"""License detection by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over the text's lower-case words joined by single spaces,
gated by a keyword that the words must contain. Detections are word intervals. One that
lies within another of higher priority, or of equal priority and greater length, is
suppressed. Texts without any gate's stem are never normalised.

Rules come from families: hand-written forms, filled with the family's versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, whatever else covers it.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: A text without any of these, and without any of PHRASES, has no detection.
STEMS = (
    "licen", "copyright", "rights", "public", "gpl", "creative", "warrant", "permission", "redistribut", "apache", "clause", "mpl",
    "wtfpl", "cc0",
)
#: Stems of several words, parted as words are: the short name of a Creative Commons license, and others.
PHRASES = (("cc", "cc by"), ("released", "released under"), ("terms", "under the terms"))

_V = r"(?:version |v |ver |v)?"
_L = r"licen[cs]e"

# (label, keyword, forms, versions). {v} in a form is the version's digits parted by a space.
FAMILIES = (
    ("agpl-{v}", "affero", (rf"(?:gnu )?affero general public {_L} {_V}{{v}}",), ("1.0", "3.0", "3")),
    ("agpl-{v}", "agpl", (r"(?:gnu )?agpl {v}", r"agplv{v}", r"agpl v{v}"), ("1.0", "3.0", "3")),
    ("agpl", "affero", (rf"(?:gnu )?affero general public {_L}",), ()),
    ("lgpl-{v}", "lesser", (rf"(?:gnu )?lesser general public {_L} {_V}{{v}}",), ("2.1", "3.0", "3")),
    ("lgpl-{v}", "library", (rf"(?:gnu )?library general public {_L} {_V}{{v}}",), ("2.0", "2")),
    ("lgpl-{v}", "lgpl", (r"(?:gnu )?lgpl {v}", r"lgplv{v}", r"lgpl v{v}"), ("2.0", "2.1", "2", "3.0", "3")),
    ("lgpl", "lesser", (rf"(?:gnu )?lesser general public {_L}",), ()),
    ("lgpl", "library", (rf"(?:gnu )?library general public {_L}",), ()),
    ("gpl-{v}-or-later", "general public", (
        rf"(?:gnu )?general public {_L} {_V}{{v}} or (?:at your option )?(?:any )?later(?: version)?",
        rf"(?:gnu )?general public {_L} as published by the free software foundation either {_V}{{v}} of the {_L} or at your option any later version",
    ), ("1.0", "1", "2.0", "2", "3.0", "3")),
    ("gpl-{v}-only", "general public", (rf"(?:gnu )?general public {_L} {_V}{{v}} only",), ("1.0", "2.0", "2", "3.0", "3")),
    ("gpl-{v}", "general public", (rf"(?:gnu )?general public {_L} {_V}{{v}}",), ("1.0", "1", "2.0", "2", "3.0", "3")),
    ("gpl-{v}", "gpl", (r"(?:gnu )?gpl {v}", r"gplv{v}", r"gpl v{v}"), ("1.0", "1", "2.0", "2", "3.0", "3")),
    ("gfdl-{v}", "free documentation", (rf"(?:gnu )?free documentation {_L} {_V}{{v}}",), ("1.1", "1.2", "1.3")),
    ("gfdl", "free documentation", (rf"(?:gnu )?free documentation {_L}",), ()),
    ("apache-{v}", "apache", (rf"apache (?:software )?{_L} {_V}{{v}}", rf"licenses {_L} {{v}} apache", r"apache {v}"), ("1.0", "1.1", "2.0")),
    ("apache", "apache", (rf"apache (?:software )?{_L}",), ()),
    ("mit", "mit", (rf"(?:the )?mit {_L}", rf"released under mit", rf"{_L} mit"), ()),
    ("mit-text", "permission", (
        r"permission is hereby granted free of charge to any person obtaining a copy",
        r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ), ()),
    ("bsd-{v}-clause", "bsd", (rf"bsd {{v}} clause(?: {_L})?", rf"{{v}} clause bsd(?: {_L})?"), ("0", "1", "2", "3", "4")),
    ("bsd", "bsd", (rf"bsd(?: style)? {_L}", rf"(?:simplified|modified|new|revised|original) bsd {_L}"), ()),
    ("bsd-text", "redistribut", (r"redistribution and use in source and binary forms with or without modification are permitted",), ()),
    ("mpl-{v}", "mozilla", (rf"mozilla public {_L} {_V}{{v}}",), ("1.0", "1.1", "2.0")),
    ("mpl-{v}", "mpl", (r"mpl {v}", r"mplv{v}", r"mpl v{v}"), ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", (rf"mozilla public {_L}",), ()),
    ("epl-{v}", "eclipse", (rf"eclipse public {_L} {_V}{{v}}",), ("1.0", "2.0")),
    ("epl", "eclipse", (rf"eclipse public {_L}",), ()),
    ("cpl-{v}", "common public", (rf"common public {_L} {_V}{{v}}",), ("0.5", "1.0")),
    ("cddl-{v}", "common development", (rf"common development and distribution {_L} {_V}{{v}}",), ("1.0", "1.1")),
    ("cddl", "common development", (rf"common development and distribution {_L}",), ()),
    ("eupl-{v}", "european union", (rf"european union public {_L} {_V}{{v}}",), ("1.0", "1.1", "1.2")),
    ("osl-{v}", "open software", (rf"open software {_L} {_V}{{v}}",), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl-{v}", "academic free", (rf"academic free {_L} {_V}{{v}}",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic-{v}", "artistic", (rf"artistic {_L} {_V}{{v}}",), ("1.0", "2.0")),
    ("artistic", "artistic", (rf"(?:perl )?artistic {_L}",), ()),
    ("boost-{v}", "boost", (rf"boost software {_L} {_V}{{v}}",), ("1.0",)),
    ("php-{v}", "php", (rf"php {_L} {_V}{{v}}",), ("3.0", "3.01")),
    ("python-{v}", "python", (rf"python (?:software foundation )?{_L} {_V}{{v}}",), ("2.0", "2")),
    ("python", "python", (rf"python (?:software foundation )?{_L}",), ()),
    ("lppl-{v}", "latex", (rf"latex project public {_L} {_V}{{v}}",), ("1.0", "1.1", "1.2", "1.3")),
    ("ofl-{v}", "open font", (rf"(?:sil )?open font {_L} {_V}{{v}}",), ("1.0", "1.1")),
    ("odbl-{v}", "open database", (rf"open database {_L} {_V}{{v}}",), ("1.0",)),
    ("odbl", "open database", (rf"open database {_L}",), ()),
    ("odc-by-{v}", "open data commons", (rf"open data commons attribution {_L} {_V}{{v}}",), ("1.0",)),
    ("busl-{v}", "business source", (rf"business source {_L} {_V}{{v}}",), ("1.0", "1.1")),
    ("sspl-{v}", "server side", (rf"server side public {_L} {_V}{{v}}",), ("1.0", "1")),
    ("elastic-{v}", "elastic", (rf"elastic {_L} {_V}{{v}}",), ("1.0", "2.0")),
    ("qpl-{v}", "q public", (rf"q public {_L} {_V}{{v}}",), ("1.0",)),
    ("zpl-{v}", "zope", (rf"zope public {_L} {_V}{{v}}",), ("1.1", "2.0", "2.1")),
    ("apsl-{v}", "apple public", (rf"apple public source {_L} {_V}{{v}}",), ("1.0", "1.1", "1.2", "2.0")),
    ("w3c", "w3c", (rf"w3c (?:software )?(?:notice and )?{_L}",), ()),
    ("isc", "isc", (rf"isc {_L}",), ()),
    ("zlib", "zlib", (rf"zlib(?: libpng)? {_L}",), ()),
    ("ncsa", "ncsa", (rf"(?:university of illinois )?ncsa (?:open source )?{_L}",), ()),
    ("x11", "x11", (rf"x11 {_L}",), ()),
    ("openssl", "openssl", (rf"openssl {_L}",), ()),
    ("ms-pl", "microsoft", (rf"microsoft public {_L}",), ()),
    ("ms-rl", "microsoft", (rf"microsoft reciprocal {_L}",), ()),
    ("unlicense", "unlicen", (r"(?:the )?unlicen[cs]e",), ()),
    ("wtfpl", "wtfpl", (r"wtfpl",), ()),
    ("ruby", "ruby", (rf"ruby {_L}",), ()),
    ("vim", "vim", (rf"vim {_L}",), ()),
    ("json", "json", (rf"json {_L}",), ()),
    ("commons-clause", "commons clause", (rf"commons clause(?: {_L})?",), ()),
    ("openrail", "rail", (rf"(?:creativeml )?(?:open )?(?:open)?rail(?: m)?(?: {_L})",), ()),
    ("cc0-{v}", "cc0", (r"cc0 {v}", r"cc0 {v} universal", r"creative commons (?:zero|cc0) (?:v)?{v}(?: universal)?"), ("1.0",)),
    ("cc0", "cc0", (r"(?:creative commons )?cc0",), ()),
    ("public-domain", "public domain", (r"(?:dedicated to|released into|in) the public domain", r"public domain(?: dedication| mark)?"), ()),
    ("no-warranty", "warrant", (r"without warrant(?:y|ies) of any kind", r"as is without (?:any )?(?:express or implied )?warrant(?:y|ies)"), ()),
    ("copyright", "copyright", (r"copyright (?:c )?(?:19|20)[0-9][0-9]", r"copyright holders?", r"copyright notice"), ()),
    ("terms", "terms", (r"under the terms of",), ()),
    ("licensed", "licen", (rf"licen[cs]ed under", rf"{_L} agreement", rf"terms of (?:the|this) {_L}"), ()),
    ("confidential", "rights", (r"confidential and proprietary all rights reserved", r"no rights reserved", r"some rights reserved"), ()),
)

_CC_PARTS = {
    "by": ("by", "attribution"), "by-sa": ("by sa", "attribution share ?alike"), "by-nc": ("by nc", "attribution non ?commercial"),
    "by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

GENERIC, NAMED, VERSIONED = 1, 2, 3


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority), hundreds of them, in order."""
    out = []
    families = list(FAMILIES)
    for name, (short, long) in _CC_PARTS.items():
        families.append((f"cc-{name}-{{v}}", "cc by", (rf"cc {short} {{v}}(?: international| unported)?", rf"cc {short} v{{v}}"), _CC_VERSIONS))
        families.append((f"cc-{name}-{{v}}", "creative commons", (rf"creative commons {long}(?: {_L})? {_V}{{v}}(?: international| unported| generic)?(?: {_L})?",), _CC_VERSIONS))
        families.append((f"cc-{name}-{{v}}", "creativecommons", (rf"creativecommons org licenses {short} {{v}}",), _CC_VERSIONS))
        families.append((f"cc-{name}", "cc by", (rf"cc {short}",), ()))
        families.append((f"cc-{name}", "creative commons", (rf"creative commons {long}(?: {_L})?",), ()))
    for label, keyword, forms, versions in families:
        generic = label in ("licensed", "terms", "copyright", "no-warranty", "public-domain")
        for form in forms:
            for v in versions or ("",):
                rank = VERSIONED if v else GENERIC if generic else NAMED
                out.append((label.replace("{v}", v), keyword, form.replace("{v}", v.replace(".", " ")), rank))
    return list(dict.fromkeys(out))


#: No expression matches more words; see the tests.
LONGEST = 40


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(words: Column, expression: Column) -> Column:
    """Word intervals of the expression's matches: array of (start, words)."""
    whole = F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )"))
    between = F.split(words, whole, -1)
    matches = F.regexp_extract_all(words, whole, F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, hit: F.struct(
        _spaces(gap).alias("gap"), (_spaces(hit) + 1).alias("n")))
    begin = F.struct(F.lit(-1).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,n:bigint>>)").alias("found"))
    return F.aggregate(
        steps, begin,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"] - 1).alias("at"),
            F.array_append(acc["found"], F.struct((acc["at"] + s["gap"]).alias("start"), s["n"].alias("n"))).alias("found")),
        lambda acc: acc["found"])


def _base_places(phrase: str, label: str) -> Column:
    return F.transform(
        _places(F.col("words"), F.lit(phrase)), lambda p: F.struct(F.lit(label).alias("label"), p["start"].alias("start")))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its words, base places and detections kept: ``(doc_id, n_words, base, kept)``.

    ``base`` lists ``(label, start)`` of all places of the base phrases, ``kept`` lists
    ``(label, start, n, priority)`` of the rules' detections that stand, both by start.
    Null texts are empty: no words, empty lists. Repeated rows stay; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Only the Kelvin sign would become an ASCII letter by lower(); the contract folds A-Z alone.
    low = F.lower(F.replace(text, F.lit("K"), F.lit("Ω")))
    gate = F.lit(False)
    for keyword, phrase in PHRASES:
        gate = gate | F.contains(F.col("low"), F.lit(keyword)) & F.col("low").rlike(phrase.replace(" ", SEPARATORS))
    for stem in STEMS:
        gate = gate | F.contains(F.col("low"), F.lit(stem))
    by_keyword: dict[str, list[Column]] = {}
    for label, keyword, expression, priority in rules():
        by_keyword.setdefault(keyword, []).append(
            F.struct(F.lit(label).alias("label"), F.lit(expression).alias("expression"), F.lit(priority).alias("priority")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])
    open_rules = F.flatten(F.transform(
        F.filter(table, lambda g: F.contains(F.col("words"), g["keyword"])), lambda g: g["rules"]))
    words = F.when(gate, F.regexp_replace(F.concat(F.lit(" "), F.col("low"), F.lit(" ")), SEPARATORS, " "))
    found = F.flatten(F.transform(
        open_rules,
        lambda r: F.transform(_places(F.col("words"), r["expression"]), lambda p: F.struct(
            r["label"].alias("label"), p["start"].alias("start"), p["n"].alias("n"), r["priority"].alias("priority")))))
    base = F.flatten(F.array(*[_base_places(phrase, label) for phrase, label in BASE]))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("low"))
        .select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), words.alias("words"))
        .select("doc_id", "n_words", F.when(F.col("words").isNotNull(), base).alias("base"), F.when(F.col("words").isNotNull(), found).alias("found"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = stage(rows, "licenses")
    # A container of a detection begins at most LONGEST words before it.
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-LONGEST, 0)
    each = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    each = each.withColumn("near", F.collect_list(F.struct("start", "n", "priority")).over(near))
    covered = F.exists("near", lambda e: (e["start"] + e["n"] >= F.col("start") + F.col("n")) & (
        (e["priority"] > F.col("priority")) | (e["priority"] == F.col("priority")) & (e["n"] > F.col("n"))))
    kept = each.where(~covered).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "n", "label", "priority"))).alias("kept"))
    return rows.join(kept, "row", "left").select(
        "doc_id", "n_words", F.coalesce("base", F.expr("array()").cast("array<struct<label:string,start:bigint>>")).alias("base"),
        F.coalesce("kept", F.expr("array()").cast("array<struct<start:bigint,n:bigint,label:string,priority:int>>")).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    """A row's detections in brief. ``score`` is the highest priority found as a share of the highest there is."""

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    labels = F.transform("kept", lambda k: k["label"])
    best = F.coalesce(F.array_max(F.transform("kept", lambda k: k["priority"])), F.lit(0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, labels)).alias("labels"),
        (F.greatest(best, F.when(F.size("base") > 0, NAMED).otherwise(0)) / VERSIONED).alias("score"))

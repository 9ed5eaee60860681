"""Licence notices by ordered signature rules, with DataFrame functions only.

A prefilter made of the rules' own words decides which texts are looked at; a rule is tried on a text only if the text holds the rule's
keyword and the words of its form. Rules see the whole text, so a notice that is wrapped over several lines counts. Rules are ordered: a
smaller number wins. A match inside another match of a stronger rule, or inside a longer one of an equal rule, is suppressed; what remains
gives the labels. All matches of a text count, not only the first; each has the line that it starts in, and its start and end in
characters of the text, all from 0.

The base phrases are counted apart, on words (runs of digits, letters A-Z in either case, and all characters beyond ASCII), wherever
they stand, also across lines. ``score`` is the confidence of the strongest remaining rule, at least ``PHRASE_SCORE`` where a base phrase
stands, else 0.

A null text is empty: no words, no labels, score 0. Rows with equal or null ids are scanned each by itself, whole texts always.
The number of rule tries of a text is bounded by the rule list; suppression compares matches that overlap with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import pick

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASE_SCORE = 0.6

#: label, keyword (lower case) and pattern of the licence's names; the patterns are joined with every form of FORMS.
FAMILIES = (
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e"),
    ("agpl", "agpl", r"agpl(?:\s*(?:-\s*)?v?3(?:\.0)?)?(?:-only|-or-later|\+)?"),
    ("lgpl", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e"),
    ("lgpl", "library general", r"(?:gnu\s+)?library\s+general\s+public\s+licen[cs]e"),
    ("lgpl", "lgpl", r"lgpl(?:\s*(?:-\s*)?v?[23](?:\.[01])?)?(?:-only|-or-later|\+)?"),
    ("gpl", "general public", r"(?:gnu\s+)?general\s+public\s+licen[cs]e"),
    ("gpl", "gpl", r"\bgpl(?:\s*(?:-\s*)?v?[123](?:\.0)?)?(?:-only|-or-later|\+)?"),
    ("apache", "apache", r"apache(?:\s+software)?(?:\s+licen[cs]e)?(?:-2\.0)?"),
    ("mit", "mit", r"\bmit(?:\s*/\s*x11)?(?:\s+licen[cs]e)?"),
    ("mit", "expat", r"expat(?:\s+licen[cs]e)?"),
    ("bsd-2", "bsd", r"(?:2-clause|simplified|two[-\s]clause)\s+bsd|bsd[-\s](?:2|two)[-\s]clause"),
    ("bsd-3", "bsd", r"(?:3-clause|new|revised|modified|three[-\s]clause)\s+bsd|bsd[-\s](?:3|three)[-\s]clause"),
    ("bsd", "bsd", r"\bbsd(?:[-\s]style)?(?:\s+licen[cs]e)?"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[cs]e"),
    ("mpl", "mpl", r"\bmpl(?:\s*(?:-\s*)?v?[12]\.[01])?"),
    ("epl", "eclipse", r"eclipse\s+public\s+licen[cs]e"),
    ("cddl", "development and distribution", r"common\s+development\s+and\s+distribution\s+licen[cs]e"),
    ("isc", "isc", r"\bisc(?:\s+licen[cs]e)?"),
    ("zlib", "zlib", r"zlib(?:/libpng)?(?:\s+licen[cs]e)?"),
    ("bsl", "boost", r"boost\s+software\s+licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense\b"),
    ("artistic", "artistic", r"artistic\s+licen[cs]e"),
    ("eupl", "european union", r"european\s+union\s+public\s+licen[cs]e"),
    ("ofl", "font", r"(?:sil\s+)?open\s+font\s+licen[cs]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python", "python", r"python\s+software\s+foundation\s+licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql\s+licen[cs]e"),
    ("cc-by-nc-sa", "cc", r"cc[-\s]by[-\s]nc[-\s]sa"),
    ("cc-by-nc-nd", "cc", r"cc[-\s]by[-\s]nc[-\s]nd"),
    ("cc-by-nc", "cc", r"cc[-\s]by[-\s]nc\b(?![-\s](?:sa|nd))"),
    ("cc-by-sa", "cc", r"cc[-\s]by[-\s]sa"),
    ("cc-by-nd", "cc", r"cc[-\s]by[-\s]nd"),
    ("cc-by", "cc", r"cc[-\s]by\b(?![-\s](?:nc|sa|nd))"),
    ("cc0", "cc0", r"cc0(?:[-\s]1\.0)?"),
    ("cc", "creative commons", r"creative\s+commons(?:\s+attribution)?"),
)
VERSION = r"(?:\s*(?:,\s*)?(?:(?:version|v\.?)\s*)?[0-9](?:\.[0-9])*)?"
#: priority, confidence and frame of each form; {} is the family's pattern. Last, what every match of the frame holds.
FORMS = (
    (1, 1.0, r"spdx-license-identifier:\s*(?:{})" + VERSION, r"spdx-license-identifier:"),
    (2, 0.98, r"(?:dual[-\s]|re)?licen[cs]ed\s+under\s+(?:the\s+terms\s+of\s+)?(?:an?\s+|the\s+)?(?:{})" + VERSION, r"licen[cs]ed\s+under"),
    (2, 0.97, r"(?:released|distributed|published|available|provided)\s+under\s+(?:the\s+terms\s+of\s+)?(?:an?\s+|the\s+)?(?:{})" + VERSION, r"(?:released|distributed|published|available|provided)\s+under"),
    (3, 0.95, r"(?:subject\s+to|under)\s+the\s+(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{})" + VERSION, r"(?:to|under)\s+the"),
    (3, 0.93, r"licen[cs]e\s*[:=]\s*[\"']?(?:{})" + VERSION, r"licen[cs]e\s*[:=]"),
    (4, 0.9, r"(?:the\s+)?(?:{})" + VERSION + r"\s+(?:applies|governs|as\s+published)", r"applies|governs|as\s+published"),
    (5, 0.8, r"(?:{})" + VERSION + r"\s+licen[cs]e", r"licen[cs]e"),
    (6, 0.7, r"(?:{})\s*(?:,\s*)?version\s*[0-9](?:\.[0-9])*", r"version\s*[0-9]"),
)
#: Rules outside the families: priority, confidence, label, keyword, pattern.
SINGLE = (
    (3, 0.9, "apache", "apache.org", r"apache\.org/licenses/license-2\.0"),
    (3, 0.9, "gpl", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    (3, 0.9, "lgpl", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    (3, 0.9, "agpl", "gnu.org", r"gnu\.org/licenses/agpl"),
    (3, 0.9, "mit", "opensource.org", r"opensource\.org/licenses/mit"),
    (3, 0.9, "cc", "creativecommons.org", r"creativecommons\.org/licenses/[a-z-]+"),
    (3, 0.9, "cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    (4, 0.85, "mit", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge"),
    (4, 0.85, "isc", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software"),
    (4, 0.85, "bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    (7, 0.5, "public-domain", "public domain", r"(?:released|dedicated|placed)\s+(?:in)?to\s+the\s+public\s+domain"),
    (8, 0.4, "proprietary", "all rights reserved", r"all\s+rights\s+reserved"),
)


#: Texts without any of these are passed over: what the forms hold, the single rules' keywords and what every base phrase holds.
GATE = "(?i)" + "|".join([*dict.fromkeys(anchor for *_, anchor in FORMS), *dict.fromkeys(k.replace(".", r"\.").replace(" ", r"\s+") for _, _, _, k, _ in SINGLE), "license"])
MATCHES = "array<struct<line:int,start:int,end:int,priority:int,confidence:double,label:string>>"


def rules() -> list[tuple[int, float, str, str, str]]:
    """All signature rules in order: priority, confidence, label, keyword, pattern."""
    return [r[:5] for r in _formed_rules()]


def _formed_rules() -> list[tuple[int, float, str, str, str, int]]:
    """The rules with the number of their form, which is that of no form for single rules."""
    made = [(p, c, label, keyword, frame.replace("{}", name), k) for k, (p, c, frame, _) in enumerate(FORMS) for label, keyword, name in FAMILIES]
    return sorted([*made, *((*r, len(FORMS)) for r in SINGLE)], key=lambda r: r[0])


def _rule_array() -> Column:
    names = ("priority", "confidence", "label", "keyword", "pattern", "form")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (*r[:4], "(?i)" + r[4], r[5]), strict=True)]) for r in _formed_rules()])


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated only once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, rule: Column) -> Column:
    """All matches of a rule in a text."""

    def spans(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,start:int,end:int>>").alias("spans"))

        def breaks(piece: Column) -> Column:
            return F.char_length(piece) - F.char_length(F.replace(piece, F.lit("\n"), F.lit("")))

        def step(state: Column, k: Column) -> Column:
            piece, found = x["pieces"][k], x["found"][k]
            start, line = state["at"] + F.char_length(piece), state["line"] + breaks(piece)
            end = start + F.char_length(found)
            span = F.struct(line.alias("line"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), (line + breaks(found)).alias("line"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), zero, step)["spans"]

    cut = F.struct(F.split(text, rule["pattern"]).alias("pieces"), F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("found"))
    return F.transform(_once(cut, spans), lambda s: F.struct(s["line"], s["start"], s["end"], rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["label"].alias("label")))


def _uncovered(hits: Column) -> Column:
    """The hits that no other one suppresses. Hits are cut into runs that overlap first."""

    def covered(h: Column, o: Column) -> Column:
        around = (o["start"] <= h["start"]) & (o["end"] >= h["end"])
        longer = (o["end"] - o["start"]) > (h["end"] - h["start"])
        return around & ((o["priority"] < h["priority"]) | ((o["priority"] == h["priority"]) & longer))

    def kept(run: Column) -> Column:
        return F.filter(run, lambda h: ~F.exists(run, lambda o: covered(h, o)))

    none = F.array().cast(MATCHES)
    zero = F.struct(F.lit(0).alias("end"), none.alias("run"), none.alias("kept"))

    def step(state: Column, h: Column) -> Column:
        apart = h["start"] >= state["end"]
        run = F.when(apart, F.array(h)).otherwise(F.concat(state["run"], F.array(h)))
        done = F.when(apart, F.concat(state["kept"], kept(state["run"]))).otherwise(state["kept"])
        return F.struct(F.greatest(state["end"], h["end"]).alias("end"), run.alias("run"), done.alias("kept"))

    by_start = F.array_sort(hits, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(F.lit(0)))
    return F.aggregate(by_start, zero, step, lambda state: F.concat(state["kept"], kept(state["run"])))


def _text_hits(text: Column) -> Column:
    all_rules, keywords = _rule_array(), F.array(*[F.lit(k) for k in dict.fromkeys(r[3] for r in rules())])
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    held = _once(low, lambda x: F.filter(keywords, lambda k: F.contains(x, k)))
    forms = F.array(*[F.rlike(text, F.lit("(?i)" + anchor)) for *_, anchor in FORMS], F.lit(True))
    words = F.struct(held.alias("keywords"), forms.alias("forms"))
    tried = _once(words, lambda w: F.filter(all_rules, lambda r: w["forms"][r["form"]] & F.array_contains(w["keywords"], r["keyword"]) & F.rlike(text, r["pattern"])))
    return _once(F.flatten(F.transform(tried, lambda r: _matches(text, r))), _uncovered)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score and the remaining matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, id=id_col, text=text_col).select("id", text.alias("text"), F.rlike(text, F.lit(GATE)).alias("gated"))
    # words with single blanks between and after them, behind one word that is no word of the text
    words = F.concat(F.lit("0 "), F.ltrim(F.regexp_replace(F.concat("text", F.lit(" ")), BETWEEN, " ")))
    rows = rows.select("id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), "gated", F.when(F.col("gated"), words).alias("words"), F.when(F.col("gated"), F.col("text")).alias("text"))
    places = "(?i)(?<= )(?=(?:" + "|".join(p for p, _ in PHRASES) + ") )"
    rows = rows.select("id", "n_words", "words", F.split("words", places).alias("parts"), F.when(F.col("gated"), _text_hits(F.col("text"))).alias("matches"))

    def blanks(part: Column) -> Column:
        return (F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")

    n_base = F.coalesce(F.size("parts") - 1, F.lit(0)).cast("long")
    n_base = F.when(F.col("words").isNull(), F.lit(0)).otherwise(n_base).cast("long")
    base = F.array_compact(F.array(*[F.when(F.rlike(F.col("words"), F.lit(f"(?i) {p} ")), F.lit(label)) for p, label in PHRASES]))
    base = F.coalesce(F.when(F.col("words").isNotNull(), F.array_sort(F.array_distinct(base))), F.array().cast("array<string>"))
    found = F.coalesce("matches", F.array().cast(MATCHES))
    rows = rows.select("id", "n_words", n_base.alias("n_base"), "parts", base.alias("base"), found.alias("matches"))
    best = F.aggregate("matches", F.lit(0.0), lambda s, m: F.greatest(s, m["confidence"]))
    has = F.col("n_base") > 0
    return rows.select(
        "id", "n_words", "n_base",
        F.when(has, blanks(F.col("parts")[0]) - 1).alias("first_word"),
        F.when(has, F.col("n_words") - blanks(F.element_at("parts", -1))).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(has, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        "matches",
    )

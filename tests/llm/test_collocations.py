"""Collocations against a count of everything."""

import collections
import random
import re

import pytest

from cohortry.llm import collocations
from cohortry.llm.store import importable

CLASHING = "body string, tongue string, text string, lang string, h string, n string, word string, t string, h1 string, a string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")


def brute(rows, least, top, cover=50):
    count = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        found, longer = [], collections.Counter()
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            for q in {p[:2], p[1:]} if len(p) == 3 else ():
                longer[q] = max(longer[q], a)
        for p, a in candidates.items():
            if 100 * longer[p] >= cover * a and longer[p]:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def sample(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcéD") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["x'y", "-", "\x00", "字"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    fixed = ["New York city", "of the united", "et  cetera\tand", "one two three four five"]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randint(0, len(words)), rng.choice(fixed))
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for w in words), rng.choice(["en", "en", "fr", None, ""])))
    return rows + [(None, "en"), ("", None), ("only", "rare"), ("twice twice " * 40, "rep"), ("again and again. " * 500, "long")]


@pytest.mark.parametrize("least, top", [(10, 2000), (3, 15), (2, 3), (5, 1)])
def test_equals_brute_force(spark, least, top):
    rows = sample(least)
    df = spark.createDataFrame([(t, g, *["x"] * 8) for t, g in rows], CLASHING).repartition(5)
    assert result(collocations.mine(df, "body", "tongue", least=least, top=top)) == brute(rows, least, top)


@pytest.mark.parametrize("bits", [10, 12])
def test_words_of_equal_hash_start_the_count_again(spark, bits, monkeypatch):
    rows, seen = sample(1, 150), []
    real = collocations.vocabulary
    monkeypatch.setattr(collocations, "vocabulary", lambda docs, seed, mask: (seen.append(seed), real(docs, seed, mask))[1])
    df = spark.createDataFrame(rows, "text string, lang string")
    assert result(collocations.mine(df, "text", "lang", least=3, top=20, hash_bits=bits)) == brute(rows, 3, 20)
    assert bits > 10 or len(seen) > 1


def test_small_bitmaps_and_gathered_parts_change_nothing(spark, monkeypatch):
    rows = sample(7)
    for name, value in (("FILTER_BITS", 4), ("GATHERED", 50), ("SLICE", 500)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.bitmap, "__defaults__", (4,))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert result(collocations.mine(df, "text", "lang", least=3, top=10)) == brute(rows, 3, 10)


def test_only_the_frontier_is_counted(spark, monkeypatch):
    """With few phrases wanted, many phrases of three words are never counted."""
    counted = []
    real = collocations.triples
    monkeypatch.setattr(collocations, "triples", lambda found, two: (counted.append(found.count()), real(found, two))[1])
    rows = sample(3, 1500)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert result(collocations.mine(df, "text", "lang", least=4, top=2)) == brute(rows, 4, 2)
    few = sum(counted)
    counted.clear()
    collocations.mine(df, "text", "lang", least=4, top=10**6)
    assert few < 0.7 * sum(counted)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(3 * 10**12 + 1, 3 * 10**12 + 7, 3 * 10**12 + 11), (10**13, 10**13, 10**13), (1, 10**12, 10**12)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = {r["a"]: r["s"] for r in df.select("a", collocations.ratio(F.col("a"), F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()}
    assert got == {a: 10**6 * a * a // (x * y) for a, x, y in big}


def test_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], CLASHING), "body", "tongue").count() == 0
    assert collocations.mine(spark.createDataFrame([("a b", "en")], "text string, lang string"), "text", "lang").count() == 0

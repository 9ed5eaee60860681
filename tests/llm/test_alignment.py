"""Token alignment against a per-document brute force on the libraries' own ids."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortry.llm import alignment
from cohortry.llm.store import importable, tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CLASHING = "num long, body string, id string, text string, row string, pairs string, pair string, n string, b string, best string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B))


def tokens(text, libraries):
    """(ids, bytes) of both sides, or None."""
    from cohortry.llm.wordpieces import byte_letters

    a, b = libraries
    letters = byte_letters()
    encoded = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in encoded.ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    joined = [b"".join(raw for _, raw in side) for side in (left, right)]
    return (left, right) if joined == [want, want] else None


def brute(rows, libraries):
    found, counts = [], collections.Counter()
    for i, text in rows:
        sides = tokens(text, libraries) if text else None
        if sides is None:
            found.append((i, 0, 0, 0, 0, "", []))
            continue
        ranges = []
        for side in sides:
            at, own = 0, []
            for token, raw in side:
                own.append((token, at, at + len(raw)))
                at += len(raw)
            ranges.append(own)
        b_end = {e: t for t, _, e in ranges[1]}
        links = [(t, b_end[e]) for t, _, e in ranges[0] if e in b_end]
        counts.update(links)
        groups, rest = [], list(ranges[1])
        own = []
        for t, _, e in ranges[0]:
            own.append(t)
            if e in b_end:
                k = next(k for k, x in enumerate(rest) if x[2] == e) + 1
                groups.append(",".join(map(str, own)) + "|" + ",".join(str(x[0]) for x in rest[:k]))
                own, rest = [], rest[k:]
        found.append((i, len(sides[0]), len(sides[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((*x[:6], sum(counts[p] == top[p[1]] for p in x[6]), sum(counts[p] for p in x[6])) for x in found), key=repr)


def result(df):
    columns = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghiéèß,.'") for _ in range(rng.randint(1, 9))) for _ in range(n))
    texts = [None, "", " ", "   ", "a ", " a", "a  b   c", "\n", "a\n\nb \n c\r\n\td", "it's we'll 'tis don''t", "<|endoftext|> and <s>x</s> <0x41> <unk>", "▁x and y",
             "é ß 字 😀 𝕏 ﬁ ½ Ⅷ", "\x00a\x1cb\x85c\xa0d　e​f", "12345 6.78 ١٢٣", prose(2000), prose(300).replace(" ", ""), "日本語 の テキスト" * 30, "Ελληνικά κείμενα " * 20, prose(50), prose(50) + " "]
    rows = list(enumerate(texts))
    return rows + [(3, "twice"), (3, "twice"), (None, "nobody"), *((100 + k, prose(rng.randint(0, 40))) for k in range(150))]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_equals_brute_force(spark, rows, libraries, sent, monkeypatch):
    df = spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], CLASHING).repartition(5)
    out = alignment.alignments(df, tokenizer_file(A), tokenizer_file(B), "num", "body", sent=sent)
    assert result(out) == brute(rows, libraries)


def test_segments_change_nothing(rows, libraries, monkeypatch):
    a, b = alignment.ByteLevel(tokenizer_file(A)), alignment.Pieces(tokenizer_file(B))
    monkeypatch.setattr(alignment, "SEGMENT", 30)
    for _, text in rows:
        if text:
            parts = list(alignment.segments(text))
            assert "".join(parts) == " " + text
            for side, whole in ((a, a.library.encode(" " + text, add_special_tokens=False).ids), (b, b.library.encode(text))):
                coded = [side.encode(p) for p in parts]
                assert None in coded or b"".join(coded) == alignment.np.array(whole, "<u4").tobytes()


def test_documents_equal_brute_force(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = alignment.alignments(df, tokenizer_file(A), tokenizer_file(B), "doc_id", "text")
    assert result(out) == brute(rows, libraries)


def test_overlaps_are_all_pairs_of_intersecting_ranges(libraries):
    a, b = alignment.ByteLevel(tokenizer_file(A)), alignment.Pieces(tokenizer_file(B))
    texts = [" alignment of untokenizable wörds", " second, document"]
    found = alignment.align([a.encode(t) for t in texts], [b.encode(t) for t in texts], a, b)
    (a_end, b_end), (over_a, over_b, _) = found["ends"], found["overlaps"]
    a_start, b_start = [0, *a_end[:-1]], [0, *b_end[:-1]]
    want = {(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if a_start[i] < b_end[j] and b_start[j] < a_end[i]}
    assert set(zip(over_a.tolist(), over_b.tolist())) == want and len(over_a) == len(want)


def test_no_rows(spark):
    assert alignment.alignments(spark.createDataFrame([], CLASHING), tokenizer_file(A), tokenizer_file(B), "num", "body").count() == 0


def test_counts_are_combined(spark):
    df = spark.range(2000).select(F.array(F.col("id") % 7, F.lit(3)).alias("pairs")).repartition(3)
    got = {r["pair"]: r["n"] for r in alignment.pair_counts(df).collect()}
    assert got == {k: (286 if k < 5 else 285) + (2000 if k == 3 else 0) for k in range(7)}

"""Document toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(b + sum of the weights of its features); a document is
toxic if any of its sentences is (noisy-or). Only document labels are needed: the gradient of the noisy-or reaches the sentences that
explain the label. Features are whole words and word beginnings of 4 and 5 bytes, hashed into ``BITS`` bits. The model is fitted in one
task on at most ``max_labelled`` rows and ``max_bytes`` of text (documented bounds, chosen by a hash of the id); everything else reads all
rows. The size of the weights is penalised; the penalty is chosen on rows of the sample that the fit has not seen.

Null texts count as empty. An empty text has no sentence and gets the score of a text in which no feature is known. Rows with a null id
are scored but never learnt from. Repeated ids are scored once per row. Without any labelled row all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_WORD, Rolling, mix, slices, text_bytes, word_spans
from .store import pick

BITS = 18
MAX_LABELLED = 8_000
MAX_BYTES = 1 << 26
FOLDS = 5
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True
PREFIXES = (4, 5)
LONGEST = 24
#: Penalties tried, per unit of mean loss.
PENALTIES = (1e-3, 3e-4, 1e-4, 3e-5)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, the sentence (numbered over all texts) of each, the sentences' text, and sentence end offsets within the texts.

    Sentences are the stretches between ends (. ! ? or a line feed) that hold a word; after
    ``LONGEST`` words a new one begins, so that lists and unpunctuated text weigh no more than prose.
    """
    data, offsets = text_bytes(texts)
    lowered = LOWER[data]
    starts, ends, counts = word_spans(lowered, offsets, NOT_WORD)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    stops = np.cumsum(SENTENCE_END[data])
    place = (stops[starts] if len(starts) else np.zeros(0, np.int64)) + text_of  # a new text starts a new sentence too
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text_of[1:] != text_of[:-1])
    heads = np.flatnonzero(fresh)
    if len(heads):
        fresh |= (np.arange(len(starts)) - heads[np.cumsum(fresh) - 1]) % LONGEST == 0
    sentence = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    roll = Rolling(lowered)
    mask = np.uint64((1 << BITS) - 1)
    ids, of = [roll.of(starts, ends) & mask], [sentence]
    for k in PREFIXES:
        long = ends - starts > k
        ids.append(mix(roll.of(starts[long], starts[long] + k) + np.uint64(k)) & mask)
        of.append(sentence[long])
    ids, of = np.concatenate(ids).astype(np.int64), np.concatenate(of)
    tails = np.append(heads[1:], len(starts)) - 1
    spans = np.stack([starts[heads], ends[tails]], 1) if len(heads) else np.zeros((0, 2), np.int64)
    return ids, of, text_of[heads], spans - offsets[text_of[heads]][:, None] if len(heads) else spans


def noisy_or(ids, of, text, n_texts, weights, bias) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each sentence and of each text."""
    logit = np.bincount(of, weights[ids], len(text)) + bias
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    silent = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n_texts)
    return p, -np.expm1(silent)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, each once in a sentence, their sentences, and the text of each sentence."""
    parts, sentences, rows = [], 0, 0
    for batch in slices(pa.table({"text": texts}).combine_chunks().to_batches(), "text"):
        ids, of, text, _ = features(batch.column("text"))
        pairs = np.unique(of * (1 << BITS) + ids)
        parts.append(((pairs & ((1 << BITS) - 1)).astype(np.int32), ((pairs >> BITS) + sentences).astype(np.int32), text + rows))
        sentences, rows = sentences + len(text), rows + batch.num_rows
    ids, of, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = (np.bincount(ids, minlength=1 << BITS) >= 3)[ids]
    return ids[keep], of[keep], text


def descend(bag, labels: np.ndarray, rows: np.ndarray, penalty: float, rounds: int, start=None, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the labels of the marked rows, less ``penalty`` times the sum of the weights' sizes.

    Adam on the full sample. Each weight is shrunk by the penalty at its own step length, so that most end at zero.
    """
    (ids, of, text), n = bag, rows.sum()
    weights, bias = (start[0].copy(), start[1]) if start else (np.zeros(1 << BITS), -6.0)
    counted = rows[text] / n
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for t in range(1, rounds + 1):
        p, q = noisy_or(ids, of, text, len(labels), weights, bias)
        q = np.clip(q, 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p for label 0, and p - p / q for label 1
        g = np.where(labels[text] > 0, p - p / q[text], p) * counted
        grad = np.bincount(ids, g[of], 1 << BITS)
        total = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * total, 0.99 * vb + 0.01 * total * total
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        own = step / (np.sqrt(v) + 1e-8)
        weights -= own * m
        bias -= step * mb / (np.sqrt(vb) + 1e-8)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - own * penalty, 0)
    return weights, bias


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Fitted weights and bias. The penalty is the one of ``PENALTIES`` under which two fifths of the rows are best predicted by the others."""
    bag, part = bags(texts), np.arange(len(labels)) % 5
    losses = dict.fromkeys(PENALTIES, 0.0)
    for aside in (part == 1, part == 4):
        if not (0 < labels[~aside].sum() < (~aside).sum() and 0 < labels[aside].sum()):
            continue
        start = None
        for penalty in PENALTIES:  # from the strongest on, each from where the one before ended
            start = descend(bag, labels, ~aside, penalty, rounds // 3, start)
            _, q = noisy_or(*bag, len(labels), *start)
            q = np.clip(q[aside], 1e-6, 1 - 1e-6)
            losses[penalty] -= np.where(labels[aside] > 0, np.log(q), np.log1p(-q)).sum()
    return descend(bag, labels, np.ones(len(labels), bool), min(PENALTIES, key=losses.get), rounds)


def distinct(ids: np.ndarray, of: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with a weight, once per sentence."""
    some = weights[ids] != 0
    pairs = np.unique(of[some] * (1 << BITS) + ids[some])
    return pairs & ((1 << BITS) - 1), pairs >> BITS


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_labelled`` labelled rows, and ``max_bytes`` of text, outside the held-out fold, in the order of the ids' hashes.

    Rows with a null label are left out. Of several rows with one id the smallest text counts, with the largest label.
    """
    rows = pick(labels, id=id_col, y=label_col).where("id is not null and y is not null").where(~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # ids and labels of at most max_labelled rows, which bounds the broadcast; copies of an id become one row before they meet
    sample = pick(docs, id=id_col, text=text_col).join(F.broadcast(rows), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    order = Window.orderBy(F.xxhash64("id"), "id")  # one task, of at most max_labelled rows
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(order)
    sample = sample.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("text", "y")

    def learn(batches):
        table = pa.Table.from_batches(list(batches))
        if table.num_rows == 0:
            return
        y = np.asarray(table["y"]).astype(np.float64)
        weights, bias = fit(table["text"], y) if 0 < y.sum() < len(y) else (np.zeros(1 << BITS), -30.0 if y.sum() == 0 else 30.0)
        yield pa.RecordBatch.from_pydict({"w": [weights.astype("<f4").tobytes()], "b": [float(bias)]})

    model = sample.mapInArrow(learn, "w binary, b double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), -30.0
    return np.frombuffer(model[0]["w"], "<f4"), model[0]["b"]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str, text_col: str, spans: bool = False) -> DataFrame:
    """One row per document: id, score, number of sentences, the worst sentence's score and its place in bytes (null without one).

    With ``spans`` also every sentence of probability 0.5 or more as an array of (start, end, p).
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in slices(batches, "text"):
            ids, of, text, where = features(batch.column("text"))
            ids, of = distinct(ids, of, shared.value)
            p, q = noisy_or(ids, of, text, batch.num_rows, shared.value.astype(np.float64), bias)
            counts = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            order = np.lexsort((-p, text))  # the worst sentence of a text stands first, the earliest of equals
            has = counts > 0
            worst = np.zeros(batch.num_rows, np.int64)
            worst[has] = order[first[has]]
            out = {"id": batch.column("id"), "score": q, "n_sentences": counts}
            for name, values in (("worst_score", p), ("worst_start", where[:, 0]), ("worst_end", where[:, 1])):
                values = values[worst] if len(values) else np.zeros(batch.num_rows)
                out[name] = pa.array(values, pa.float64() if name == "worst_score" else pa.int64(), mask=~has) if name == "worst_score" else pa.array(values.astype(np.int64), mask=~has)
            if spans:
                hot = p >= 0.5
                marks = np.bincount(text[hot], minlength=batch.num_rows)
                parts = pa.StructArray.from_arrays([pa.array(where[hot, 0]), pa.array(where[hot, 1]), pa.array(p[hot])], ["start", "end", "p"])
                out["sentences"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(marks)), pa.int32()), parts)
            yield pa.RecordBatch.from_pydict(out)

    schema = f"id {kind.simpleString()}, score double, n_sentences long, worst_score double, worst_start long, worst_end long"
    schema += ", sentences array<struct<start: long, end: long, p: double>>" if spans else ""
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, schema)


def kept(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in slices(batches, text_col):
            ids, of, text, _ = features(batch.column(text_col))
            ids, of = distinct(ids, of, shared.value)
            _, q = noisy_or(ids, of, text, batch.num_rows, shared.value.astype(np.float64), bias)
            yield batch.filter(pa.array(q < threshold))

    return docs.mapInArrow(run, docs.schema)

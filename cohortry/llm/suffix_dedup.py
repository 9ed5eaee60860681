"""Exact removal of repeated byte strings by prefix-free parsing.

Each text is parsed at triggers: the start of the smallest rolling hash among ``REACH`` neighbouring positions. The trigger of a string of
``least`` bytes depends on its own bytes alone, so equal strings have equal triggers wherever they stand. A phrase is a trigger with all
starts that belong to it; its context is the text that the strings at these starts cover, its core the part that all of them share.

The dictionary holds each distinct context once, the parse its occurrences. Corpus order brings equal entries together; since only equal
neighbours in that order matter, entries are ordered by rank-preserving 128-bit fingerprints in a distributed aggregation instead of by
a local suffix array. An entry of two occurrences settles all its starts; an entry whose core occurs nowhere else has none. Only what
lies between, phrases across the border of a repeat, is refined: into runs of ``RUN`` starts with the same two tests, and what is still open
into single starts. Copies therefore cost one entry, however many there are, and a text's starts are never listed one by one.

Null texts are empty. Matches never cross texts. Equal texts, whatever their ids, are each other's repeats and get the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Rolling, mix, ranges, slices, text_bytes
from .store import pick, saved

LEAST = 400
GRAM = 32
REACH = 301
RUN = 16
SLICE = 1 << 20
SEGMENT = 1 << 22
_OTHER = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def rollings(data: np.ndarray) -> tuple[Rolling, Rolling]:
    return Rolling(data), Rolling(data, _OTHER, _BASE, _BACK)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[p : p + width] for every p that fits."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def parse(data: np.ndarray, offsets: np.ndarray, roll: Rolling, least: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts that lie in one buffer: text, trigger, first and last start, all as buffer positions."""
    n = len(data)
    counts = np.maximum(0, np.diff(offsets) - least + 1)
    if not counts.sum():
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - GRAM + 1)
    keys = (mix(roll.raw(at, at + GRAM)) & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)  # of equals the leftmost
    trigger = (sliding_min(keys, reach) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    start = ranges(offsets[:-1], counts)
    own = trigger[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    return text[first], own[first], start[first], start[last]


def fingerprint(rolls, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    return [pa.array(r.of(start, end).view(np.int64)) for r in rolls]


def settle(nodes: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries of the dictionary that matter, from nodes (ids, core, u1, u2, w): (repeated (u1, u2), open or partner entries with their ids and w).

    Weights are 2 for entries known to be repeated. Counts are combined before they are shuffled, so a hot entry is never gathered.
    """
    entry = nodes.groupBy("core", "u1", "u2").agg(F.sum("w").alias("c"), F.min(F.struct(*ids)).alias("rep"))
    cores = entry.groupBy("core").agg(F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("long")).alias("single")).where("total > 1")
    some = saved(entry.join(cores, "core"), "entries")
    repeated = some.where("c > 1").select("u1", "u2")
    rest = some.where("single > 0").select("rep.*", F.least("c", F.lit(2)).cast("int").alias("w"))
    return repeated, rest


def repeated_starts(rows: DataFrame, least: int, reach: int) -> DataFrame:
    """Runs of starts of repeated strings: t1, t2, lo, hi. ``rows``: t1, t2 (keys of the text), text."""

    def phrases(batches):
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column("text"))
            if len(offsets) == 2 and offsets[1] > SEGMENT:  # one long text: in segments whose strings overlap
                cuts = [(a, min(len(data), a + SEGMENT + least - 1)) for a in range(0, len(data) - least + 1, SEGMENT)]
            else:
                cuts = [(0, len(data))]
            for a, z in cuts:
                part, inner = data[a:z], (offsets if len(cuts) == 1 else np.array([0, z - a]))
                rolls = rollings(part)
                text, trigger, lo, hi = parse(part, inner, rolls[0], least, reach)
                own = batch.select(["t1", "t2"]).take(pa.array(text))
                core = pa.array(rolls[0].of(trigger, trigger + least - reach + 1).view(np.int64))
                shift = a - inner[text]
                places = [pa.array((x + shift).astype(np.int32)) for x in (trigger, lo, hi)]
                yield pa.RecordBatch.from_arrays([*own.columns, *places, core, *fingerprint(rolls, lo, hi + least)], names=["t1", "t2", "i", "lo", "hi", "core", "u1", "u2"])

    def contexts(batches):
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column("text"))
            found = batch.column("found")
            flat, text = found.flatten(), np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            i, lo, hi, w = (flat.field(f) for f in ("i", "lo", "hi", "w"))
            start, size = lo.to_numpy() + offsets[text], hi.to_numpy() - lo.to_numpy() + least
            body = data[ranges(start, size)].tobytes()
            body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([*batch.select(["t1", "t2"]).take(pa.array(text)).columns, i, lo, w, body], names=["t1", "t2", "i", "lo", "w", "body"])

    def runs(batches):
        for batch in slices(batches, "body", SLICE):
            data, offsets = text_bytes(batch.column("body"))
            rolls = rollings(data)
            trigger, lo = (batch.column(c).to_numpy().astype(np.int64) for c in ("i", "lo"))
            hi = lo + np.diff(offsets) - least
            first, last = (trigger - hi) // RUN, (trigger - lo) // RUN
            row = np.repeat(np.arange(len(lo)), last - first + 1)
            b = ranges(first, last - first + 1)
            near, far = trigger[row] - RUN * b, trigger[row] - RUN * b - RUN + 1  # the run's starts, as far as they are the phrase's
            a, z = np.maximum(lo[row], far), np.minimum(hi[row], near)
            shift = offsets[:-1][row] - lo[row]
            # the shared part of the whole run lies inside the phrase's context; it is the same for all occurrences
            core = pa.array(rolls[0].of(np.clip(near + shift, 0, len(data)), np.clip(far + least + shift, 0, len(data))).view(np.int64))
            own = batch.select(["t1", "t2", "i", "w"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x.astype(np.int32)) for x in (a, z)), core, *fingerprint(rolls, a + shift, z + least + shift)], names=["t1", "t2", "i", "w", "lo", "hi", "core", "u1", "u2"])

    def singles(batches):
        for batch in slices(batches, "body", SLICE):
            data, offsets = text_bytes(batch.column("body"))
            rolls = rollings(data)
            base, lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("base", "lo", "hi"))
            row = np.repeat(np.arange(len(lo)), hi - lo + 1)
            p = ranges(lo, hi - lo + 1)
            at = p - base[row] + offsets[:-1][row]
            own = batch.select(["t1", "t2", "w"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p.astype(np.int32)), *fingerprint(rolls, at, at + least)], names=["t1", "t2", "w", "lo", "u1", "u2"])

    parsed = saved(rows.mapInArrow(phrases, "t1 long, t2 long, i int, lo int, hi int, core long, u1 long, u2 long"), "phrases")
    repeated, rest = settle(parsed.withColumn("w", F.lit(1)), ["t1", "t2", "i", "lo", "hi"])
    whole = parsed.join(repeated, ["u1", "u2"]).select("t1", "t2", "lo", "hi")

    # a list holds the open phrases of one text
    found = rest.groupBy("t1", "t2").agg(F.collect_list(F.struct("i", "lo", "hi", "w")).alias("found"))
    bodies = rows.join(found, ["t1", "t2"]).select("t1", "t2", "text", "found").mapInArrow(contexts, "t1 long, t2 long, i int, lo int, w int, body binary")
    bodies = saved(bodies, "contexts").dropDuplicates(["t1", "t2", "i", "lo"])  # equal texts give equal contexts
    node = saved(bodies.mapInArrow(runs, "t1 long, t2 long, i int, w int, lo int, hi int, core long, u1 long, u2 long"), "runs")
    repeated, rest = settle(node, ["t1", "t2", "i", "lo", "hi"])
    by_run = node.where("w = 1").join(repeated, ["u1", "u2"]).select("t1", "t2", "lo", "hi")

    source = bodies.select("t1", "t2", "i", F.col("lo").alias("base"), (F.col("lo") + F.octet_length("body") - least).alias("top"), "body")
    open_runs = rest.join(source, ["t1", "t2", "i"]).where("lo >= base and hi <= top").select("t1", "t2", "w", "base", "lo", "hi", "body")
    single = saved(open_runs.mapInArrow(singles, "t1 long, t2 long, w int, lo int, u1 long, u2 long"), "singles")
    again = single.groupBy("u1", "u2").agg(F.sum("w").alias("c")).where("c > 1").select("u1", "u2")
    by_start = single.where("w = 1").join(again, ["u1", "u2"]).select("t1", "t2", "lo", F.col("lo").alias("hi"))
    return whole.union(by_run).union(by_start)


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, reach: int | None = None, keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the remaining bytes."""
    reach = min(REACH, least - GRAM + 1) if reach is None else reach
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", text).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})
    starts = saved(repeated_starts(rows.select("t1", "t2", "text"), least, reach), "starts")
    # a list holds the runs of one text
    cuts = starts.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("cuts"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out = []
            for data, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                data, kept, removed, spans, end = data.as_py(), [], 0, 0, 0
                if cuts.is_valid:
                    stretch = None
                    for lo, hi in zip(*(cuts.values.field(f).to_pylist() for f in ("lo", "hi")), strict=True):
                        if stretch and lo <= stretch[1]:
                            stretch[1] = max(stretch[1], hi + least)
                            continue
                        if stretch:
                            kept.append(data[end : stretch[0]])
                            removed, spans, end = removed + stretch[1] - stretch[0], spans + 1, stretch[1]
                        stretch = [lo, hi + least]
                    kept.append(data[end : stretch[0]])
                    removed, spans, end = removed + stretch[1] - stretch[0], spans + 1, stretch[1]
                rest = b"".join([*kept, data[end:]])
                out.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())] + ([pa.array(columns[4], pa.binary())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    joined = rows.join(cuts, ["t1", "t2"], "left").select("id", "text", "cuts")
    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)

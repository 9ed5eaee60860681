"""Exact duplicate texts by an exchange of Golomb-coded fingerprints.

1. The rows are written once, bucketed by *sender*: a run of up to ``2**RUN`` rows of one input partition. Every later step that needs a
   sender's rows reads its bucket, without an exchange.
2. A sender sorts its distinct fingerprints and sends each owner (a range of the fingerprints) the gaps between them, Golomb-coded with a
   power of two as parameter. A fingerprint has ``SLACK`` bits more than the row count needs, so the gaps are short. A sender mentions a
   text once, however many copies it holds, so a text that fills a third of the table is one number per sender at its owner.
3. An owner decodes its messages and answers each with a bitmap: which of your fingerprints does another sender hold too. The sender turns
   the answers, and its own repeats, into one bit per row.
4. Only rows with a set bit are suspects, and only their texts are shuffled: they are compared byte by byte by grouping on the text itself,
   combined before the shuffle. Should two different texts have the same digest, their rows are told apart by text (``variant``).

Null texts are empty texts. All empty texts are equal. Of equal texts the row with the largest id stays; null ids are smallest; of several
rows with that id exactly one stays. Texts may be of any length. Other columns are not touched. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bucketed, pick, saved

#: Rows of a sender, and fingerprints of an owner, as powers of two.
RUN, OWNED = 20, 22
#: Bits of a fingerprint beyond those of the row count: of rows without a copy, about one in 2**SLACK is a suspect.
SLACK = 12


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after the other."""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8)).tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64))


def golomb(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values below ``universe`` as (parameter, quotients in unary, remainders) of their gaps; the parameter is a power of two."""
    mean = max(1, universe // max(1, len(values)))
    width = max(0, (mean * 7 // 10).bit_length() - 1)  # near the optimum for geometric gaps, ln 2 times the mean
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    return width, np.packbits(unary).tobytes(), pack(gaps, width)


def golomb_values(n: int, width: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The values that ``golomb`` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + unpack(rest, n, width), dtype=np.uint64)


def fingerprints(table: pa.Table, bits: int) -> np.ndarray:
    return table["h"].to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)


def exchange(stored: DataFrame, bits: int, owners: int) -> DataFrame:
    """(sender, bits): for each sender with suspects one bit per row, set where its fingerprint occurs anywhere else. ``owners`` = log2 of their number."""
    held = stored.select("sender", "r", "h")
    reach = np.uint64(bits - owners)  # bits of a fingerprint within its owner's range

    def send(table: pa.Table) -> pa.Table:
        values = np.unique(fingerprints(table, bits))
        owner = values >> reach
        cuts = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1)))
        rows = []
        for lo, hi in zip(cuts, [*cuts[1:], len(values)], strict=True):
            rows.append((int(owner[lo]), hi - lo, *golomb(values[lo:hi] - (owner[lo] << reach), 1 << int(reach))))
        columns = list(zip(*rows, strict=True))
        sender = pa.array([table["sender"][0].as_py()] * len(rows), pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([sender, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["sender", "owner", "n", "width", "unary", "rest"])

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table["n"].to_numpy()
        messages = zip(sizes, *(table[c].to_pylist() for c in ("width", "unary", "rest")), strict=True)
        values = np.concatenate([golomb_values(*m) for m in messages])
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        ends = np.cumsum(sizes)
        maps = [np.packbits(twice[e - n : e]).tobytes() if twice[e - n : e].any() else None for n, e in zip(sizes, ends, strict=True)]
        out = pa.Table.from_arrays([table["sender"], table["owner"], pa.array(maps, pa.binary())], names=["sender", "owner", "map"])
        return out.filter(pa.compute.is_valid(out["map"]))

    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], pa.schema([("sender", pa.int64()), ("bits", pa.list_(pa.int64()))]))
        values, place, counts = np.unique(fingerprints(rows, bits), return_inverse=True, return_counts=True)
        suspect, owner = counts > 1, values >> reach
        for o, bitmap in zip(answers["owner"].to_pylist(), answers["map"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(owner, [np.uint64(o), np.uint64(o + 1)])
            suspect[lo:hi] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=hi - lo).astype(bool)
        at = rows["r"].to_numpy()
        words = np.zeros(int(at.max()) // 64 + 1, np.uint64)
        hit = at[suspect[place]]
        np.bitwise_or.at(words, hit // 64, np.uint64(1) << (hit % 64).astype(np.uint64))
        some = rows.slice(0, 1 if len(hit) else 0)
        return pa.Table.from_arrays([some["sender"], pa.array([words.view(np.int64)] * some.num_rows, pa.list_(pa.int64()))], names=["sender", "bits"])

    messages = held.groupBy("sender").applyInArrow(send, "sender long, owner long, n long, width int, unary binary, rest binary")
    answers = messages.groupBy("owner").applyInArrow(answer, "sender long, owner long, map binary")
    return held.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark, "sender long, bits array<long>")


def duplicates(
    docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), slack: int = SLACK, owned: int = OWNED,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest. Texts are compared after ``normalise`` (by default as they are)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", normalise(text) if normalise else text)
    place = F.monotonically_increasing_id()
    rows = rows.withColumn("row", place).select(
        F.shiftright("row", RUN).alias("sender"), F.col("row").bitwiseAND((1 << RUN) - 1).alias("r"), "id", "text", F.xxhash64("text").alias("h"), digest(F.col("text")).alias("digest")
    )
    stored = bucketed(rows, "sender", "exact")
    n = stored.count()
    owners = max(0, (n >> owned).bit_length())
    bits = max(owners + 1, min(62, n.bit_length() + slack))
    flags = saved(exchange(stored, bits, owners), "suspects")

    flagged = stored.join(flags, "sender", "left")
    suspect = F.coalesce(F.getbit(F.get("bits", (F.col("r") / 64).cast("int")), (F.col("r") % 64).cast("int")), F.lit(0)) == 1
    texts = flagged.where(suspect).select("digest", "text").distinct()
    clashing = saved(texts.groupBy("digest").count().where("count > 1").select("digest"), "clashing")

    columns = ["id", (F.shiftleft("sender", RUN) + F.col("r")).alias("row"), "digest"]
    if clashing.isEmpty():
        members = flagged.where(suspect).select(*columns, F.lit(0).alias("variant"))
    else:
        order = F.row_number().over(Window.partitionBy("digest").orderBy("text"))
        variants = texts.join(clashing, "digest").withColumn("variant", order)
        members = flagged.where(suspect).join(variants, ["digest", "text"], "left").select(*columns, F.coalesce("variant", F.lit(0)).alias("variant"))
    classes = members.groupBy("digest", "variant").agg(
        F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    grouped = members.join(classes, ["digest", "variant"]).select("id", "keep_id", "group_size", (F.col("row") == F.col("best")).alias("kept"), "digest")
    single = flagged.where(~suspect).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return grouped.union(single)

"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary with scores.

The tokenizer merges, again and again, the neighbouring pair whose joined piece has the highest score (the leftmost of equals). A
sequence of pieces is its result exactly if every neighbouring pair of the sequence is its own result; so the last piece of each prefix
decides how the prefix goes on. The transducer reads one character at a time. Its state is what the next characters can still change:
for each position within the longest suffix that a piece can begin with, the piece that ends there and the tokens since. An edge is
annotated with the change of the emitted-token count. States and edges are compiled when first met and shared between equal suffixes.

A boundary between two characters that stand side by side in no piece is *hard*: the state after it does not depend on what came before.
The map of a chunk is therefore (its head up to the first hard boundary, the count of the closed middle, its tail after the last one),
and two maps compose by running the transducer over tail + head. Composition is associative, so the chunks of a text are scanned in
parallel and composed in any grouping.

Null texts count as empty: 0 bytes, 0 tokens. Rows with equal or null ids are counted each by itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import pick

SPACE = "▁"
CHUNK = 1 << 15
#: Edges that read a whole closed word at once; the table is emptied when it is full.
WORDS = 500_000
STATES = 300_000


class Transducer:
    """Compiled counts of one vocabulary: ``pieces`` maps each mergeable piece to its score; other characters cost their UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.begin = {p[:k] for p in pieces for k in range(1, len(p))}  # what a piece can still grow from
        inner = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.inner = inner
        self.longest = max(map(len, pieces), default=1)
        self.joins: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.reset()
        self.words: dict[str, int] = {}
        # a word break is safe to cut at if no piece holds a character other than a space before a space
        self.cut_at_space = not any(p[1] == SPACE and p[0] != SPACE for p in inner)

    def reset(self) -> None:
        self.nodes: dict[tuple, dict] = {}
        self.start = self.state(("", ((None, 0),)))

    def state(self, key: tuple) -> dict:
        """A state is the table of its compiled edges, character to (state, change of the count); under '' it keeps its key."""
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = {"": key}
        return node

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, on a short text."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.pieces.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return self.whole[piece]

    def fits(self, left: str | None, right: str) -> bool:
        if left is None or left[-1] + right[0] not in self.inner:
            return True
        key = (left, right)
        if key not in self.joins:
            if len(self.joins) > STATES:
                self.joins.clear()
            self.joins[key] = self.merged(left + right) == [left, right]
        return self.joins[key]

    def cost(self, piece: str) -> int:
        return 1 if piece in self.pieces else len(piece.encode())

    def step(self, node: dict, char: str) -> tuple[dict, int]:
        """Compile an edge: next state and change of the count."""
        suffix, ends = node[""]
        text = suffix + char
        # ends[k]: the piece that ends before text[k], and the count there relative to the state's own count
        piece, count = char, ends[-1][1]
        for size in range(min(len(text), self.longest), 1, -1):
            longer, end = text[-size:], ends[len(text) - size]
            if longer in self.pieces and self.stands(longer) and self.fits(end[0], longer):
                piece, count = longer, end[1]
                break
        now = count + self.cost(piece)
        keep = next((k for k in range(len(text)) if text[k:] in self.begin), len(text))
        # counts are relative to the new one; only ends before which a growing piece may begin still matter
        kept = tuple((ends[k][0], ends[k][1] - now) if text[k:] in self.begin else None for k in range(keep, len(text)))
        return self.state((text[keep:], (*kept, (piece, 0)))), now

    def run(self, text: str) -> int:
        """Tokens of a text that begins at a hard boundary."""
        if len(self.nodes) > STATES:
            self.reset()
        node, total = self.start, 0
        for char in text:
            edge = node.get(char)
            if edge is None:
                edge = node[char] = self.step(node, char)
            node, n = edge
            total += n
        return total

    def hard(self, text: str, first: int, stop: int, back: bool = False) -> int:
        """The first (or last) hard boundary in first … stop, or −1."""
        order = range(stop, first - 1, -1) if back else range(first, stop + 1)
        return next((k for k in order if text[k - 1 : k + 1] not in self.inner), -1)

    def closed(self, text: str) -> int:
        """Tokens of a text between two hard boundaries, word by word where that is safe."""
        if not self.cut_at_space:
            return self.run(text)
        words, total = self.words, 0
        for word in re.split(f"(?<=[^{SPACE}])(?={SPACE})", text) if SPACE * 2 in text else text.replace(SPACE, f" {SPACE}").split(" "):
            n = words.get(word)
            if n is None:
                if len(words) >= WORDS:
                    words.clear()
                n = self.run(word)
                if len(word) < 40:
                    words[word] = n
            total += n
        return total

    def map(self, text: str) -> tuple[str, int | None, str]:
        """(head, count of the middle, tail); without a hard boundary (text, None, '')."""
        first = self.hard(text, 1, len(text) - 1)
        if first < 0:
            return text, None, ""
        last = self.hard(text, first, len(text) - 1, back=True)
        return text[:first], self.closed(text[first:last]), text[last:]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        if a[1] is None and b[1] is None:
            return self.map(a[0] + b[0])
        if a[1] is None:
            joined = self.map(a[0] + b[0])
            return (joined[0], b[1], b[2]) if joined[1] is None else (joined[0], joined[1] + self.run(joined[2]) + b[1], b[2])
        if b[1] is None:
            joined = self.map(a[2] + b[0])
            return (a[0], a[1], joined[0]) if joined[1] is None else (a[0], a[1] + self.run(joined[0]) + joined[1], joined[2])
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def total(self, m: tuple[str, int | None, str]) -> int:
        return self.run(m[0]) + (m[1] or 0) + self.run(m[2])


@lru_cache(maxsize=2)
def from_sentencepiece(path: str) -> tuple[Transducer, object]:
    """The transducer of a byte-fallback BPE model file, and the model's own text normalizer."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in ids}), model


def count_tokens(docs: DataFrame, path: str, id_col: str, text_col: str, chunk: int = CHUNK, spread: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens. ``spread`` deals the chunks of long texts out over all tasks first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.char_length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(length / chunk) - 1, F.lit(0)))
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", text).withColumn("row", F.monotonically_increasing_id())
    # a chunk also says whether it is the whole text; whole texts need no composition
    parts = rows.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(
        F.when(length <= chunk, F.array("text")).otherwise(F.transform(starts, lambda i: F.substring(F.col("text"), (i * chunk + 1).cast("int"), F.lit(chunk))))
    ).alias("k", "part"), (length > chunk).alias("more"))
    if spread:
        parts = parts.repartition("row", "k")

    def maps(batches):
        machine, _ = from_sentencepiece(path)
        for batch in batches:
            out = []
            for part, k, more in zip(*(batch.column(c).to_pylist() for c in ("part", "k", "more")), strict=True):
                part = part.replace(" ", SPACE)
                part = SPACE + part if k == 0 and part else part  # the model puts a space before the text
                out.append(machine.map(part) if more else ("", machine.closed(part), ""))
            head, middle, tail = zip(*out, strict=True) if out else ((), (), ())
            own = [pa.array(head, pa.string()), pa.array(middle, pa.int64()), pa.array(tail, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.select(["row", "id", "n_bytes", "k"]).columns, *own], names=["row", "id", "n_bytes", "k", "head", "middle", "tail"])

    kind = docs.schema[id_col].dataType.simpleString()
    mapped = parts.mapInArrow(maps, f"row long, id {kind}, n_bytes long, k int, head string, middle long, tail string")
    grouped = mapped.groupBy("row").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("k", "head", "middle", "tail"))).alias("maps"))

    @F.pandas_udf("long")
    def composed(maps: pd.Series) -> pd.Series:
        machine, _ = from_sentencepiece(path)

        def scan(chunks) -> int:
            level = [(c["head"], c["middle"], c["tail"]) for c in chunks]
            while len(level) > 1:  # neighbours in pairs, as a prefix scan's up-sweep
                level = [machine.compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            return machine.total(level[0])

        return maps.map(scan)

    single = (F.size("maps") == 1) & F.col("maps")[0]["middle"].isNotNull() & (F.col("maps")[0]["head"] == "") & (F.col("maps")[0]["tail"] == "")
    done, rest = grouped.select("id", "n_bytes", "maps", single.alias("single")), "single"
    return done.select("id", "n_bytes", F.when(F.col(rest), F.col("maps")[0]["middle"]).otherwise(composed("maps")).alias("n_tokens"))

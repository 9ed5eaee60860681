"""Token ids of word-end byte-pair vocabularies, word by word, with a bounded table of known words.

The vocabulary's normalizer and word pattern never look across a blank or line feed, so a text is the sequence of its chunks between them.
Known chunks are looked up. Unknown plain ones (letters of Latin scripts, digits, ASCII signs) go to a rank-based merger with the same
ranks, in which a zero byte marks the word end; all others, and those that hold an added token of the vocabulary, go to the tokenizer
library itself. Both give the library's ids.
"""

from __future__ import annotations

import json
import os
import struct
from functools import lru_cache

import regex

KNOWN = 700_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PLAIN = regex.compile("[!-~¡-¬®-ɏ]*")
END = "</w>"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordPieces:
    """``encode(text)`` gives the packed little-endian 32-bit ids of a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        described = json.load(open(path, encoding="utf-8"))
        model, added = described["model"], [t["content"] for t in described.get("added_tokens") or []]
        # in either case: the library tells which ones count
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)", regex.IGNORECASE)
        self.spaced = [t for t in added if " " in t or "\n" in t]
        letters = byte_letters()

        def as_bytes(piece: str) -> bytes:
            end = piece.endswith(END) and piece != END
            return bytes(letters[c] for c in (piece[: -len(END)] if end else piece)) + (b"\0" if end else b"")

        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # the bytes themselves come first, then a byte with its word end, then the merges in their order
        order = [p for p in vocab if len(p.removesuffix(END)) == 1 and p != END]
        order.sort(key=lambda p: p.endswith(END))
        ranks: dict[bytes, int] = {b"\0": len(order) + len(merges), b"\n": len(order) + len(merges) + 1}
        ids: dict[int, int] = {}
        for piece in [*order, *(a + b for a, b in merges)]:
            raw = as_bytes(piece)
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids[len(ids)] = vocab[piece]
        self.stop = ranks[b"\n"]
        for b in range(256):
            ranks.setdefault(bytes([b]), self.stop + 1 + b)
        self.ids = {r: struct.pack("<I", i) for r, i in ids.items()}
        self.merger = tiktoken.Encoding("words", pat_str=r"\n|[^\x00\n]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(r"\n|" + SPLIT)

    def learn(self, chunks: list[str]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if PLAIN.fullmatch(c) and not self.added.search(c) else other).append(c)
        if plain:
            words = self.words.findall("\n".join(plain).lower())
            coded = self.merger.encode_ordinary("".join([w if w == "\n" else w + "\0" for w in words]))
            own, table, at = [], self.ids, 0
            for r in coded:
                if r == self.stop:
                    self.known[plain[at]] = b"".join(own)
                    own, at = [], at + 1
                else:
                    own.append(table[r])
            self.known[plain[at]] = b"".join(own)
        if other:
            for c, e in zip(other, self.library.encode_batch(other, add_special_tokens=False), strict=True):
                self.known[c] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, text: str) -> bytes:
        if self.spaced and self.added.search(text):  # an added token may span chunks
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        chunks = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > KNOWN:
            known.clear()
            known[""] = b""
        fresh = {c for c in chunks if c not in known}
        self.learn(list(fresh))
        out = b"".join([known[c] for c in chunks])
        for c in fresh:
            if len(c) > 40:  # long chunks hardly come again
                del known[c]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordPieces:
    return WordPieces(path)

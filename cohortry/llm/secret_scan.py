"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

Patterns (their spans always stand): assignments to secret-like names, access-key ids, long hexadecimal strings.

Novelty: every unbroken run of 16 or more token characters close behind a sensitive word is a candidate. zstandard, primed with a dictionary
of common identifiers and with the code around the candidate, compresses that code alone and with the candidate behind it; the difference
is the candidate's marginal cost. Words, paths and identifiers, or strings that the text repeats, cost little; a secret costs nearly its
own information. Candidates whose marginal bytes per character reach ``novelty`` are reported as kind ``novel``. Those of more than
``WINDOW`` characters are measured in windows of equal length; one that reaches it is enough, and the whole run is reported.

A null text is empty and has no spans; rows with equal or null ids are scanned each by itself. Long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .store import pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without one of these has no assignment.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(
    r"(?:passw(?:or)?d|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|client[_-]?id|signature|webhook|cookie|session[_-]?id|jwt|salt|pwd)",
    re.IGNORECASE | re.ASCII,
)
#: Every sensitive word holds one of these.
STEMS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authorization", "client", "signature", "webhook", "cookie", "session", "jwt", "salt", "pwd")
#: Start of a candidate, and all of it from there.
START = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
SHORTEST = 16
WINDOW = 512
#: Characters between a sensitive word's end and the start of its candidates.
REACH = 48
AROUND = 256
NOVELTY = 0.62
#: Identifiers that code repeats; primes the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key credential authorization bearer client_id client_secret signature session_id "
    "username user_id email address config settings environment default example localhost database connection string integer boolean float double return function "
    "class def import from include const static public private protected void null none true false self this new delete get set put post update insert select where "
    "value values key keys name names index count length size buffer offset start stop begin end first last next previous parent child node list array dict map "
    "request response header headers content type application json text html utf8 base64 encode decode encrypt decrypt hash sha256 md5 hmac random generate "
    "http https www com org net localhost path file files directory folder read write open close create destroy init setup teardown test tests main args kwargs "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, sorted by start, then in the order assign, access, hex."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Novelty:
    """Marginal compressed bytes of a string against its surroundings."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False)

    def size(self, data: bytes) -> int:
        return len(self.compressor.compress(data))

    def cost(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes per character."""
        around = f"{after}\n{before}".encode(errors="replace")
        return (self.size(around + candidate.encode()) - self.size(around)) / len(candidate)

    def novel(self, text: str, start: int, end: int, least: float) -> bool:
        """Whether the run, or one of its windows of at most ``WINDOW`` characters, reaches the cost."""
        n = -(-(end - start) // WINDOW)
        cuts = [start + (end - start) * k // n for k in range(n + 1)]
        return any(self.cost(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) >= least for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def spans(self, text: str, least: float) -> list[tuple[int, int, str]]:
        found, at, low = [], 0, text.lower()
        if not any(s in low for s in STEMS):
            return found
        for word in SENSITIVE.finditer(text):
            at = max(at, word.end())
            while start := START.search(text, at, word.end() + REACH + SHORTEST):
                begin, at = start.start(), RUN.match(text, start.start()).end()
                if self.novel(text, begin, at, least):
                    found.append((begin, at, 3))
        return found


KINDS = ("assign", "access", "hex", "novel")


def joined(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def scan(docs: DataFrame, id_col: str, text_col: str, novelty: float = NOVELTY) -> DataFrame:
    """One row per document: id and its spans (kind, start, end; code points) in order of start, then kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"

    def run(batches):
        measure = Novelty()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                new = measure.spans(text, novelty)
                counts = [sum(k == kind for _, _, k in base) for kind in range(3)]
                every = sorted([*base, *new], key=lambda s: (s[0], s[2])) if new else base
                out.append((*counts, len(new), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(run, schema)

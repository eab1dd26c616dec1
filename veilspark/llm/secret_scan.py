"""Secret scanning: Aho-Corasick keyword prefilter, anchored regular
expressions only at keyword hits, checksum validation of what they match.

One automaton holds the keywords of every kind. A text is scanned once; at each
hit the kind's expression is tried at that position only. Kinds whose tokens
embed a checksum are reported only if it holds. The kind `hex` has no keyword; its
prefilter looks at every HEX_LEAST-th character, one of which lies in any run that
is long enough, and the expression is tried around those that are digits only.

Kinds, in the order used for ties: assign, access, hex (the base kinds), then
github and npm (CRC-32 in base 62), slip (base58check private keys, `xprv`
prefix, double SHA-256) and jwt (a header that decodes to JSON with "alg").

Offsets are code points, end exclusive. Null and empty texts have no spans; ties
are in the order of the kinds; repeated rows are scanned again; a null id stays; a
very long text is scanned in one pass; only doc_id and text are read, and redaction
leaves columns of any other name as they are.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "slip", "jwt")

#: Keywords of each kind, lower case.
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "slip": ["xprv"],
    "jwt": ["eyj"],
}
ANCHORED = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "slip": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
HEX_LEAST = 24
HEX, HEX_DIGITS = re.compile(r"[0-9a-f]*"), frozenset("0123456789abcdef")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """CRC-32 of an ASCII string as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def base58check(token: str) -> bool:
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << (82 * 8) else b""
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _jwt_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(header, dict) and "alg" in header


VALID = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: crc_base62(m[1]) == m[2],
    "npm": lambda m: crc_base62(m[1]) == m[2],
    "slip": lambda m: base58check(m[0]),
    "jwt": lambda m: _jwt_header(m[1]),
}


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def _lower_same_length(text: str) -> str:
    """Lower case, one code point for one; only A-Z must be folded."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    return low


def hex_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of at least HEX_LEAST hexadecimal digits."""
    runs, done = [], 0
    for k, c in enumerate(text[HEX_LEAST - 1 :: HEX_LEAST], 1):
        at = k * HEX_LEAST - 1
        if c in HEX_DIGITS and at >= done:
            start = at
            while start > done and text[start - 1] in HEX_DIGITS:
                start -= 1
            done = HEX.match(text, at).end()
            if done - start >= HEX_LEAST:
                runs.append((start, done))
    return runs


def scan(text: str, automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, leftmost without overlap per kind."""
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in automaton.iter(_lower_same_length(text)):
        hits.setdefault(kind, []).append(last - length + 1)
    found = []
    for kind, starts in hits.items():
        at = 0
        for start in sorted(starts):
            if start >= at and (m := ANCHORED[kind].match(text, start)):
                at = m.end()
                if VALID[kind](m):
                    found.append((start, kind, at))
    found.extend((start, "hex", end) for start, end in hex_runs(text))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                rows.append([{"kind": k, "start": s, "end": e} for s, k, e in scan(text.as_py() or "", automaton)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret span replaced in the text; all rows and columns
    stay, n_chars follows the new text where docs has it."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for part in (part for batch in batches for part in slices(batch, "text")):
            out = []
            for value in part.column("text"):
                text = value.as_py()
                at, parts = 0, []
                for start, _, end in scan(text or "", automaton):
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            columns = [pa.array(out, pa.string()) if c == "text" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    changed = docs.mapInArrow(lambda it: given_back(run(it)), docs.schema)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else changed


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return secret_spans(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> str:
    """The base spans by plain expressions over the whole text."""
    text, found = text or "", []
    for m in ANCHORED["assign"].finditer(text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in sorted(found))

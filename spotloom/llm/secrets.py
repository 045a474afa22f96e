"""Secrets in text: a keyword automaton finds where to look, anchored patterns decide, checksums confirm.

One Aho-Corasick automaton passes once over the lower-cased text. Only where a keyword begins is a pattern tried, and
only at that place. Kinds without a keyword of their own (hex strings) have their first four characters as keywords.
Tokens that carry a checksum (40-character "gh?_" and "npm_" tokens: the CRC-32 of the body in base 62) count only if
it is right; those of "eyJ" form must hold a JSON header with "alg". A private key reaches from its header to the line
that ends it; where another key begins before that or none comes, over the armour and base64 lines that follow.

Defined cases: null and empty texts have no spans; texts are searched whole, whatever their length; offsets count code
points, ends are exclusive. Matches of one kind do not overlap and are the leftmost; different kinds may overlap.
Repeated rows are searched one by one; an empty table has no rows. Other columns of the input are not read, also those
whose names differ from the wanted only in case.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from spotloom.llm import frames

#: Kinds in the order in which spans at one place are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {i: i + 32 for i in range(65, 91)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = re.compile(
    r"""-----BEGIN\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?-----
    (?: (?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+ -----END\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?-*+   # up to the line that ends it, or
    | (?: (?:\s|\\[nrt]|["'+,>\#*|])*+                                                                         # over the lines that can be of a key
        (?: (?:Proc-Type|DEK-Info|Key-Info|Version|Comment|Hash|Charset|MessageID):(?:[^\r\n\\]|\\[^nr])*+
          | [A-Za-z0-9+/]{16,}+={0,2}
          | [A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n"']|\\[nr]|\Z)) ) )*+ )""",
    re.X,
)


def base62_crc(body: str) -> str:
    """The CRC-32 of body as six base-62 digits."""
    x, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        x, r = divmod(x, 62)
        out = _DIGITS[r] + out
    return out


def _crc_ends(token: str) -> bool:
    body = token.partition("_")[2]
    return base62_crc(body[:-6]) == body[-6:]


def _jwt_header(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


#: Kind: pattern, and what a match must pass to count.
RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "hex": (_HEX, lambda m: len(m[0]) >= 24),
    "github": (_GITHUB, lambda m: _crc_ends(m[0])),
    "npm": (_NPM, lambda m: _crc_ends(m[0])),
    "jwt": (_JWT, lambda m: _jwt_header(m[0])),
    "pem": (_PEM, lambda m: True),
}


@cache
def automaton() -> ahocorasick.Automaton:
    keys: dict[str, list[str]] = {}
    for kind, words in (
        ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key")),
        ("access", ("akia",)),
        ("hex", map("".join, itertools.product("0123456789abcdef", repeat=4))),
        ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
        ("npm", ("npm_",)),
        ("jwt", ("eyj",)),
        ("pem", ("-----begin ",)),
    ):
        for w in words:
            keys.setdefault(w, []).append(kind)
    a = ahocorasick.Automaton()
    for w, kinds in keys.items():
        a.add_word(w, (len(w), tuple(kinds)))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in a text, by start, then by kind as in KINDS."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    done = dict.fromkeys(KINDS, 0)
    starts: dict[str, list[int]] = {}
    for end, (n, kinds) in automaton().iter(low):
        for kind in kinds:
            starts.setdefault(kind, []).append(end - n + 1)
    out = []
    for kind, places in starts.items():
        pattern, holds = RULES[kind]
        for at in sorted(places):
            if at >= done[kind] and (m := pattern.match(text, at)):
                done[kind] = m.end()
                if holds(m):
                    out.append((KINDS.index(kind), at, m.end()))
    return [(KINDS[k], a, b) for k, a, b in sorted(out, key=lambda s: (s[1], s[0]))]


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[redacted]") -> str | None:
    """The text with each span, or run of overlapping spans, replaced by mark."""
    if not text or not spans:
        return text
    out, at, upto = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= upto:
            out += [text[at:a], mark] if a >= at else []
        upto = max(upto, b)
        at = upto
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, spans, an array of (kind, start, end), and redacted, the text without them."""
    df = frames.pick(docs, id=id_col, text=text_col)
    kind = df.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [find(t) for t in texts]
        spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], _SPANS)
        clean = batch.column(1) if not any(found) else pa.array(map(redact, texts, found), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), spans, clean], ["id", "spans", "redacted"])

    return frames.map_batches(df, one, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>, redacted string").withColumnRenamed("id", id_col)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(said(spans).encode()).hexdigest()


def redact_columns(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with each text that holds secrets replaced by its redacted form, and its length set to match.

    All other rows and columns pass unchanged, in a single pass without a shuffle.
    """
    schema = docs.schema
    at, size = (frames.place(docs.columns, c) for c in (text_col, length_col))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = [find(t) for t in texts]
        if not any(found):
            return batch
        clean = list(map(redact, texts, found))
        lengths = batch.column(size).to_pylist()
        columns = list(batch.columns)
        columns[at] = pa.array(clean, batch.column(at).type)
        columns[size] = pa.array([len(c) if f else n for c, f, n in zip(clean, found, lengths, strict=True)], batch.column(size).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return frames.map_batches(docs, one, schema)

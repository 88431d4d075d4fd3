"""Secrets in texts: patterns, and candidates that are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbspark.llm.blocks import blocks, ids_of, rows_of

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token", "pem", "key", "hidden")
_ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run that is long enough is found whole, as by a pattern with + and a look at the length after it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_PEM_END = re.compile(r"-----END ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: The shortest base secret, an assignment, has 14 bytes: 19 base64 or 28 hex characters. Each alphabet has its own
#: runs, so that neither cuts the other's.
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{19,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{19,}={0,2}"))
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{28,}")
_LINE = re.compile(r"(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)={0,2}")
#: Characters that a line of wrapped base64 has at least, but for the last.
_WIDTH = 16
#: What a text must hold for a kind to be looked for at all (RE2, over a whole block at once).
_HINTS = (
    r"(?i)password|passwd|secret|token|api_?key", "AKIA", "[0-9a-f]{32}", r"eyJ[A-Za-z0-9_-]+\.eyJ",
    "PRIVATE KEY-----", "[A-Za-z0-9+/_-]{19}", "[0-9A-Fa-f]{28}", r"[A-Za-z0-9+/_-]{16}[ \t\r]*\n",
)
#: Bytes of a signature by the algorithm that a token's header names.
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, leftmost and without overlap in each kind; too short matches are passed over."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, with or without its padding; None if it isn't one."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; None if lengths don't fit."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def private_der(data: bytes) -> bool:
    """A private key's nested lengths: PKCS#1, SEC 1, PKCS#8 plain or encrypted."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(data, top[0][1], top[0][2])
    if not items:
        return False
    tags = [t for t, _, _ in items]
    first = data[items[0][1] : items[0][2]]
    if tags[:2] == [0x02, 0x04]:  # SEC 1: version 1, the key
        return first == b"\x01" and items[1][2] - items[1][1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, the key
        inner = der_items(data, items[1][1], items[1][2])
        return first in (b"\x00", b"\x01") and bool(inner) and inner[0][0] == 0x06
    if len(tags) == 9 and set(tags) == {0x02}:  # PKCS#1: version and eight numbers
        return first == b"\x00" and items[1][2] - items[1][1] >= 32
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        inner = der_items(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06 and items[1][2] - items[1][1] >= 16
    return False


def private_openssh(data: bytes) -> bool:
    """An openssh-key-v1 container whose length-prefixed parts fill it exactly."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def part() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (part() and part() and part()) or at + 4 > len(data):  # cipher, kdf, its options
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(part() for _ in range(keys + 1)) and at == len(data)


def signed_token(text: str) -> bool:
    """Three base64url parts: a JSON header with an algorithm, a JSON payload, a signature of its length."""
    parts = text.split(".")
    if len(parts) != 3 or "=" in text:
        return False
    raw = [_decoded(p) if p else b"" for p in parts]
    if None in raw:
        return False
    try:
        head, payload = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(payload, dict) or not isinstance(head.get("alg"), str):
        return False
    need = _SIGNATURES.get(head["alg"])
    if need is not None:
        return len(raw[2]) == need
    return len(raw[2]) >= 128 if head["alg"][:2] in ("RS", "PS") else head["alg"] != "none" and len(raw[2]) >= 32


def _hidden_text(data: bytes, depth: int) -> bool:
    """Encoded printable UTF-8 text that itself holds a base secret, or one encoded again, ``depth`` times at most."""
    if any(b < 32 and b not in (9, 10, 13) or b == 127 for b in data):
        return False
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return any(kind != "hex" for _, _, kind in base_spans(text)) or depth > 0 and bool(confirmed_spans(text, depth - 1))


def _tokens(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if ".eyJ" not in run[0]:
            continue
        at, parts = run.start(), run[0].split(".")
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        for i in range(len(parts) - 2):
            if parts[i + 1].startswith("eyJ"):
                head = parts[i][max(0, parts[i].find("eyJ")) :]
                if signed_token(".".join([head, parts[i + 1], parts[i + 2]])):
                    yield starts[i] + len(parts[i]) - len(head), starts[i + 2] + len(parts[i + 2]), "token"


def _pem(text: str) -> Iterator[Span]:
    """Each END belongs to the nearest BEGIN of its label before it, so a label's blocks never share a character."""
    opened, pairs = {}, []
    marks = [(m.start(), m.end(), m[1], True) for m in _PEM.finditer(text)]
    if not marks:
        return
    marks += [(m.start(), m.end(), m[1], False) for m in _PEM_END.finditer(text)]
    for start, stop, label, begins in sorted(marks):
        if begins:
            opened[label] = start, stop
        elif label in opened:
            pairs.append((*opened.pop(label), start, stop))
    past = 0
    for start, body_at, end, stop in sorted(pairs):
        if start < past:
            continue
        lines = [x for x in re.split(r"\s+|\\n", text[body_at:end].strip()) if x]
        locked = "Proc-Type:" in lines
        body = "".join(x for x in lines if re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", x)) if not locked else ""
        data = _decoded(body) if body else None
        if locked or data and (private_der(data) or private_openssh(data)):
            past = stop
            yield start, past, "pem"


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined) of neighbouring lines of base64 that have one width, with and without a shorter
    last line."""
    lines, at = [], 0
    for line in text.split("\n"):
        body = line.strip(" \t\r")
        start = at + line.find(body)
        lines.append((start, start + len(body), body if _LINE.fullmatch(body) else ""))
        at += len(line) + 1
    i = 0
    while i < len(lines):
        width, j = len(lines[i][2]), i + 1
        if width >= _WIDTH:
            while j < len(lines) and len(lines[j][2]) == width:
                j += 1
            full = "".join(x[2] for x in lines[i:j])
            if j < len(lines) and 0 < len(lines[j][2]) < width:
                yield lines[i][0], lines[j][1], full + lines[j][2]
            if j > i + 1:
                yield lines[i][0], lines[j - 1][1], full
        i = j


def _from_hex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def confirmed_spans(text: str, depth: int = 2) -> list[Span]:
    """Candidates that decode to what they claim to be: signed tokens, keys in PEM, base64 (of either alphabet,
    also wrapped over lines of one width) or hex, and encoded text that holds a secret. What lies inside a
    reported PEM block or a reported longer candidate is not reported again. Decoded text is searched for encoded text
    in turn, ``depth`` times."""
    found = [*_tokens(text), *_pem(text)]
    blocks_ = sorted((a, b) for a, b, kind in found if kind == "pem")
    runs = {(m.start(), m.end(), m[0]) for pattern in _BASE64 for m in pattern.finditer(text)}
    candidates = [(*c, _decoded) for c in runs.union(_wrapped(text))]
    candidates += [(m.start(), m.end(), m[0], _from_hex) for m in _HEX_ANY.finditer(text)]
    past = 0
    for start, end, body, decode in sorted(candidates, key=lambda c: (c[0], -c[1])):
        data = decode(body) if end > past else None
        block = bisect_right(blocks_, (start, len(text) + 1)) - 1  # blocks don't overlap
        if not data or block >= 0 and start < blocks_[block][1]:
            continue
        kind = "key" if private_der(data) or private_openssh(data) else "hidden" if _hidden_text(data, depth) else None
        if kind:
            found.append((start, end, kind))
            past = end
    return found


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed; starts and ends in code points."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs``.

    ``spans`` holds the base patterns' spans and those that structural confirmation adds. NULL and empty
    texts have none. Repeated rows and NULL ids stay rows of their own; an empty table gives no rows. A
    text is scanned whole, in time linear in its length; texts without any hint of a kind are passed over.
    """

    def scan(batches):
        none = hashlib.sha256(b"").hexdigest()
        for part, texts in blocks(batches):
            hint = pc.match_substring_regex(texts, _HINTS[0])
            for h in _HINTS[1:]:
                hint = pc.or_(hint, pc.match_substring_regex(texts, h))
            n = {k: [0] * len(texts) for k in KINDS[:3]}
            digest, spans = [none] * len(texts), [""] * len(texts)
            for i in pc.indices_nonzero(hint).to_pylist():
                text = texts[i].as_py()
                base = base_spans(text)
                for _, _, kind in base:
                    n[kind][i] += 1
                digest[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                spans[i] = listed(base + confirmed_spans(text))
            arrays = [ids_of(part), *(pa.array(v, pa.int64()) for v in n.values()), pa.array(digest), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows_of(docs, id_col, text_col).mapInArrow(scan, schema)

"""Secret scans with structural confirmation.

Patterns find candidates (assignments, access keys, hex runs); encoded candidates are reported
only if what they decode to has the inner structure of a secret: a private key whose nested
lengths add up (DER: PKCS#1, PKCS#8, SEC 1), an OpenSSH key container, or a signed token whose
header names its algorithm. Base64 (either alphabet, on one line or wrapped) and hex (either
case) are tried wherever such a structure can begin, whatever stands before or after it; of
structures that overlap, the one that begins first is reported. An encrypted PEM block has no
structure inside: its headers and its whole blocks are what confirms it.

Null texts are empty and have no findings; repeated rows and null ids keep a row each; texts
are scanned whole. All patterns run in time linear in the text, but for short bounded runs.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed by the data contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,12} ){0,3})PRIVATE KEY-----((?:\s*[A-Za-z-]+:[^\n\\]*(?:\n|\\n))*)([A-Za-z0-9+/=\s\\]*)-----END \1PRIVATE KEY-----")
_TOKEN_START = re.compile(r"eyJ")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
#: Where a DER sequence that is short or whose length takes one to four bytes can begin, and the magic of OpenSSH keys.
_BASE64_START = re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{6})|b3BlbnNzaC1rZXktdjE")
_BASE64_RUN = re.compile(r"(?:[A-Za-z0-9+/_-]|\r?\n(?=[A-Za-z0-9+/_-]))*")
_HEX_START = re.compile(r"30(?=(?:[0-7][0-9a-fA-F]|8[1-4](?:[0-9a-fA-F]{2}){1,4}?)(?:0201|30))|6f70656e7373682d6b65792d763100", re.IGNORECASE)
_HEX_RUN = re.compile(r"(?:[0-9a-fA-F]{2})*")


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag and content bounds of the element at ``at``, if its length fits."""
    if end - at < 2:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or end - at < n:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """Elements that fill the bounds exactly, or None."""
    out = []
    while at < end and len(out) < most:
        item = _der(data, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out if at == end else None


def private_der(data: bytes) -> tuple[str, int] | None:
    """The kind of private key that ``data`` begins with as DER, and its bytes: every nested length must add up."""
    top = _der(data, 0, len(data))
    if top is None or top[0] != 0x30:
        return None
    parts = _children(data, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, *_ in parts]
    whole = lambda p: data[p[1] : p[2]]
    kind = None
    if tags[0] == 0x02 and len(whole(parts[0])) == 1:
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            kind = "pkcs1"
        elif len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and (inner := _children(data, *parts[1][1:])) and inner[0][0] == 0x06:
            kind = "pkcs8"
        elif len(tags) >= 2 and tags[1] == 0x04 and whole(parts[0]) == b"\1" and 16 <= len(whole(parts[1])) <= 66:
            kind = "sec1"
        elif len(tags) == 6 and set(tags) == {0x02}:
            kind = "dsa"
    elif tags == [0x30, 0x04] and (inner := _children(data, *parts[0][1:])) and [t for t, *_ in inner] == [0x06, 0x30]:
        kind = "pkcs8e"
    return (kind, top[2]) if kind else None


def openssh_private(data: bytes) -> tuple[str, int] | None:
    """An OpenSSH container and its bytes: its magic, then length-prefixed fields that fit (cipher, kdf, its options, the number of keys, public keys, the private part)."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def field(at: int) -> int | None:
        size = int.from_bytes(data[at : at + 4], "big")
        return at + 4 + size if at + 4 + size <= len(data) else None

    for k in range(3):
        end = field(at)
        if end is None or not k and end == at + 4:
            return None
        at = end
    if len(data) - at < 8:
        return None
    # The last fields, if all are there, say where the key ends; a container that holds more or less is taken as far as it goes.
    keys, end = int.from_bytes(data[at : at + 4], "big"), at + 4
    told = 0 < keys <= 16
    for _ in range(keys + 1 if told else 0):
        end = field(end) if end is not None else None
    return "openssh", end if told and end is not None else len(data)


def _unbase64(text: str, urlsafe: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def token_length(text: str) -> int:
    """How much of the dot-separated parts is a signed (or encrypted) token: a JSON header that names its algorithm; 0 if none is."""
    parts = text.split(".")
    head = _unbase64(parts[0], True)
    try:
        header = json.loads(head) if head else None
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return 0
        if len(parts) >= 5 and "enc" in header and all(parts[2:5]):
            return len(".".join(parts[:5]))
        return len(".".join(parts[:3])) if len(parts) >= 3 and isinstance(json.loads(_unbase64(parts[1], True) or b"0"), dict) else 0
    except (ValueError, RecursionError):
        return 0


def signed_token(text: str) -> bool:
    return token_length(text) == len(text) > 0


def key_at(data: bytes) -> tuple[str, int] | None:
    """The private key that ``data`` begins with: kind, bytes."""
    return private_der(data) or openssh_private(data)


def key_kind(data: bytes | None) -> str | None:
    """The kind of private key that ``data`` is, from its first byte to its last."""
    found = key_at(data) if data else None
    return found[0] if found and (found[1] == len(data) or found[0] == "openssh") else None


def _der_size(head: bytes) -> int | None:
    """Bytes that the sequence ``head`` begins takes, header included, if a private key can follow."""
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[0] != 0x30 or n > 4 or len(head) < n + 3 or head[1] == 0x80:
        return None
    after = head[2 + n : 4 + n]
    if not (after[:1] == b"\x30" or after[:1] == b"\x02" and after in (b"\x02", b"\x02\x01")):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _base64_key(text: str, at: int) -> tuple[int, str] | None:
    """(end, kind) of the key whose base64 begins at ``at``. The alphabet is read both ways."""
    bare = lambda t: t.replace("\r", "").replace("\n", "").replace("-", "+").replace("_", "/")
    known = None
    if text[at] == "M":
        head = bare(_BASE64_RUN.match(text, at, at + 16)[0])[:12]
        known = _der_size(base64.b64decode(head[: len(head) // 4 * 4])) if len(head) >= 8 else None
        if known is None:
            return None
    # Wrapped lines have at least one character to a line break of two.
    run = _BASE64_RUN.match(text, at, *([at + 4 * known + 8] if known else []))[0]
    body = bare(run)
    if known:
        if len(body) < -(-known * 4 // 3):
            return None
        body = body[: -(-known * 4 // 3)]
    found = key_at(_unbase64(body) or (_unbase64(body[:-1]) if not known else None) or b"")
    if not found:
        return None
    left, end = -(-found[1] * 4 // 3), at
    for c in run:  # the characters the key takes, line breaks not counted
        left -= c not in "\r\n"
        end += 1
        if not left:
            break
    while text[end : end + 1] == "=" and (end - at) % 4:
        end += 1
    return end, f"base64_{found[0]}"


def _hex_key(text: str, at: int) -> tuple[int, str] | None:
    if text[at] == "3":
        head = bytes.fromhex(_HEX_RUN.match(text, at, at + 16)[0])
        known = _der_size(head) if len(head) > 2 else None
        if known is None:
            return None
        run = text[at : at + 2 * known]
        found = key_at(bytes.fromhex(run)) if _HEX_RUN.fullmatch(run) and len(run) == 2 * known else None
    else:
        found = key_at(bytes.fromhex(_HEX_RUN.match(text, at)[0]))
    return (at + 2 * found[1], f"hex_{found[0]}") if found else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _unbroken(body: str) -> str:
    return re.sub(r"\\[nrt]|\s", "", body)


def _pem_kind(headers: str, body: str) -> str | None:
    data = _unbase64(_unbroken(body))
    if "ENCRYPTED" in headers and "DEK-Info:" in headers:
        return "encrypted" if data and len(data) % 8 == 0 else None
    return key_kind(data)


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of encoded candidates that decode to what they look like."""
    out = []
    if "-----BEGIN" in text:
        out = [(m.start(), m.end(), f"pem_{kind}") for m in _PEM.finditer(text) if (kind := _pem_kind(m[2], m[3]))]
    taken = [(s, e) for s, e, _ in out]

    def search(start: re.Pattern, confirm) -> None:
        """All places where ``start`` matches outside of what was found before."""
        at = 0
        while m := start.search(text, at):
            k = bisect_right(taken, (m.start(), len(text))) - 1
            found = None if k >= 0 and m.start() < taken[k][1] else confirm(text, m.start())
            if found:
                out.append((m.start(), *found))
            at = found[0] if found else taken[k][1] if k >= 0 and m.start() < taken[k][1] else m.start() + 1

    def token(text: str, at: int) -> tuple[int, str] | None:
        m = _TOKEN.match(text, at)
        n = token_length(m[0]) if m else 0
        return (at + n, "signed_token") if n else None

    search(_TOKEN_START, token)
    search(_BASE64_START, _base64_key)
    search(_HEX_START, _hex_key)
    return out


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    """Counts by base kind, digest of the base spans, all spans."""
    long_word = max(map(len, text.split()), default=0) >= 20
    if not long_word and ":" not in text and "=" not in text and "-----BEGIN" not in text and not _BASE64_START.search(text):
        return 0, 0, 0, _NOTHING, ""
    base = base_spans(text)
    shown = [(s, k, e, BASE_KINDS[k]) for s, k, e in base]
    digest = hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in shown).encode()).hexdigest()
    every = sorted(shown + [(s, len(BASE_KINDS), e, n) for s, e, n in confirmed_spans(text)])
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return n[0], n[1], n[2], digest, ",".join(f"{name}:{s}:{e}" for s, _, e, name in every)


_NOTHING = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; no shuffle, memory is one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(scan_text(t.as_py() or "") for t in b.column(1)))) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

"""Secret scans with structural confirmation.

Base kinds are patterns. The method adds spans only for what decodes: base64 or hex runs (of either case) that hold a private
key whose nested lengths fill it exactly, whatever stands before them, and over line ends or colons, armoured keys, and signed tokens whose header parses. Public keys and certificates
are no secrets. Base spans stay whatever the method finds.

Cheap byte tests over the whole batch choose the documents in which a pattern can match at all; the
patterns then run over their whole texts.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terralens.llm import textkernel as K

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "pem", "key")
KINDS = BASE_KINDS + ADDED_KINDS
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40})-----")
ARMOUR_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:.*$", re.M)
ENCRYPTED = re.compile(r"^DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]{16,}[ \t]*$", re.M)
#: Where an encoded key may begin, whatever stands before it: the first byte of a sequence and a length, or the magic of the other format.
START64 = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA)")
START_HEX = re.compile(r"(?=30:?(?:[0-7][0-9A-Fa-f]|8[1-4]):?[0-9A-Fa-f]{2}|6[Ff]:?70:?65:?6[Ee]:?73:?73:?68:?2[Dd])")
#: Digits that go on after a key, on its line or as a line of their own.
HEX_MORE = re.compile(r":?[0-9A-Fa-f]{2}|:?[ \t]*\r?\n[ \t]*(?:[0-9A-Fa-f]{2}:?)+(?![0-9A-Za-z])")
RUN64, MORE64 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[A-Za-z0-9+/_-]")
#: What may stand between the lines of an encoding, and between its bytes if these are written apart.
BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
PAIR = re.compile(r":?(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*)?([0-9A-Fa-f]{2})")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_B64 = np.zeros(256, bool)
_B64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_ANY_HEX = np.zeros(256, bool)
_ANY_HEX[list(b"0123456789abcdefABCDEF")] = True
#: Tags of the encodings that are parsed.
_INTEGER, _BITS, _OCTETS, _OBJECT, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Nesting that a key needs at most.
_DEPTH = 12


def _der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the items that fill data[start:end] exactly; else None."""
    items, p = [], start
    while p < end:
        if p + 2 > end:
            return None
        tag, size, p = data[p], data[p + 1], p + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or p + n > end:
                return None
            size, p = int.from_bytes(data[p : p + n], "big"), p + n
        if p + size > end:
            return None
        items.append((tag, p, p + size))
        p += size
    return items


def _whole(data: bytes, start: int, end: int, depth: int = _DEPTH) -> bool:
    """True if data[start:end] is filled by items, and each constructed item by its own, whatever the depth."""
    items = _der_items(data, start, end)
    return items is not None and depth > 0 and all(_whole(data, a, b, depth - 1) for tag, a, b in items if tag & 0x20)


def _strings(data: bytes, start: int, end: int) -> list[tuple[int, int]] | None:
    """(start, end) of length-prefixed strings that fill data[start:end] exactly; else None."""
    out = []
    while start < end:
        a = start + 4
        start = a + int.from_bytes(data[start:a], "big")
        if a > end or start > end:
            return None
        out.append((a, start))
    return out


def _is_openssh(data: bytes) -> bool:
    """Cipher, its parameters, a number of public keys, each well-formed, and the private part; nothing else."""
    p, magic = 15, b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    heads = []
    for _ in range(3):
        n = int.from_bytes(data[p : p + 4], "big")
        heads.append(data[p + 4 : p + 4 + n])
        p += 4 + n
    count = int.from_bytes(data[p : p + 4], "big")
    parts = _strings(data, p + 4, len(data)) if p + 4 <= len(data) else None
    if not heads[0].isascii() or not heads[0] or parts is None or not 1 <= count == len(parts) - 1:
        return False
    publics = [_strings(data, a, b) for a, b in parts[:-1]]
    named = all(s and len(s) >= 2 and data[s[0][0] : s[0][1]].isascii() for s in publics)
    a, b = parts[-1]
    if heads[0] != b"none":
        return named and b - a >= 16
    # two equal check numbers begin a private part that isn't encrypted
    return named and b - a >= 24 and data[a : a + 4] == data[a + 4 : a + 8]


def is_key(data: bytes) -> bool:
    """True for private keys: DER (numbers after a version; version, algorithm and key; version and key; algorithm and encrypted key) and OpenSSH ones."""
    if _is_openssh(data):
        return True
    outer = _der_items(data, 0, len(data)) if len(data) >= 16 and data[0] == _SEQUENCE else None
    if not outer or len(outer) != 1 or not _whole(data, 0, len(data)):
        return False
    inner = _der_items(data, outer[0][1], outer[0][2]) or []
    tags = [x[0] for x in inner]
    algorithm = lambda k: (_der_items(data, *inner[k][1:]) or [(0, 0, 0)])[0][0] == _OBJECT
    if tags[:1] == [_INTEGER] and inner[0][2] - inner[0][1] == 1 and len(tags) > 1:
        if tags[1] == _INTEGER:
            return len(tags) >= 6 and all(t == _INTEGER for t in tags[:6])
        if tags[1] == _OCTETS:
            return inner[1][2] - inner[1][1] >= 16
        return tags[1:3] == [_SEQUENCE, _OCTETS] and algorithm(1) and _whole(data, *inner[2][1:])
    return tags == [_SEQUENCE, _OCTETS] and algorithm(0) and inner[1][2] - inner[1][1] >= 16


def _unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _stated(data: bytes) -> int | None:
    """How many bytes a key that begins so has at least, as far as its lengths are known; None if no key begins so."""
    if data[:1] == b"o":
        p = 15
        for _ in range(3):
            if len(data) < p + 4:
                return p + 4
            p += 4 + int.from_bytes(data[p : p + 4], "big")
        if len(data) < p + 4:
            return p + 4
        more, p = int.from_bytes(data[p : p + 4], "big") + 1, p + 4
        if more > 1 << 10:
            return None
        for _ in range(more):
            if len(data) < p + 4:
                return p + 4
            p += 4 + int.from_bytes(data[p : p + 4], "big")
        return p
    if len(data) < 9 or data[0] != _SEQUENCE:
        return 9 if data[:1] == b"0" else None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return None
    size = int.from_bytes(data[2 : 2 + n], "big") if n else data[1]
    at = 2 + n
    # a version or an algorithm comes first
    first = data[at : at + 2] == b"\x02\x01" or data[at] == _SEQUENCE
    return at + size if first and size >= 14 else None


def _base64_at(text: str, p: int) -> tuple[bytes, int] | None:
    """The bytes of a key whose base64 begins at p, over line ends, and where it ends; None if none does."""
    data, end, quads = b"", p, ""
    while True:
        need = _stated(data) if data else 9
        if need is None:
            return None
        if need <= len(data):
            break
        left = -(-need * 4 // 3) - len(quads)
        while left > 0:
            m = RUN64.match(text, end, end + left)
            if m:
                quads, end, left = quads + m[0], m.end(), left - len(m[0])
            elif quads and (m := BREAK.match(text, end)):
                end = m.end()
            else:
                return None
        data = _unbase64(quads if len(quads) % 4 != 1 else quads[:-1]) or b""
        if not data:
            return None
    end += next((k for k in range(-len(quads) % 4, 0, -1) if text.startswith("=" * k, end)), 0)
    return data[:need], end


def _hex_at(text: str, p: int) -> tuple[bytes, int] | None:
    """The same for hexadecimal digits, with or without colons."""
    data, end = bytearray(), p
    while True:
        need = _stated(bytes(data)) if data else 9
        if need is None:
            return None
        if need <= len(data):
            return bytes(data[:need]), end
        whole = text[end : end + 2 * (need - len(data))]
        if len(whole) == 2 * (need - len(data)) and whole.isalnum() and whole.isascii() and not whole.strip("0123456789abcdefABCDEF"):
            data += bytes.fromhex(whole)
            end += len(whole)
        while len(data) < need:
            m = PAIR.match(text, end)
            if not m:
                return None
            data.append(int(m[1], 16))
            end = m.end()


def encoded_keys(text: str, start: re.Pattern, read) -> Iterator[tuple[int, int]]:
    """Spans of encoded private keys, by their own lengths; of nested ones the outer counts. What goes on in the same alphabet where a key should end is none."""
    done = 0
    more = HEX_MORE if start is START_HEX else MORE64
    for m in start.finditer(text):
        if m.start() >= done and (found := read(text, m.start())) and is_key(found[0]) and not more.match(text, found[1]):
            done = found[1]
            yield m.start(), done


def is_signed_token(text: str) -> bool:
    """The header decodes to an object that names its algorithm, and the claims decode to an object."""
    head, claims, _ = text.split(".")
    try:
        first, second = (json.loads(_unbase64(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of tokens; a candidate that fails hides none that begins within it."""
    at = 0
    while m := JWT.search(text, at):
        good = is_signed_token(m[0])
        if good:
            yield m.span()
        at = m.end() if good else m.start() + 1


def armoured_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a BEGIN line to the END line of the same name that comes next. Header lines, and line ends that are escaped as in JSON, don't count."""
    begin = None
    for m in ARMOUR.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2]:
            body = re.sub(r"\\[nr]", "\n", text[begin.end() : m.start()])
            plain = _unbase64(re.sub(r"\s", "", ARMOUR_HEADER.sub("", body)))
            if plain and (is_key(plain) or m[2].endswith("PRIVATE KEY") and ENCRYPTED.search(body) and len(plain) % 8 == 0):
                yield begin.start(), m.end()
        begin = m if m[1] == "BEGIN" else None


def scan(text: str, raw: bytes, hexes: list[tuple[int, int]], long_run: bool, long_hex: bool) -> list[tuple[int, int, str]]:
    """All spans of a text: (start, order of kind, end). hexes: code-point spans of lower-case hex runs of 24 or more characters."""
    found: list[tuple[int, int, int]] = [(s, 2, e) for s, e in hexes]
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"eyJ" in raw:
        found += [(s, 3, e) for s, e in signed_tokens(text)]
    if b"-----BEGIN " in raw:
        found += [(s, 4, e) for s, e in armoured_keys(text)]
    if long_run:
        found += [(s, 5, e) for s, e in encoded_keys(text, START64, _base64_at)]
    if long_hex or b"30:" in raw or b":70:65:" in raw:
        found += [(s, 5, e) for s, e in encoded_keys(text, START_HEX, _hex_at)]
    return sorted(set(found))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def _runs(data: np.ndarray, off: np.ndarray, mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and documents of runs of a character class."""
    s, e, _ = K.words(data, off, mask)
    keep = e - s >= least
    s, e = s[keep], e[keep]
    return s, e, np.searchsorted(off, s, "right") - 1


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans (``kind:start:end``, code points, end exclusive), n_confirmed.

    A null or empty text has no spans. Rows are independent; null and repeated ids and extra columns change nothing. A text of any length
    is scanned whole; only the patterns' work grows with it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(1)):
                rows = [[] for _ in range(6)]
                hs, he, hd = _runs(data, off, _HEX, 24)
                _, _, ld = _runs(data, off, _B64, 40)
                _, _, xd = _runs(data, off, _ANY_HEX, 32)
                chars = np.concatenate([[0], np.cumsum(K.char_starts(data))])
                hexes: dict[int, list[tuple[int, int]]] = {}
                for s, e, d in zip(hs.tolist(), he.tolist(), hd.tolist(), strict=True):
                    base = chars[off[d]]
                    hexes.setdefault(d, []).append((int(chars[s] - base), int(chars[e] - base)))
                long_runs, long_hexes = set(ld.tolist()), set(xd.tolist())
                whole = data.tobytes()
                for q in range(j - i):
                    raw = whole[off[q] : off[q + 1]]
                    spans = scan(raw.decode(), raw, hexes.get(q, []), q in long_runs, q in long_hexes) if raw else []
                    for k in range(3):
                        rows[k].append(sum(x[1] == k for x in spans))
                    rows[3].append(hashlib.sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest())
                    rows[4].append(_joined(spans))
                    rows[5].append(sum(x[1] >= 3 for x in spans))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(r, pa.int64()) for r in rows[:3]), *(pa.array(r, pa.string()) for r in rows[3:5]), pa.array(rows[5], pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")

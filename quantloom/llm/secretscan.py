"""Secret scans: pattern spans, and spans that only a parse of the decoded candidate confirms.

Base kinds are patterns alone.  Further kinds decode a base64 or hex candidate
and report it only if its structure holds to the last byte: ``jwt`` (three
parts, a JSON header that names an algorithm, a JSON claim set) and ``key``
(private keys in PKCS#1, PKCS#8, SEC1, DSA or OpenSSH encoding: nested lengths
that end where their parent ends, and the key inside a PKCS#8 wrapping in its
algorithm's own form).  A PEM frame may surround a key, its base64 may be
wrapped over lines with or without a frame, and PEM's own encryption is judged
by its headers and block lengths.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "key")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ with at least 32 characters
ANY_HEX, UPPER_HEX = re.compile(r"[0-9A-Fa-f]{32,}"), re.compile(r"[0-9A-F]{32,}")  # candidates of added kinds
PARTS = re.compile(r"\.[A-Za-z0-9_-]+\.")  # any dotted run of three parts has one
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++\.?")  # runs of base64url parts
GLUED = re.compile(r"[_-](e[yw][A-Za-z0-9+/]+)$")  # a JSON object's base64 behind a prefix
FRAME = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
HEADER = re.compile(r"(?m)^[ \t]*([A-Za-z-]+):[ \t]*(.*?)[ \t\r]*$")
CIPHER = re.compile(r"([A-Z0-9-]+),([0-9A-F]+|[0-9a-f]+)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++={0,2})++")  # base64 lines below each other
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")

SEQUENCE, INTEGER, OCTETS, OID, CONTEXT = 0x30, 0x02, 0x04, 0x06, 0xA0
OPENSSH = b"openssh-key-v1\0"
# Object identifiers, DER-encoded.
RSA, DSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # PKCS#5, PKCS#12


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it is neither."""
    body = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at`` if its length is minimal and stays inside ``end``."""
    if at + 2 > end:
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or start + k > end or data[start] == 0:
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 0x80:
            return None
    return (tag, start, start + n) if start + n <= end else None


#: No key has more elements beside each other.
MOST_PARTS = 16


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill data[start:end] exactly; None if they do not, or are too many for a key."""
    out = []
    while start < end:
        if len(out) == MOST_PARTS or (x := tlv(data, start, end)) is None:
            return None
        out.append(x)
        start = x[2]
    return out


def _fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """Elements of the one SEQUENCE that data[start:end] is; empty if it is none."""
    top = tlv(data, start, end)
    return (children(data, top[1], top[2]) or []) if top and top[0] == SEQUENCE and top[2] == end else []


def _is_pkcs1(data: bytes, parts) -> bool:
    """Version 0 or 1 and eight numbers; a multi-prime key has further parts."""
    return [t for t, _, _ in parts[:9]] == [INTEGER] * 9 and data[parts[0][1] : parts[0][2]] in (b"\0", b"\1")


def _is_sec1(data: bytes, parts) -> bool:
    """Version 1, the number, and tagged parts."""
    tags = [t for t, _, _ in parts]
    return tags[:2] == [INTEGER, OCTETS] and all(t & 0xF0 == CONTEXT for t in tags[2:]) and data[parts[0][1] : parts[0][2]] == b"\1" and 16 <= parts[1][2] - parts[1][1] <= 72


def _is_dsa(data: bytes, parts) -> bool:
    """Version 0, p, q, g, y, x."""
    size = [b - a for _, a, b in parts]
    return [t for t, _, _ in parts] == [INTEGER] * 6 and data[parts[0][1] : parts[0][2]] == b"\0" and size[1] >= 64 and 16 <= size[2] <= 65


def _is_inner_key(data: bytes, algorithm: bytes, start: int, end: int) -> bool:
    """Whether a PKCS#8 wrapping's data[start:end] has the form of its algorithm's keys; of unknown ones, one whole element."""
    if algorithm == RSA:
        return _is_pkcs1(data, _fields(data, start, end))
    if algorithm == EC:
        return _is_sec1(data, _fields(data, start, end))
    one = tlv(data, start, end)
    if one is None or one[2] != end:
        return False
    if algorithm == DSA:
        return one[0] == INTEGER
    return algorithm not in EDWARDS or (one[0] == OCTETS and one[2] - one[1] == EDWARDS[algorithm])


def is_private_der(data) -> bool:
    """Whether data is one DER private key: PKCS#1, DSA, SEC1 or PKCS#8, plain or encrypted."""
    parts = _fields(data, 0, len(data))
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if _is_pkcs1(data, parts) or _is_dsa(data, parts) or _is_sec1(data, parts):
        return True
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8
        inner = children(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == OID and _is_inner_key(data, data[inner[0][1] : inner[0][2]], *parts[2][1:])
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8: by a password-based scheme, or it is some other record
        inner = children(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == OID and data[inner[0][1] : inner[0][2]].startswith(PASSWORD_BASED)
    return False


def openssh_end(data) -> int | None:
    """Where an OpenSSH private key ends: magic, three length-prefixed strings, a count, then that many strings and one more."""
    if not data.startswith(OPENSSH):
        return None
    at, strings = len(OPENSSH), 3
    for step in range(2):
        for _ in range(strings):
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            if at > len(data):
                return None
        if step == 0:
            if at + 4 > len(data):
                return None
            strings, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
            if not 2 <= strings <= 65:
                return None
    return at


def is_openssh(data: bytes) -> bool:
    return openssh_end(data) == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_openssh(data))


def is_signed_token(token: str) -> bool:
    header, claims, signature = token.split(".")
    try:
        head, body = (json.loads((decode64(x) or b"").decode()) for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)):
        return False
    return not signature if head["alg"].lower() == "none" else len(decode64(signature) or b"") >= 16


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the signed tokens: any three parts of a dotted run, from left to right, none in two tokens."""
    out = []
    for m in DOTTED.finditer(text) if PARTS.search(text) else ():
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            # the shortest header that names an algorithm has 14 characters, an empty claim set 3
            step, skip = 1, 0
            if len(parts[k]) >= 14 and len(parts[k + 1]) >= 3:
                glued = GLUED.search(parts[k])  # a prefix such as sk_ before the header
                for skip in (0, *((glued.start(1),) if glued else ())):
                    if len(parts[k]) - skip >= 14 and is_signed_token(".".join((parts[k][skip:], *parts[k + 1 : k + 3]))):
                        step = 3
                        break
            if step == 3:
                out.append((at + skip, at + sum(map(len, parts[k : k + 3])) + 2))
            at += sum(map(len, parts[k : k + step])) + step
            k += step
    return out


def framed_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of PEM frames with a key inside; a frame ends at the next five dashes or not at all."""
    out, m = [], FRAME.search(text)
    while m:
        label, body = m[1], m.end()
        stop = text.find("-----", body)
        end = f"-----END {label}-----"
        if stop < 0:
            break
        if text.startswith(end, stop):
            inner = text[body:stop].replace("\\r", "").replace("\\n", "\n")  # line ends may be escaped
            headers = dict(HEADER.findall(inner))
            data = decode64(HEADER.sub("", inner))
            cipher = CIPHER.fullmatch(headers.get("DEK-Info", ""))
            encrypted = headers.get("Proc-Type") == "4,ENCRYPTED" and cipher and data
            if (encrypted and len(data) >= 32 and len(data) % (len(cipher[2]) // 2 or 1) == 0 and len(cipher[2]) in (16, 32)) or is_key(data):
                out.append((m.start(), stop + len(end)))
            stop += len(end)
        m = FRAME.search(text, stop)
    return out


class Coded:
    """Bytes of a base64 text from a character on, decoded where they are looked at: judging a candidate costs its fields, not its size."""

    HEAD = 144  # characters decoded at once

    def __init__(self, text: str, at: int, size: int | None = None) -> None:
        self.text, self.at = text, at
        self.size = (len(text) - at) * 6 // 8 if size is None else size
        self.head = self._decoded(at, at + self.HEAD)[: self.size]

    def _decoded(self, a: int, b: int) -> bytes:
        own = self.text[a:b]
        return base64.b64decode(own[: len(own) - (len(own) % 4 == 1)] + "=" * (-len(own) % 4))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, place):
        if isinstance(place, int):
            return self.head[place] if place < len(self.head) else self[place : place + 1][0]
        a, b = place.start or 0, min(self.size if place.stop is None else place.stop, self.size)
        if b <= len(self.head):
            return self.head[a:b]
        return self._decoded(self.at + a // 3 * 4, self.at + -(-b // 3) * 4)[a % 3 : a % 3 + b - a] if a < b else b""

    def startswith(self, head: bytes) -> bool:
        return self[: len(head)] == head


def key_size(data: Coded) -> int | None:
    """The bytes that a key's own lengths ask for; None if it starts like none."""
    if data[:1] == b"\x30":
        top = tlv(data, 0, 1 << 16) if len(data) > 6 else None  # lengths beyond 64 KiB are no key's
        return top[2] if top and data[top[1] : top[1] + 1] in (b"\x02", b"\x30") else None
    return openssh_end(data)


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of keys whose base64 is wrapped over lines, without a frame; the encoding's own length says where they end."""
    out = []
    for run in WRAPPED.finditer(text):
        lines = [(m.start(), m.end()) for m in LINE.finditer(text, *run.span())]
        bodies = [text[a:b].rstrip("=") for a, b in lines]
        whole = "".join(bodies).replace("-", "+").replace("_", "/")
        before = [0, *accumulate(map(len, bodies))]
        padded = [i for i, (a, b) in enumerate(lines) if b - a > len(bodies[i])]  # only a key's last line may be
        k = 0
        while k < len(lines) - 1:
            size = key_size(Coded(whole, before[k]))
            if size:
                stop = before[k] + -(-size * 8 // 6)
                last = bisect_left(before, stop, k + 1) - 1
                pad = bisect_left(padded, k)
                if k < last < len(lines) and before[last + 1] == stop and (pad == len(padded) or padded[pad] >= last) and is_key(Coded(whole, before[k], size)):
                    out.append((lines[k][0], lines[last][1]))
                    k = last
            k += 1
    return out


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kind is a place in KINDS; offsets in code points, end exclusive."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in signed_tokens(text)]
    framed = framed_keys(text)
    starts = [a for a, _ in framed]
    inside = lambda at: bool(starts) and (i := bisect_right(starts, at)) > 0 and at < framed[i - 1][1]
    keys = {*framed, *(x for x in wrapped_keys(text) if not inside(x[0]))}
    keys.update(m.span() for m in BASE64.finditer(text) if not inside(m.start()) and is_key(decode64(m[0])))
    for a, b in {m.span() for run in ANY_HEX.finditer(text) for p in (ANY_HEX, HEX, UPPER_HEX) for m in p.finditer(text, *run.span())}:
        if (b - a) % 2 == 0 and is_key(bytes.fromhex(text[a:b])):
            keys.add((a, b))
    return sorted(out + [(a, 4, b) for a, b in keys])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row, in order of start and kind.

    Null text counts as empty.  Rows are judged one by one, so repeated rows
    repeat their result; an empty table gives an empty one.  Other columns are
    ignored.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", doc_id)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text, beside the other columns."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(*[c for c in found.columns if c != "spans"], *[count(k) for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

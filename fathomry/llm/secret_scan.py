"""Secret scan with structural confirmation.

Three plain patterns (assignments, access keys, long lower-case hex) give base spans. Beside them, candidates in base64 or
hex are decoded and parsed: private keys must be DER whose nested lengths add up and whose fields are those of a key, an
OpenSSH key must have its length-prefixed fields, a signed token must have a JSON header that names its algorithm. Keys are
found where they lie in practice: in PEM blocks with real or escaped line breaks and with headers, bare and wrapped over lines,
encrypted, and inside further layers of base64 or hex, down to ``DEPTH`` of them. Only what parses is reported, as kind ``key``
or ``jwt``.

Cases: a null or empty text has no spans; every row gives a row, repeated rows too; other columns are not touched; a long
text is scanned whole, each pattern in time linear in its length but for runs of under 24 hex digits.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import read, row_slices, tidy

KINDS = ("assign", "access", "hex", "jwt", "key")
BASE = KINDS[:3]
#: Bytes of text that are decoded at once.
PIECE = 4_000_000
SPAN = "array<struct<kind:string,start:int,end:int>>"

# The first letter comes as a set so that the scan can skip to it; the rest is the contract's pattern.
ASSIGN = re.compile(
    r"[aApPsStT](?i:(?<=p)assword|(?<=p)asswd|(?<=s)ecret|(?<=t)oken|(?<=a)pi_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"ey(?<![A-Za-z0-9_-]ey)[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
# Runs of base64 that may be wrapped: lines end in breaks, real or escaped.
WRAP = r"[A-Za-z0-9+/_-]{39,}+(?:(?:\r?\n[\x20\t]{0,16}|\\r\\n|\\n)[A-Za-z0-9+/_-]++)*+={0,2}"
DER64 = re.compile(rf"M(?<![A-Za-z0-9+/_-]M){WRAP}|M(?<=\\nM){WRAP}")
SSH64 = re.compile(rf"b3BlbnNza(?<![A-Za-z0-9+/_-]b3BlbnNza){WRAP}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----((?:[^-]|-(?!----))*+)-----END \1PRIVATE KEY-----")
DERHEX = re.compile(r"30(?<![0-9A-Fa-f]30)[0-9A-Fa-f]{46,}+")
# Further layers: any long run of base64 or hex is decoded, and looked into if it is ASCII text.
NEST64 = re.compile(rf"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))[A-Za-z0-9+/_-]{WRAP}")
NESTHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-7][0-9A-Fa-f]){24,}+")
LONG = 40
DEPTH = 3


def unbase64(run: str) -> bytes | None:
    run = re.sub(r"\s+|\\[rn]", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list | None:
    """[(tag, bytes or nested items)] if the lengths of ``data`` add up exactly at every level."""
    at, items = 0, []
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > len(data):
            return None
        body, at = data[at : at + n], at + n
        if tag & 0x20:
            body = der_items(body, depth + 1)
            if body is None:
                return None
        items.append((tag, body))
    return items


def is_der_key(data: bytes | None) -> bool:
    """PKCS#1, PKCS#8, SEC 1 or DSA private key: an outer sequence, a version, then the fields of one of these."""
    top = der_items(data) if data and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    fields = top[0][1]
    tags = [tag for tag, _ in fields]
    if len(fields) < 2 or tags[0] != 0x02 or len(fields[0][1]) != 1 or fields[0][1][0] > 1:
        return False
    if len(tags) >= 6 and set(tags[:9]) == {0x02}:
        return all(body for _, body in fields[:9])
    if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        return bool(fields[1][1]) and fields[1][1][0][0] == 0x06
    return tags[1] == 0x04 and len(fields[1][1]) >= 16 and all(tag in (0xA0, 0xA1) for tag in tags[2:])


def is_ssh_key(data: bytes | None) -> bool:
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_sealed_key(data: bytes | None) -> bool:
    """Encrypted PKCS#8: a sequence of an algorithm (an identifier with parameters) and a string of bytes."""
    top = der_items(data) if data and data[0] == 0x30 else None
    if not top or len(top) != 1 or [tag for tag, _ in top[0][1]] != [0x30, 0x04]:
        return False
    (_, algorithm), (_, sealed) = top[0][1]
    return len(algorithm) == 2 and algorithm[0][0] == 0x06 and algorithm[1][0] == 0x30 and len(sealed) >= 16


def is_key(data: bytes | None) -> bool:
    return is_der_key(data) or is_ssh_key(data) or is_sealed_key(data)


def is_pem_key(body: str) -> bool:
    """The inside of a PEM block: headers, if any, then base64; an encrypted one by its headers and whole cipher blocks."""
    lines = re.split(r"\r?\n|\\r\\n|\\n", body)
    heads = [x for x in lines if ":" in x]
    data = unbase64("".join(x for x in lines if ":" not in x))
    if any(x.strip().startswith("DEK-Info:") for x in heads):
        return bool(data) and len(data) % 8 == 0 and any("ENCRYPTED" in x for x in heads)
    return is_key(data)


def bare_key(run: str) -> int:
    """Length of the part of a base64 run that is a DER key, by the outer length; 0 if it is none. What follows may be anything."""
    at = [i for m in re.finditer(r"[A-Za-z0-9+/_-]+", re.sub(r"\\[rn]", "  ", run)) for i in range(m.start(), m.end())]
    head = unbase64("".join(run[i] for i in at[:12])) or b""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4:
        return 0
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    n = -(-size * 4 // 3)
    if n > len(at) or not is_key((unbase64("".join(run[i] for i in at[:n])) or b"")[:size]):
        return 0
    end = at[n - 1] + 1
    return end + len(re.match(r"={0,2}", run[end:])[0])


def is_signed_token(run: str) -> bool:
    parts = run.split(".")
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and (bool(parts[2]) or head["alg"].lower() == "none")


def unwrapped(run: str) -> Iterator[tuple[bytes | None, int]]:
    """What a run may decode to, and its length: lines as long as the first and a shorter last one, then without that one."""
    cuts = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]+=*", re.sub(r"\\[rn]", "  ", run))]
    whole = 1
    while whole < len(cuts) and cuts[whole][1] - cuts[whole][0] == cuts[0][1] - cuts[0][0]:
        whole += 1
    for n in (whole + 1, whole):
        if n <= len(cuts) or n == whole:
            yield unbase64("".join(run[a:b] for a, b in cuts[:n])), cuts[min(n, len(cuts)) - 1][1]


def find_keys(text: str, depth: int) -> list[tuple[int, int]]:
    """Spans of keys, and of runs that hold a key or a signed token under further encoding, ``depth`` layers at most."""
    keys = [(m.start(), m.end()) for m in PEM.finditer(text) if is_pem_key(m[2])] if "-----BEGIN" in text else []
    if max(map(len, text.split()), default=0) < LONG:  # all that follows are long runs without blanks
        return keys
    keys += [(m.start(), m.start() + n) for m in DER64.finditer(text) if (n := bare_key(m[0]))]
    for m in SSH64.finditer(text):
        keys += [(m.start(), m.start() + n) for data, n in unwrapped(m[0]) if is_ssh_key(data)][:1]
    keys += [(m.start(), m.end()) for m in DERHEX.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    if depth:
        layers = [(m.start(), n, data) for m in NEST64.finditer(text) for data, n in unwrapped(m[0]) if data]
        layers += [(m.start(), len(m[0]), bytes.fromhex(m[0])) for m in NESTHEX.finditer(text)]
        for at, n, data in layers:
            if data.isascii():
                inner = data.decode("ascii")
                if find_keys(inner, depth - 1) or any(is_signed_token(x[0]) for x in JWT.finditer(inner)):
                    keys.append((at, at + n))
    return keys


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by kind."""
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    keys = find_keys(text, DEPTH)
    keys.sort(key=lambda s: (s[0], -s[1]))
    end = -1
    for a, b in keys:  # a run inside a reported block is the same key
        if a >= end:
            found.append(("key", a, b))
            end = b
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str | None, spans: list[tuple[str, int, int]], label: str = "[SECRET]") -> str | None:
    """The text with every maximal union of spans replaced by ``label``."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at if end < 0 else end : a], label]
            end = b
        else:
            end = max(end, b)
    return "".join([*out, text[end:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in row_slices(batches, 1, PIECE):
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row of ``docs`` (doc_id, text): one narrow pass, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scan), f"doc_id long, spans {SPAN}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` in text, and n_chars, where there is one, counted again."""
    place, width = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, place, PIECE):
            columns, texts = list(batch.columns), batch.column(place).to_pylist()
            done = [mask(t, find_spans(t)) for t in texts]
            columns[place] = pa.array(done, batch.schema.field(place).type)
            if width is not None:
                counts = batch.column(width).to_pylist()
                counts = [n if a == b else len(b) for n, a, b in zip(counts, texts, done, strict=True)]
                columns[width] = pa.array(counts, batch.schema.field(width).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(clean), docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[3:]),
    )

"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds are email, ip (parts of at most 255), card (16 to 19 digits passing Luhn) and phone (``+`` and 8 to 15 digits).
The method adds ``iban`` (its country's length and mod-97), ``card`` of 13 to 15 digits passing Luhn where the score reaches
``THRESHOLD``, that is, beside a context word, and national ``phone`` numbers (of up to 40 characters, outside other spans)
beside one. Base spans are always kept; their score tells how sure they are. ``op6_pii`` returns the scores in the order of its
spans.

Cases: a null or empty text has no spans; repeated rows each give a row; other columns are not touched; whole texts are
scanned in time linear in their length (emails are found from their ``@``, digit runs only from their first digit).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import read, row_slices, tidy

KINDS = ("email", "ip", "card", "phone", "iban")
#: Bytes of text that are decoded at once.
PIECE = 4_000_000
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
THRESHOLD = 0.6
WINDOW = 48

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"[0-9(](?<![0-9+(][0-9(])(?:[0-9]|[\x20().-](?=[0-9(\x20]))+")
IBAN = re.compile(r"[A-Z][A-Z](?<![A-Za-z0-9]..)[0-9][0-9](?:\x20?[A-Z0-9]){11,30}")
# Lengths of account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pan"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
NEAR = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(words)})", re.IGNORECASE) for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def context(kind: str, text: str, start: int, end: int) -> bool:
    return bool(NEAR[kind].search(text, max(0, start - WINDOW), start) or NEAR[kind].search(text, end, end + WINDOW))


def find_spans(text: str | None) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) in code points, end exclusive, by kind as listed and then by start."""
    if not text:
        return []
    base = [("email", *s) for s in emails(text)] + [("ip", *s) for s in addresses(text)]
    more = []
    for m in CARD.finditer(text):
        if 13 <= (n := sum(c not in " -" for c in m[0])) <= 19 and luhn(re.sub("[ -]", "", m[0])):
            (base if n >= 16 else more).append(("card", *m.span()))
    base += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    out = [(k, a, b, True, min(1.0, START[k] + 0.1 * context(k, text, a, b))) for k, a, b in base]
    for m in IBAN.finditer(text):
        run, need = m[0], IBAN_LENGTH.get(m[0][:2], 0)
        while need and len(run.replace(" ", "")) > need:
            run = run[:-1]
        if need and len(run.replace(" ", "")) == need and mod97(run.replace(" ", "")):
            out.append(("iban", m.start(), m.start() + len(run.rstrip()), False, min(1.0, START["iban"] + 0.1 * context("iban", text, *m.span()))))
    for kind, a, b in more:
        if (score := 0.4 + 0.4 * context(kind, text, a, b)) >= THRESHOLD:
            out.append((kind, a, b, False, score))
    if NEAR["phone"].search(text):
        starts, ends = [], []  # of the maximal unions of what is reported already
        for a, b in sorted((a, b) for _, a, b, _, _ in out):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a), ends.append(b)
        for m in NATIONAL.finditer(text):
            a, b = m.span()
            if b - a > 40 or not 9 <= sum("0" <= c <= "9" for c in m[0]) <= 12 or not text[b - 1].isdigit():
                continue
            i = bisect_left(starts, b) - 1
            if (i < 0 or ends[i] <= a) and context("phone", text, a, b):
                out.append(("phone", a, b, False, 0.6))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "base", "score")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
    for batch in row_slices(batches, 1, PIECE):
        spans = [[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base, score) of every row of ``docs``: one narrow pass, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scan), f"doc_id long, spans {SPAN}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return scan_pii(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:4]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )

"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of shares of character classes, word
lengths, repetitions and ``GRAMS`` hashed classes of three letters in a row (computed over whole batches of bytes with numpy), is
encoded by a tanh layer, and gets a gated
attention weight, softmax over the document of w . (tanh(V h) * sigmoid(U h)). The weighted sum of its passages is scored by
a logistic layer. Encoder, attention and scorer are learned together, from document labels alone.

Fitted on at most ``ROWS`` labelled documents that are not held out, at most ``FIT_BYTES`` of text together, whole texts: their
passage vectors, not their texts, are gathered. A model is small: under 50 kB goes to the tasks.

Cases: null, empty and blank texts have no passage; their score is that of a bag without evidence, and 0 without usable
labels; repeated rows each give a row; a null doc_id is scored but never learned from; other columns are not read. A long
text is scored in parts of whole passages, ``PIECE`` bytes together; only one passage larger than that (32 words without a
blank in megabytes) is taken at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import held_out, labelled_texts, read, row_slices, tidy

ROWS = 4_000
PASSAGE = 32
HIDDEN, GATE = 24, 12
#: Bytes of text at once: a slice needs some 60 times as much for its arrays.
PIECE = 1_000_000
THRESHOLD = 0.3

# Classes of bytes: lower case, upper case, digit, blank, control, lead and trail bytes of other characters, and each ASCII mark.
LOWER, UPPER, DIGIT, BLANK, LINE, CONTROL, LEAD, TRAIL = range(8)
CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = (
        TRAIL if 0x80 <= _b < 0xC0 else LEAD if _b >= 0xC0 else LOWER if "a" <= _c <= "z" else UPPER if "A" <= _c <= "Z" else DIGIT if "0" <= _c <= "9"
        else LINE if _c == "\n" else BLANK if _c in " \t\r\x0b\x0c" else CONTROL if _b < 0x20 or _b == 0x7F else 8
    )
CLASS[CLASS == 8] = 8 + np.arange((CLASS == 8).sum())
CLASSES = int(CLASS.max()) + 1
MIX = np.random.default_rng(11).integers(1, 1 << 62, 256).astype(np.uint64) | np.uint64(1)
PLACE = np.random.default_rng(12).integers(1, 1 << 62, 64).astype(np.uint64) | np.uint64(1)
#: Buckets of hashed letter triples; how much they count beside the rest before anything is learned.
GRAMS, GRAM_SCALE = 64, 0.5
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
WIDTH = CLASSES + 6 + GRAMS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of the texts ``data[offsets[i]:offsets[i + 1]]`` and the number of passages of each text."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros((0, WIDTH), np.float32), np.zeros(texts, int)
    kind = CLASS[data]
    inside = (kind != BLANK) & (kind != LINE)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    start[cuts] = inside[cuts]
    words = np.flatnonzero(start)
    if not len(words):
        return np.zeros((0, WIDTH), np.float32), np.zeros(texts, int)
    per_text = np.searchsorted(words, offsets[1:]) - np.searchsorted(words, offsets[:-1])
    number = np.arange(len(words)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = np.flatnonzero(number % PASSAGE == 0)
    bags = -(-per_text // PASSAGE)
    # A passage's bytes run to the next passage of its text, or to the text's end.
    begin = words[first]
    owner = np.repeat(np.arange(texts), bags)
    last = np.r_[owner[1:] != owner[:-1], True]
    stop = np.where(last, offsets[1:][owner], np.r_[begin[1:], len(data)])
    span = stop - begin
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, begin, 1)
    passage = np.cumsum(mark[:-1]) - 1
    used = (passage >= 0) & (np.arange(len(data)) < stop[np.maximum(passage, 0)])
    counts = np.bincount((passage.astype(np.int64) * CLASSES + kind)[used], minlength=len(begin) * CLASSES).reshape(-1, CLASSES)
    # Hashes of words, to see repetitions.
    nth = np.cumsum(start) - 1
    place = (np.arange(len(data)) - words[np.maximum(nth, 0)]) & 63
    parts = np.where(inside, MIX[data] * PLACE[place], np.uint64(0))
    hashes = np.add.reduceat(parts, words)
    letters = np.add.reduceat(inside.astype(np.int32) - (kind == TRAIL), words)
    n = np.minimum(PASSAGE, np.repeat(per_text, bags) - (number[first]))
    repeats = []
    for lag in (1, 2, 3):
        same = np.zeros(len(words))
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (number[lag:] >= lag)
        repeats.append(np.add.reduceat(same, first) / n)
    mean = np.add.reduceat(letters.astype(float), first) / n
    var = np.maximum(np.add.reduceat(letters.astype(float) ** 2, first) / n - mean**2, 0)
    x = np.concatenate([np.sqrt(counts / np.maximum(span, 1)[:, None]), triples(data, inside, passage, used, len(begin)), np.stack([*repeats, np.log1p(mean), np.log1p(np.sqrt(var)), n / PASSAGE], 1)], 1)
    return x.astype(np.float32), bags


def triples(data: np.ndarray, inside: np.ndarray, passage: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """Shares (square roots) of each passage's letter triples within words, case aside, by hash bucket."""
    if len(data) < 3:
        return np.zeros((n, GRAMS))
    low = LOW[data].astype(np.uint32)
    bucket = ((low[:-2] * np.uint32(2654435761) + low[1:-1] * np.uint32(2246822519) + low[2:] * np.uint32(3266489917)) >> np.uint32(13)) % np.uint32(GRAMS)
    whole = inside[:-2] & inside[1:-1] & inside[2:] & used[:-2] & used[2:] & (passage[:-2] == passage[2:])
    counts = np.bincount((passage[:-2].astype(np.int64) * GRAMS + bucket)[whole], minlength=n * GRAMS).reshape(-1, GRAMS)
    return np.sqrt(counts / np.maximum(counts.sum(1), 1)[:, None])


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets, without copies of single texts; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, raw_offsets, raw = column.buffers()
    ends = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def borders(data: np.ndarray, at_once: int) -> np.ndarray:
    """Where the passages of one text begin, found a stretch of bytes at a time."""
    found, number, before = [], 0, False
    for at in range(0, len(data), at_once):
        kind = CLASS[data[at : at + at_once]]
        inside = (kind != BLANK) & (kind != LINE)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[0] &= not before
        words = np.flatnonzero(start)
        found.append(at + words[(np.arange(len(words)) + number) % PASSAGE == 0])
        number, before = number + len(words), bool(inside[-1])
    return np.concatenate(found)


def passages_of(data: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """Passage vectors of one long text, some ``at_once`` bytes of passages at a time (one passage at least). Each time the
    passage before comes along, as words are compared with those before them, and its vector is left out."""
    edges = np.append(borders(data, at_once), len(data))
    first, last = 0, len(edges) - 1
    while first < last:
        stop = max(first + 1, int(np.searchsorted(edges, edges[first] + at_once, "right")) - 1)
        context = max(0, first - 1)
        some = data[edges[context] : edges[stop]]
        yield passages(some, np.array([0, len(some)]))[0][first - context :]
        first = stop


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def score_long(self, parts: Iterator[np.ndarray]) -> tuple[float, int, int | None]:
        """Score, number of passages and the most attended one of a text whose passages come in parts: the softmax over all of
        them is kept as its largest exponent, the sum and the weighted sum so far."""
        w, n, top, best, total = self.weights, 0, -np.inf, None, 0.0
        z = np.zeros(len(w["c"]))
        for x in parts:
            if not len(x):
                continue
            h, s = attended(w, (x - self.mean) / self.spread)[:2]
            if s.max() > top:
                best, old, top = n + int(s.argmax()), top, float(s.max())
                z, total = z * np.exp(old - top), total * np.exp(old - top)
            e = np.exp(s - top)
            z, total, n = z + e @ h, total + e.sum(), n + len(x)
        return float(1 / (1 + np.exp(-(z / (total or 1.0) @ w["c"] + w["d"][0])))), n, best

    def score(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags, and the passages' attention weights."""
        p, a, *_ = forward(self.weights, (x - self.mean) / self.spread, bags)
        return p, a


def attended(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Encoded passages, the exponents of their attention, and both gates."""
    h = np.tanh(x @ w["W"] + w["b"])
    t = np.tanh(h @ w["V"] + w["v"])
    g = 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
    return h, (t * g) @ w["a"], t, g


def forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, ...]:
    h, s, t, g = attended(w, x)
    a, z, owner = np.zeros(len(x)), np.zeros((len(bags), h.shape[1])), np.repeat(np.arange(len(bags)), bags)
    some = np.flatnonzero(bags)
    if len(some):
        starts = (np.cumsum(bags) - bags)[some]
        top = np.zeros(len(bags))
        top[some] = np.maximum.reduceat(s, starts)
        e = np.exp(s - top[owner])
        total = np.ones(len(bags))
        total[some] = np.add.reduceat(e, starts)
        a = e / total[owner]
        z[some] = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"][0])))
    return p, a, h, t, g, z, owner


def gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, a, h, t, g, z, owner = forward(w, x, bags)
    dl = (p - y) / len(y)
    dz = dl[:, None] * w["c"]
    dh = a[:, None] * dz[owner]
    da = (h * dz[owner]).sum(1)
    ds = a * (da - np.bincount(owner, a * da, len(bags))[owner])
    dtg = ds[:, None] * w["a"]
    dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
    dh += dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - h**2)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0), "a": (t * g).T @ ds, "c": z.T @ dl, "d": np.array([dl.sum()])}


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 128, seed: int = 3) -> Model | None:
    """Adam over batches of documents."""
    if not len(x) or y.min() == y.max():
        return None
    mean, spread = x.mean(0), x.std(0) + 0.02
    x = ((x - mean) / spread).astype(np.float64)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    scale = np.where((np.arange(WIDTH) >= CLASSES) & (np.arange(WIDTH) < CLASSES + GRAMS), GRAM_SCALE, 1.0)[:, None]
    w = {"W": draw(WIDTH, HIDDEN) * scale, "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "v": np.zeros(GATE), "U": draw(HIDDEN, GATE), "u": np.zeros(GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(q) for k, q in w.items()} for _ in range(2))
    starts, step = np.cumsum(bags) - bags, 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            rows = np.concatenate([np.arange(starts[j], starts[j] + bags[j]) for j in own]).astype(int)
            grad, step = gradients(w, x[rows], bags[own], y[own]), step + 1
            for k in w:
                d = grad[k] + 1e-4 * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, w)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model | None:
    """A model of at most ``rows`` labelled documents that are not held out, of at most ``FIT_BYTES`` of text together."""
    found = labelled_texts(docs, labels, "quality", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 2, PIECE):
            x, bags = passages(*arrow_bytes(batch.column(2)))
            starts = np.cumsum(bags) - bags
            packed = [x[a : a + n].tobytes() for a, n in zip(starts, bags, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "y", "x"])

    got = sorted(((r["doc_id"], bytes(r["x"]), r["y"]) for r in found.mapInArrow(tidy(run), "doc_id long, y int, x binary").collect()), key=lambda r: r[:2])
    if not got:
        return None
    vectors = [np.frombuffer(r[1], np.float32).reshape(-1, WIDTH) for r in got]
    return fit(np.concatenate(vectors), np.array([len(v) for v in vectors]), np.array([r[2] for r in got], float))


def scored(model: Model | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Scores, numbers of passages and most attended passages of some texts. One of more than ``PIECE`` bytes comes alone."""
    data, offsets = arrow_bytes(column)
    if len(column) == 1 and len(data) > PIECE:
        if model is None:
            return np.zeros(1), np.array([len(borders(data, PIECE))]), [0]
        p, n, top = model.score_long(passages_of(data, PIECE))
        return np.array([p]), np.array([n]), [top]
    x, bags = passages(data, offsets)
    p, a = model.score(x, bags) if model else (np.zeros(len(bags)), np.zeros(len(x)))
    starts = np.cumsum(bags) - bags
    return p, bags, [int(np.argmax(a[s : s + n])) if n else None for s, n in zip(starts, bags, strict=True)]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, n_passages, top_passage (the most attended, from 0) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, PIECE):
            p, bags, top = scored(model, batch.column(1))
            columns = [batch.column(0), pa.array(p, pa.float64()), pa.array(bags, pa.int64()), pa.array(top, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_passages", "top_passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, n_passages long, top_passage int")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; all of them where nothing could be learned."""
    if model is None:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, place, PIECE):
            p = scored(model, batch.column(place))[0]
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage")

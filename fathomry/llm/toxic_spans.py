"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so training tokens are labelled first: a word counts as toxic where its document is labelled toxic
and the word is one that toxic documents hold far more often: at ``ODDS`` times the rate at least, and so that among all words
as frequent, chance would bring forth less than ``CHANCE`` of its like.
The chain has two states. A word's evidence is learned weights of its own form, its beginnings and ending, and the forms
before and after it, so unseen words are judged by their parts and neighbours; transitions are learned too. Forward-backward gives each word's marginal;
a document's score is a logistic function of the highest marginal and of the expected number of toxic words, fitted on the
same documents; stretches of words with a marginal of a half or more are reported as offsets.

Fitted on a bounded sample of ``ROWS`` labelled documents, whole texts; of these on all chains with toxic words or words that
begin alike, and on a random share of the rest, as many again, ``BACKGROUND`` chains if that is more. The model is the weights of
the parts of words seen in the chains that were learned from, those worth keeping.

Cases: null and empty texts get the score that no evidence gives and no spans; without usable labels every score is 0;
repeated rows each give a row; a null doc_id is scored but never learned from; texts are read whole, in chains of ``CHAIN``.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import binary_values, held_out, labelled_texts, read, row_slices, tidy

ROWS = 6_000
#: Chains without toxic words, or words like them, that are learned from at least (about; all if there are fewer).
BACKGROUND = 6_000
CHAIN = 48
#: Chains at once in a round of the fit.
BLOCK = 2_048
ODDS, CHANCE = 12.0, 0.1
MARKS = b".,;:!?\"'()[]{}<>*#%&$|-_"
CACHE = 400_000
#: The penalty on each feature's weights; the last two are the word as the one before and the one after its neighbour.
FEATURES = {"own": 0.02, "begins4": 4.0, "begins6": 2.0, "ends4": 4.0, "before": 4.0, "after": 4.0}
SCHEMA = "doc_id long, score double, n_toxic long, spans array<struct<start:int,end:int,marginal:double>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (ASCII) words without the marks around them; one for every run between ASCII blanks."""
    return [w.strip(MARKS) for w in text.lower().split()] if text else []


def parts(word: bytes) -> tuple[bytes, ...]:
    return word, word[:4], word[:6], word[-4:], word, word


class Vocabulary(dict):
    """Word -> number; for each number, in order, what ``value`` tells of its parts: one number for each of ``FEATURES``."""

    def __init__(self, value: Callable[[int, bytes], float], kind: str) -> None:
        super().__init__()
        self.value, self.flat = value, array(kind)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        self[word] = n
        self.flat.extend(self.value(role, part) for role, part in enumerate(parts(word)))
        return n

    def table(self) -> np.ndarray:
        return np.array(self.flat).reshape(-1, len(FEATURES))


@dataclass
class Model:
    weights: list[dict[bytes, float]]  # by feature
    bias: float
    step: np.ndarray  # log weights of the four transitions, [from, to]
    document: np.ndarray  # of the logistic function: constant, highest log odds, log of expected count

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(lambda role, part: self.weights[role].get(part, 0.0), "d")

    def evidence(self, ids: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log odds of each word by its own features; ``first`` and ``last`` mark the ends of texts."""
        v = values[ids]
        e = v[:, :4].sum(1) + self.bias
        e[1:] += np.where(first[1:], 0, v[:-1, 4])
        e[:-1] += np.where(last[:-1], 0, v[1:, 5])
        return e


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index [chain, place] of each word, and which places hold one; a text's words fill chains of their own."""
    starts = np.cumsum(lengths) - lengths
    pieces = -(-lengths // CHAIN)
    at = np.repeat(starts, pieces) + CHAIN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.repeat(starts + lengths, pieces)
    index = at[:, None] + np.arange(CHAIN)
    real = index < end[:, None]
    return np.where(real, index, 0), real


def marginals(evidence: np.ndarray, real: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of the toxic state at every place by forward-backward, kept as odds; with forward and backward odds."""
    x = np.exp(np.clip(evidence, -30, 30))
    t = np.exp(step)
    n, m = x.shape
    fwd, bwd = np.empty((n, m)), np.empty((n, m))
    r = np.ones(n)
    for k in range(m):
        r = x[:, k] * (((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)) if k else 1.0)
        r = np.clip(r, 1e-15, 1e15)
        fwd[:, k] = r
    b = np.ones(n)
    for k in range(m - 1, -1, -1):
        bwd[:, k] = b
        y = x[:, k] * b
        b = np.clip((t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y), 1e-15, 1e15)
        b = np.where(real[:, k], b, 1.0)
    return np.log(fwd * bwd), fwd, bwd


def expected_pairs(evidence: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probabilities [transition, place, chain] of the four transitions between neighbouring places."""
    y = np.exp(np.clip(evidence[:, 1:], -30, 30)) * bwd[:, 1:]
    t, r = np.exp(step), fwd[:, :-1]
    u = np.stack([(t[0, 0] + 0 * y).T, (t[0, 1] * y).T, (t[1, 0] * r).T, (t[1, 1] * r * y).T])
    return u / u.sum(0)


def copies(docs: list[np.ndarray]) -> np.ndarray:
    """For each document the first one whose words are much the same: at least a quarter of 16 word minima agree."""
    odd = np.random.default_rng(9).integers(1, 1 << 31, 16) * 2 + 1
    minima = np.array([((d[:, None].astype(np.int64) + 1) * odd % 4_294_967_291).min(0) if len(d) else np.full(16, -1 - i) for i, d in enumerate(docs)])
    same = np.arange(len(docs))
    for i in range(1, len(docs)):
        like = np.flatnonzero((minima[:i] == minima[i]).sum(1) >= 4)
        if len(like):
            same[i] = same[like[0]]
    return same


def toxic_words(docs: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Which words (by number) toxic documents hold so often that chance doesn't explain it; near copies count once."""
    bad, every = np.zeros(size, int), np.zeros(size, int)
    own = [np.unique(d) for d, y in zip(docs, labels, strict=True) if y]
    group = copies(own)
    for g in np.unique(group):
        words = np.unique(np.concatenate([own[i] for i in np.flatnonzero(group == g)]))
        bad[words] += 1
    every += bad
    for d, y in zip(docs, labels, strict=True):
        if not y:
            every[np.unique(d)] += 1
    n_bad, n_good = len(np.unique(group)), (1 - labels).sum()
    rate = n_bad / (n_bad + n_good)
    as_frequent = np.append(np.cumsum(np.bincount(bad, minlength=2)[::-1])[::-1], 1)
    out = np.zeros(size, bool)
    for w in np.flatnonzero((bad > 1) & (bad / n_bad >= ODDS * (every - bad + 1) / (n_good + 1))):
        n, k = int(every[w]), int(bad[w])
        chance = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate)
        out[w] = chance + math.log(as_frequent[k]) < math.log(CHANCE)
    return out


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 60) -> Model | None:
    """Adam on the chains' log likelihood (with a small quadratic penalty), then the document's logistic function."""
    if not len(labels) or labels.min() == labels.max():
        return None
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], dtype=np.int32) for t in texts]
    lengths = np.array([len(d) for d in docs])
    if not lengths.sum():
        return None
    ids, y_doc = np.concatenate(docs), np.repeat(labels, lengths)
    toxic = toxic_words(docs, labels, len(vocab))
    if b"" in vocab:
        toxic[vocab[b""]] = False
    y = toxic[ids] * y_doc
    first, last = ends(lengths)
    index, real = chains(lengths)
    # Chains with toxic words, all others that hold words beginning alike, and some of the rest.
    words = list(vocab)
    alike = {words[i][:4] for i in np.flatnonzero(toxic)}
    near = np.array([w[:4] in alike for w in words])
    keep = (near[ids][index] & real).any(1)
    keep |= np.random.default_rng(5).random(len(keep)) < min(1.0, max(keep.sum(), BACKGROUND) / len(keep))
    index, real = index[keep], real[keep]
    del keep, near
    # Features get numbers within the kept chains (their words and those beside them); a last one stands for the text's end.
    seen = np.unique(ids[np.concatenate([index[real], np.maximum(index[real] - 1, 0), np.minimum(index[real] + 1, len(ids) - 1)])])
    numbers: list[dict[bytes, int]] = [{} for _ in FEATURES]
    of = np.zeros((len(words), len(FEATURES)), np.int32)
    for i in seen:
        of[i] = [numbers[role].setdefault(part, len(numbers[role])) for role, part in enumerate(parts(words[i]))]
    size = max(len(n) for n in numbers)
    before, after = ids[np.maximum(index - 1, 0)], ids[np.minimum(index + 1, len(ids) - 1)]
    features = [*np.moveaxis(of[ids[index], :4], 2, 0), np.where(first[index], size, of[before, 4]), np.where(last[index], size, of[after, 5])]
    del of, before, after
    want = (y[index] * real).astype(np.int8)
    pairs = np.zeros((2, 2))
    a, b, both = want[:, :-1], want[:, 1:], real[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = ((a == i) & (b == j) & both).sum()
    del index, a, b, y, y_doc, first, last
    step = np.zeros((2, 2))
    w = np.zeros((6, size + 1))
    bias, penalty, total = -4.0, np.array([*FEATURES.values()])[:, None], real.sum()
    mean, var = np.zeros_like(w), np.zeros_like(w)
    bias_mv = [0.0, 0.0]
    for t in range(1, rounds + 1):
        # Chains are independent: what each block of them adds is summed, so that only a block's arrays are there at a time.
        grad, moves, gaps = penalty * w, np.zeros(4), 0.0
        for at in range(0, len(real), BLOCK):
            own, there = [f[at : at + BLOCK] for f in features], real[at : at + BLOCK]
            e = np.where(there, sum(w[i][f] for i, f in enumerate(own)) + bias, 0.0)
            odds, fwd, bwd = marginals(e, there, step)
            gap = np.where(there, 1 / (1 + np.exp(-odds)) - want[at : at + BLOCK], 0.0)
            for i, f in enumerate(own):
                grad[i] += np.bincount(f.ravel(), gap.ravel(), size + 1)
            moves += expected_pairs(e, fwd, bwd, step)[:, both[at : at + BLOCK].T].sum(1)
            gaps += gap.sum()
        grad[4:, size] = 0
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        w -= 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-3)
        w[4:, size] = 0
        step -= 0.5 * (moves.reshape(2, 2) - pairs) / max(1, both.sum()) ** 0.5 / 10
        step = np.clip(step - step[0, 0], -6, 6)
        g = gaps / total**0.5
        bias_mv = [0.9 * bias_mv[0] + 0.1 * g, 0.99 * bias_mv[1] + 0.01 * g * g]
        bias -= 0.1 * (bias_mv[0] / (1 - 0.9**t)) / ((bias_mv[1] / (1 - 0.99**t)) ** 0.5 + 1e-3)
    model = Model([{part: float(w[role, n]) for part, n in own.items() if abs(w[role, n]) > 0.01} for role, own in enumerate(numbers)], float(bias), step, np.zeros(3))
    values = array("f")
    for word in words:
        values.extend(model.weights[role].get(part, 0.0) for role, part in enumerate(parts(word)))
    table = np.frombuffer(values, np.float32).reshape(-1, len(FEATURES))
    some = [summaries(model, np.concatenate(docs[i : i + 256]), table, lengths[i : i + 256])[:2] for i in range(0, len(docs), 256)]
    top, count = (np.concatenate(x) for x in zip(*some, strict=True))
    x, prior = inputs(top, count), np.array([0.0, 1.0, 0.0])
    c = prior.copy()
    for _ in range(200):  # Newton steps, of length 1 at most, of the penalised logistic fit
        q = 1 / (1 + np.exp(np.clip(-x @ c, -50, 50)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3)
        step_ = np.linalg.solve(h, x.T @ (q - labels) + 0.5 * (c - prior))
        c -= step_ / max(1.0, float(np.linalg.norm(step_)))
    model.document = c
    return model


def ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(lengths.sum(), bool), np.zeros(lengths.sum(), bool)
    stops = np.cumsum(lengths)[lengths > 0]
    first[np.r_[0, stops[:-1]].astype(int)] = len(stops) > 0
    last[stops - 1] = True
    return first, last


def inputs(top: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(top)), np.clip(top, -4, 4), np.log1p(count)], 1)


def summaries(model: Model, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: highest log odds, expected number of toxic words; and the log odds of every word."""
    top, count = np.full(len(lengths), -10.0), np.zeros(len(lengths))
    odds = np.zeros(len(ids))
    if len(ids):
        index, real = chains(lengths)
        e = model.evidence(ids, values, *ends(lengths))
        for i in range(0, len(index), 4096):
            at, there = index[i : i + 4096], real[i : i + 4096]
            odds[at[there]] = marginals(np.where(there, e[at], 0.0), there, model.step)[0][there]
        some = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[some]
        top[some] = np.maximum.reduceat(odds, starts)
        count[some] = np.add.reduceat(1 / (1 + np.exp(-odds)), starts)
    return top, count, odds


def stretches(text: bytes, odds: np.ndarray) -> list[dict[str, float]]:
    """Runs of toxic words as code point offsets of the text, with the highest marginal of each."""
    out: list[dict[str, float]] = []
    for i, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
        if odds[i] >= 0:
            p = float(1 / (1 + np.exp(-odds[i])))
            if out and out[-1]["word"] == i - 1:
                out[-1] |= {"word": i, "to": m.end(), "marginal": max(out[-1]["marginal"], p)}
            else:
                out.append({"word": i, "from": m.start(), "to": m.end(), "marginal": p})
    at = points = 0
    for s in out:  # each byte is decoded once, whatever the number of runs
        for edge in ("from", "to"):
            points, at = points + len(text[at : s[edge]].decode("utf-8", "replace")), s[edge]
            s[edge] = points
    return [{"start": s["from"], "end": s["to"], "marginal": s["marginal"]} for s in out]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, n_toxic (words with a marginal of a half or more), spans of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = model.vocabulary() if model else {}
        for batch in row_slices(batches, 1, 4_000_000):
            texts = binary_values(batch.column(1))
            if model is None:
                scores, numbers, spans = [0.0] * len(texts), [0] * len(texts), [[] for _ in texts]
            else:
                if len(vocab) > CACHE:
                    vocab = model.vocabulary()
                words = [words_of(t) for t in texts]
                ids = np.array([vocab[w] for ws in words for w in ws], dtype=np.int64)
                lengths = np.array([len(ws) for ws in words])
                top, count, odds = summaries(model, ids, vocab.table(), lengths)
                scores = (1 / (1 + np.exp(np.clip(-inputs(top, count) @ model.document, -50, 50)))).tolist()
                numbers, spans, at = [], [], 0
                for t, k in zip(texts, lengths.tolist(), strict=True):
                    own, at = odds[at : at + k], at + k
                    numbers.append(int((own >= 0).sum()))
                    spans.append(stretches(t, own) if numbers[-1] else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_toxic", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model | None:
    """A model of at most ``rows`` labelled documents that are not held out, of at most ``FIT_BYTES`` of text together."""
    found = labelled_texts(docs, labels, "toxic", rows).select("doc_id", F.col("text").cast("binary").alias("text"), "y").collect()
    found = sorted((r["doc_id"], bytes(r["text"] or b""), r["y"]) for r in found)
    return fit([text for _, text, _ in found], np.array([y for _, _, y in found], dtype=float))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", F.to_json("spans").alias("spans"))

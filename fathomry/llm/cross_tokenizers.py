"""Alignment of two tokenizations of the same texts, and which tokens of one stand for which of the other in a corpus.

Both tokenizers cut a space and the text into byte ranges. Places where a token of either ends cut these into groups; tokens
that end together there are linked. In each Arrow partition DuckDB holds the ranges as interval tables: a range join finds
the links, window sums number the groups, an ASOF join gives each token the first cut at or after its end. Counts of linked id
pairs are summed by task and merged in Spark; they return to the documents as one lookup table. That table is bounded by the
vocabularies, not by the corpus: of two tokens that end together one is a suffix of the other, and ``possible_links`` counts
such pairs (under a million for the files used here).

Texts are cut before each single space between words. No token of either tokenizer lies across such a place (A opens a word
there, and no piece of B holds a space after another character), so a chunk is aligned once for all its occurrences that a
task remembers, and a document is the sequence of its chunks. This is checked on what comes out: a chunk
whose end is no cut is an error, not a wrong result.

Cases: null and empty texts, and texts that don't come back from their tokens (U+2581, bytes that are no UTF-8), have
zeros and an empty digest, and no share in the counts. Every row counts, repeated rows each; null ids are ids. Special
tokens' strings are plain text. A long text goes through in segments, but for one chunk (no single space between words), which
is encoded whole, with some 200 times its bytes of memory. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomry.llm.common import binary_values, read, row_slices, staged, tidy

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
BORDER = re.compile(r"(?<=[^ ]) (?=\S)")
#: Characters of a text that are cut into chunks at once, of chunks that are aligned at once, and of those encoded at once.
PART, SEGMENT, ENCODED = 1_000_000, 3_000_000, 250_000
#: Aligned chunks that a task remembers from one segment to the next.
REMEMBERED = 300_000
#: A pair of ids is one number: A's id times this, plus B's.
WIDTH = 1 << 15
OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("code", pa.int32()), ("n", pa.int64()),
])
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>, code int, n long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Coders:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for word, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in word)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.vocab_size() > WIDTH or len(self.a_bytes) * WIDTH > 1 << 31:
            raise ValueError("vocabularies too large for one number a pair")
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B, for a text that begins with a space; None if either's bytes differ from the text's."""
        raw = text.encode("utf-8", "surrogatepass")
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def possible_links(coders: Coders) -> int:
    """How many id pairs can end together at all: one token's bytes are a suffix of the other's."""
    total = 0
    for mine, others, equal in ((coders.a_bytes, coders.b_bytes, True), (coders.b_bytes, coders.a_bytes, False)):
        count: dict[bytes, int] = {}
        for x in others:
            count[x] = count.get(x, 0) + 1
        total += sum(count.get(x[k:], 0) for x in mine for k in range(0 if equal else 1, len(x)))
    return total


class Chunks:
    """Memory of aligned chunks, by number: groups as text, token and group counts, pair codes (``first`` cuts ``codes``)."""

    def __init__(self, coders: Coders):
        self.coders = coders
        self.digits = pa.array([str(i) for i in range(max(len(coders.a_bytes), len(coders.b_bytes)))])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        self.ok, self.counts = np.zeros(0, bool), np.zeros((0, 3), np.int64)
        self.codes, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, part: str) -> np.ndarray:
        """Of the chunks of a part, new ones numbered on. Ask for nothing else of these before ``learn``."""
        words, put = BORDER.split(part), self.number.setdefault
        chunks = chain((words[0],), (" " + w for w in words[1:]))
        return np.array([put(c, len(self.number)) for c in chunks], np.int32)

    def learn(self) -> None:
        """Align the chunks numbered since the last call."""
        chunks = list(islice(self.number, len(self.text), None))
        if not chunks:
            return
        a, b, stops, ok, at = [], [], [], np.ones(len(chunks), bool), 0
        for some, found in self.encoded(chunks):
            if found is None:
                ok[some] = False
                stops.append(np.full(len(some), at))
                continue
            a.append((at + np.cumsum(self.coders.a_sizes[found[0]]), found[0]))
            b.append((at + np.cumsum(self.coders.b_sizes[found[1]]), found[1]))
            ends = at + np.cumsum([len(chunks[k].encode()) for k in some])
            stops.append(ends)
            at = int(ends[-1])
        self.align(self.table(a, "a"), self.table(b, "b"), np.concatenate(stops), ok)

    @staticmethod
    def table(parts: list, name: str) -> pa.Table:
        ends, ids = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"lo": np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], "hi": ends, name: ids})

    def encoded(self, chunks: list[str]) -> Iterator[tuple[list[int], tuple | None]]:
        """Runs of chunks with their tokens, in order. A run whose bytes don't come back is halved until only bad chunks are
        left; a chunk with blanks at an edge is a run of its own, as it would run into its neighbours."""

        def halved(some: list[int]) -> Iterator[tuple[list[int], tuple | None]]:
            found = self.coders.encode("".join([chunks[k] for k in some]))
            if found is not None or len(some) == 1:
                yield some, found
            else:
                yield from halved(some[: len(some) // 2])
                yield from halved(some[len(some) // 2 :])

        run: list[int] = []
        size = 0
        for k, c in enumerate(chunks):
            alone = c[1:2].isspace() or c[-1].isspace() or len(c) > ENCODED
            if run and (alone or size + len(c) > ENCODED):
                yield from halved(run)
                run, size = [], 0
            if alone:
                yield [k], self.coders.encode(c)
            else:
                run.append(k)
                size += len(c)
        if run:
            yield from halved(run)

    def align(self, a: pa.Table, b: pa.Table, ends: np.ndarray, ok: np.ndarray) -> None:
        n, good = len(ends), np.flatnonzero(ok)
        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1500MB", "temp_directory": ""})
        try:
            for name, table in (("a", a), ("b", b), ("c", pa.table({"chunk": good, "hi": ends[good]}))):
                db.register(f"{name}_in", table)
                db.execute(f"CREATE TABLE {name} AS FROM {name}_in")
            # Links, one at each cut: ranges that overlap and end together.
            db.execute("CREATE TABLE cut AS SELECT a.hi, a, b, row_number() OVER (ORDER BY a.hi) - 1 AS g FROM a JOIN b ON a.hi = b.hi AND a.lo < b.hi AND b.lo < a.hi")
            # The group of a token of A by a sum over the cuts before it, of one of B by the first cut at or after its end.
            group_a = db.execute("SELECT coalesce(sum((cut.hi IS NOT NULL)::INT) OVER (ORDER BY a.hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM a LEFT JOIN cut USING (hi) ORDER BY a.hi").fetchnumpy()["g"]
            group_b = db.execute("SELECT g FROM b ASOF JOIN cut ON b.hi <= cut.hi ORDER BY b.hi").fetchnumpy()["g"]
            cuts = db.execute(f"SELECT cut.hi, chunk, (a * {WIDTH} + b)::INT AS code FROM cut ASOF JOIN c ON cut.hi <= c.hi ORDER BY cut.hi").fetchnumpy()
        finally:
            db.close()
        if not np.isin(ends[good], cuts["hi"]).all():
            raise ValueError("a token lies across the border of two chunks: these tokenizers can't be aligned by chunks")
        groups = len(cuts["hi"])
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        # A group's tokens in a row: those of A, then those of B, each followed by what divides it from the next.
        before_a, before_b = (np.concatenate([[0], np.cumsum(x)]) for x in (in_a, in_b))
        place_a, place_b = np.arange(len(group_a)) + before_b[group_a], np.arange(len(group_b)) + before_a[group_b + 1]
        ids, mark = np.zeros(len(place_a) + len(place_b), np.int64), np.zeros(len(place_a) + len(place_b), np.int8)
        ids[place_a], ids[place_b] = a.column("a").to_numpy(), b.column("b").to_numpy()
        mark[place_a[before_a[1:] - 1]] = 1
        mark[place_b[before_b[1:] - 1]] = 2
        last = np.flatnonzero(np.append(cuts["chunk"][1:] != cuts["chunk"][:-1], True)) if groups else np.zeros(0, np.int64)
        mark[place_b[before_b[last + 1] - 1]] = 3
        texts = pc.binary_join_element_wise(self.digits.take(ids), pa.array([",", "|", ";", ""]).take(mark), "")
        counts = np.stack([np.bincount(cuts["chunk"], x, n) for x in (in_a, in_b, np.ones(groups))], axis=1).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(counts[:, 0] + counts[:, 1])]).astype(np.int32)
        self.text += pc.binary_join(pa.ListArray.from_arrays(edges, texts), "").cast(pa.binary()).to_pylist()
        self.ok, self.counts = np.concatenate([self.ok, ok]), np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[:, 2])])
        self.codes = np.concatenate([self.codes, cuts["code"].astype(np.int32)])

    def codes_of(self, chunks: np.ndarray) -> np.ndarray:
        """Pair codes of all these occurrences, in a row."""
        first, stop = self.first[chunks], self.first[chunks + 1]
        sizes = stop - first
        start = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return self.codes[start + np.arange(len(start))]


class Document:
    """Sums of the parts of one text."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.counts, self.hash, self.ok, self.begun = doc_id, np.zeros(3, np.int64), hashlib.sha256(), True, False
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, found: Chunks, chunks: np.ndarray) -> None:
        self.ok = self.ok and bool(found.ok[chunks].all())
        if not self.ok:
            return
        self.counts += found.counts[chunks].sum(axis=0)
        for at in range(0, len(chunks), 50_000):
            self.hash.update((b";" if self.begun else b"") + b";".join(map(found.text.__getitem__, chunks[at : at + 50_000].tolist())))
            self.begun = True
        self.codes.append(np.unique(found.codes_of(chunks), return_counts=True))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) == 1:
            return self.codes[0]
        codes, at = np.unique(np.concatenate([c for c, _ in self.codes]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([t for _, t in self.codes])).astype(np.int64)


def parts(text: str) -> Iterator[str]:
    """A space and the text, cut at borders of chunks."""
    whole, at = " " + text, 0
    while at < len(whole):
        found = BORDER.search(whole, at + PART)
        stop = found.start() if found else len(whole)
        yield whole[at:stop]
        at = stop


def batch_of(docs: list[Document]) -> Iterator[pa.RecordBatch]:
    """A row a document, then the counts of their pairs."""
    live = [d.ok and d.begun for d in docs]
    pairs = [d.merged() if x else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for d, x in zip(docs, live, strict=True)]
    codes, times = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    edges = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in pairs])]).astype(np.int32))
    counts = np.array([d.counts if x else (0, 0, 0) for d, x in zip(docs, live, strict=True)])
    none = pa.nulls(len(docs))
    yield pa.RecordBatch.from_arrays([
        pa.array([d.doc_id for d in docs], pa.int64()), *(pa.array(counts[:, j]) for j in (0, 1, 2, 2)),
        pa.array([d.hash.hexdigest() if x else "" for d, x in zip(docs, live, strict=True)]),
        pa.ListArray.from_arrays(edges, pa.array(codes, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
        none.cast(pa.int32()), none.cast(pa.int64()),
    ], schema=OUT)
    found, at = np.unique(codes, return_inverse=True)
    if len(found):
        table = {"code": pa.array(found, pa.int32()), "n": pa.array(np.bincount(at, times).astype(np.int64))}
        yield pa.RecordBatch.from_arrays([table.get(f.name, pa.nulls(len(found), f.type)) for f in OUT], schema=OUT)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row a document (doc_id, n_a, n_b, n_groups, n_links, groups_sha256; its pair codes and how often each), and rows
    with partial counts of pair codes (``code``, ``n``; no ``codes``). The files must exist on all machines."""
    a_file, b_file = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(Coders(a_file, b_file))
        for batch in row_slices(batches, 1):
            rows = []
            segment: list[tuple[Document, np.ndarray]] = []
            size = 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                rows.append(doc := Document(doc_id))
                text = (raw or b"").decode("utf-8", "replace")
                if not raw or SPACE in text or ("\ufffd" in text and text.encode() != raw):
                    doc.ok = False
                    continue
                for part in parts(text):
                    segment.append((doc, chunks.numbers(part)))
                    size += len(part)
                    if size >= SEGMENT:
                        finish(chunks, segment)
                        segment, size = [], 0
            finish(chunks, segment)
            yield from batch_of(rows)

    def finish(chunks: Chunks, segment: list[tuple[Document, np.ndarray]]) -> None:
        chunks.learn()
        for doc, some in segment:
            doc.add(chunks, some)
        if len(chunks.number) > REMEMBERED:
            chunks.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def link_counts(rows: DataFrame) -> DataFrame:
    """a, b, n, best of each id pair that ends together anywhere; ``best``: no A id has a higher count with this B id."""
    counts = rows.where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = counts.select(F.floor(F.col("code") / WIDTH).cast("int").alias("a"), (F.col("code") % WIDTH).alias("b"), "n")
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # at most one row an A id


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``aligned`` with n_best and count_sum. ``counts`` is bounded by ``possible_links``."""
    table = counts.select((F.col("a") * WIDTH + F.col("b")).cast("int").alias("code"), "n", "best").orderBy("code").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            codes, times = batch.column(6), batch.column(7)
            edges = codes.offsets.to_numpy()
            flat = codes.values.to_numpy()[edges[0] : edges[-1]] if len(edges) else codes.flatten().to_numpy()
            often = times.values.to_numpy()[edges[0] : edges[-1]].astype(np.int64)
            at = np.searchsorted(known, flat)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (often * best[at], often * n[at])]
            edges = edges - edges[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), *(pa.array(s[edges[1:]] - s[edges[:-1]]) for s in sums)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.where("codes is not null").drop("code", "n").mapInArrow(run, schema)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(aligned(read(spark, sf_dir, "documents")), "aligned")
    return scored(rows, link_counts(rows))

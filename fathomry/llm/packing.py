"""Packing of documents into token sequences, online and in bounded space.

A document's token ids, with an end id after them, fill whole sequences first; what is left over goes to the best fitting of
``WINDOWS`` open windows of its partition. Where none has room and no further window may be opened, the fullest is filled up
with the head of the piece and emitted, so that it needs no padding, and the rest of the piece is placed again. Windows still
open at a partition's end are merged, ``FAN`` partitions a task and round after round, by the same rule; those of the last
round are run together and their remainder is cut into lengths that are powers of two, which aren't padded.

Ids through a memory: this tokenizer drops white space and encodes each run of letters, digits or marks by itself, so a text is
the sequence of its runs, each looked up or encoded once. Whatever isn't plainly cut (other scripts, special tokens) it
encodes itself, word by word.

Cases: a null or empty text is its end id alone; every row is packed, repeated rows each; a null id is an id like any other;
a text of any length is encoded in parts. An empty table has no pieces. Nothing is drawn or hashed: with the same
partitions a rerun gives the same pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomry.llm.common import binary_values, read, row_slices, staged, tidy

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 1, 2048
#: Open windows of a partition, and partitions whose windows one task merges.
WINDOWS, FAN = 8, 8
#: Characters of a text that are cut at once, bytes of texts encoded together, runs and odd words remembered by a task.
PART, TOGETHER, REMEMBERED = 1_000_000, 8_000_000, 600_000

PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()),
])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"
# Texts of plain letters, digits and marks are cut into runs here, as the tokenizer cuts them; odd words it gets whole.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Words:
    """Token ids of texts through a memory of their runs of letters, digits and marks, and of odd words."""

    def __init__(self, path: str):
        self.coder = Tokenizer.from_file(path)
        vocabulary = self.coder.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.coder.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the memory, in order: runs in lower case, and words that hold anything odd as they are."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return RUN.findall(text.lower())
        out = []
        for word in text.split(" "):
            if "<|" not in word and PLAIN.fullmatch(word):
                out += RUN.findall(word.lower())
            else:
                out.append(word)
        return out

    def learn(self, keys: list[str]) -> None:
        """Number new keys on. Runs are encoded together and told apart by their word ends; odd words each by itself."""
        plain = [k for k in keys if "<|" not in k and PLAIN.fullmatch(k)]
        flat, sizes = [self.flat], []
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.coder.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("this tokenizer doesn't end each run by itself")
            flat.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        known = set(plain)
        odd = [k for k in keys if k not in known]
        for at in range(0, len(odd), 1000):
            found = [np.array(e.ids, "<u4") for e in self.coder.encode_batch_fast(odd[at : at + 1000], add_special_tokens=False)]
            flat += found
            sizes.append(np.array([len(x) for x in found]))
        self.number.update((k, n) for n, k in enumerate(chain(plain, odd), len(self.number)))
        self.flat = np.concatenate(flat)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])

    def joined(self, cut: list[list[str]]) -> list[bytes]:
        runs = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        keys = runs.dictionary.to_pylist()
        fresh = [k for k in keys if k not in self.number]
        if len(self.number) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = keys
        if fresh:
            self.learn(fresh)
        numbers = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))[runs.indices.to_numpy()]
        sizes = self.first[numbers + 1] - self.first[numbers]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[numbers] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)].tobytes()
        edges = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(int)] * 4
        return [ids[a:b] for a, b in pairwise(edges.tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. One of more than ``PART`` characters goes in parts."""
        if all(len(t) <= PART for t in texts):
            return self.joined([self.cut(t) for t in texts])
        return [b"".join(self.joined([self.cut(p)])[0] for p in self.parts(t)) for t in texts]

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            stop = text.find(" ", at + PART)
            stop = len(text) if stop < 0 else stop
            yield text[at:stop]
            at = stop + 1


class Packer:
    """Open windows of one place; finished sequences are rows of PIECE. ``base`` begins the numbers of its sequences."""

    def __init__(self, base: int, windows: int):
        self.base, self.windows, self.n = base, windows, 0
        self.open: list[tuple[int, list[tuple]]] = []
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.base + self.n, offset, None, None))
            offset += n
        self.n += 1

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        while len(ids) >= 4 * LENGTH:
            self.emit([(doc, start, ids[: 4 * LENGTH], total)])
            start, ids = start + LENGTH, ids[4 * LENGTH :]
        while ids:
            n = len(ids) // 4
            fits = [(LENGTH - fill, k) for k, (fill, _) in enumerate(self.open) if fill + n <= LENGTH]
            if fits:
                k = min(fits)[1]
                fill, pieces = self.open[k]
                pieces.append((doc, start, ids, total))
                self.open[k] = (fill + n, pieces)
                ids = b""
                if fill + n == LENGTH:
                    self.emit(self.open.pop(k)[1])
            elif len(self.open) < self.windows:
                self.open.append((n, [(doc, start, ids, total)]))
                ids = b""
            else:
                k = max(range(len(self.open)), key=lambda k: self.open[k][0])
                fill, pieces = self.open.pop(k)
                room = LENGTH - fill
                self.emit([*pieces, (doc, start, ids[: 4 * room], total)])
                start, ids = start + room, ids[4 * room :]

    def close(self) -> None:
        """Nothing comes after this: run the open windows together, and cut what is left at powers of two."""
        left = [p for _, pieces in self.open for p in pieces]
        self.open = []
        total = sum(len(p[2]) for p in left) // 4
        while total:
            size = LENGTH if total >= LENGTH else 1 << total.bit_length() - 1
            total -= size
            sequence = []
            while size:
                doc, start, ids, tokens = left.pop(0)
                n = min(size, len(ids) // 4)
                sequence.append((doc, start, ids[: 4 * n], tokens))
                if n < len(ids) // 4:
                    left.insert(0, (doc, start + n, ids[4 * n :], tokens))
                size -= n
            self.emit(sequence)

    def rows(self, part: int | None = None) -> pa.RecordBatch:
        """What is done since the last call; with ``part``, the open windows too, under that number."""
        rows, self.done = self.done, []
        if part is not None:
            for fill, pieces in sorted(self.open, key=lambda w: -w[0]):
                rows += [(doc, start, len(ids) // 4, None, total, None, None, part, ids) for doc, start, ids, total in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(PIECE), PIECE, strict=True)], schema=PIECE)


def packed(docs: DataFrame, tokenizer: str | None = None, windows: int = WINDOWS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer`` is the path of a file
    that ``tokenizers`` reads, and must exist on all machines; it must drop white space and end words as ``</w>``."""
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, packer = Words(path), Packer(part << 32, windows)
        for batch in row_slices(batches, 1, TOGETHER):
            texts = [(t or b"").decode("utf-8", "replace") for t in binary_values(batch.column(1))]
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
                ids += END.to_bytes(4, "little")
                packer.add(doc, 0, ids, len(ids) // 4)
            yield packer.rows()
        yield packer.rows(part)

    def merging(level: int, last: bool, fan: int):  # noqa: ANN202
        def merge(table: pa.Table) -> pa.Table:
            group = table.column("part")[0].as_py() // fan
            packer = Packer((level << 56) | (group << 32), windows)
            rows = table.select(["part", "doc_id", "start", "ids", "doc_tokens"]).to_pylist()
            for r in sorted(rows, key=lambda r: (-len(r["ids"]), r["part"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids"])):
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            if last:
                packer.close()
            return pa.Table.from_batches([packer.rows(None if last else group)])

        return merge

    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(first), SCHEMA), "pieces")
    out = rows.where("sequence_id is not null")
    left, level = rows.where("ids is not null"), 1
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = parts <= FAN
        left = left.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merging(level, last, FAN), SCHEMA)
        if not last:
            left = staged(left, "pieces")
        out = out.unionByName(left.where("sequence_id is not null"))
        if last:
            return out.drop("part", "ids")
        left, parts, level = left.where("ids is not null"), -(-parts // FAN), level + 1


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows: 13 consecutive item words, or the whole item where it has fewer. Windows of one length
form a searcher: a shift table on the last two words of the search window tells how far it may skip, a zero shift leads to
the bucket of that word pair, and direct comparison confirms an occurrence. Words are compared as UTF-8 bytes.

The windows travel to the tasks only in blocks of at most ``BLOCK`` windows. A benchmark of one block is one narrow pass; a
longer one is searched block by block, the hits so far riding along in staged rows, so that neither the driver nor a task ever
holds two blocks.

Cases: null, empty and wordless texts have n_words 0 and are never contaminated; items without words give no window;
repeated items are both reported; repeated rows each give a row; null item_ids are left out of the digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import binary_values, discard, read, row_slices, staged, tidy

WINDOW = 13
#: Windows sent to the tasks at once: about 100 MB in a Python worker.
BLOCK = 200_000
# What separates words becomes a blank, A-Z becomes a-z; every byte from 0x80 up belongs to a word.
TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of text whose words are split at once.
PIECE = 4_000_000
HITS, ITEMS = pa.list_(pa.int32()), pa.list_(pa.int64())


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def windows_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))]


class WuManber:
    """Occurrences of patterns that all have ``length`` words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.patterns, self.block = length, patterns, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        # A bucket is a set: many windows that end alike cost a comparison no more than one does.
        self.bucket: dict[tuple[bytes, ...], set[tuple[bytes, ...]]] = {}
        for pattern in patterns:
            for end in range(self.block, length + 1):
                pair = pattern[end - self.block : end]
                self.shift[pair] = min(self.shift.get(pair, self.most), length - end)
            self.bucket.setdefault(pattern[-self.block :], set()).add(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        end, length, shift, most = self.length, self.length, self.shift, self.most
        if self.block == 1:
            for i, w in enumerate(words):
                if (w,) in self.patterns:
                    yield i, (w,)
            return
        while end <= len(words):
            skip = shift.get((words[end - 2], words[end - 1]), most)
            if skip:
                end += skip
                continue
            found = tuple(words[end - length : end])
            if found in self.bucket[found[-2:]]:
                yield end - length, found
            end += 1


def searchers(items: list[tuple[int | None, bytes | None]]) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        for window in windows_of(words_of(text)):
            owners = by_length.setdefault(len(window), {}).setdefault(window, [])
            if item is not None and item not in owners:
                owners.append(item)
    return [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]


def find_hits(text: bytes | None, tables: list[WuManber]) -> tuple[int, list[int], list[int]]:
    """Number of words; [start, end, ...] of the merged stretches of hit words; ids of the items found."""
    words, ranges, items = words_of(text), [], set()
    for table in tables:
        for start, pattern in table.search(words):
            ranges.append((start, start + table.length))
            items.update(table.patterns[pattern])
    return len(words), merged(ranges), sorted(items)


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The items, a bounded number of windows at a time."""
    block, windows = [], 0
    for item, text in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        raw = text.encode() if text is not None else None
        n = len(windows_of(words_of(raw)))
        if block and windows + n > most:
            yield block
            block, windows = [], 0
        block.append((item, raw))
        windows += n
    yield block


Finish = Callable[[pa.RecordBatch, list[list[int]], list[list[int]], list[int]], pa.RecordBatch]


def passes(docs: DataFrame, benchmark: DataFrame, most: int, finish: Finish, schema: str) -> DataFrame:
    """``finish`` (batch, hits, items, numbers of words) over all rows of ``docs``, once all blocks were searched for."""
    place, names = docs.columns.index("text"), docs.columns
    rows, waiting = docs, blocks(benchmark, most)
    block, more = next(waiting), None
    while True:
        more = next(waiting, None)

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int | None, bytes | None]] = block, last: bool = more is None) -> Iterator[pa.RecordBatch]:
            tables = searchers(block)
            for batch in row_slices(batches, place, PIECE):
                n_words, hits, items = [], [], []
                for text in binary_values(batch.column(place)):
                    n, h, i = find_hits(text, tables)
                    n_words.append(n), hits.append(h), items.append(i)
                if batch.num_columns > len(names):  # found in earlier blocks
                    before = zip(hits, items, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)
                    united = [(merged([*pairs_of(h), *pairs_of(g)]), sorted({*i, *j})) for h, i, g, j in before]
                    hits, items = [h for h, _ in united], [i for _, i in united]
                own = pa.RecordBatch.from_arrays(batch.columns[: len(names)], schema=pa.schema([batch.schema.field(i) for i in range(len(names))]))
                if last:
                    yield finish(own, hits, items, n_words)
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hits, HITS), pa.array(items, ITEMS)], [*names, "__hits", "__items"])

        if more is None:
            return rows.mapInArrow(tidy(run), schema)
        carried = docs.withColumns({"__hits": F.array().cast("array<int>"), "__items": F.array().cast("array<long>")}).schema
        new = staged(rows.mapInArrow(tidy(run), carried), "hits")
        if rows is not docs:
            discard(rows)
        rows, block = new, more


def pairs_of(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def search(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, hits ([start, end, ...] in words) and items (ids), a row for each row."""

    def finish(batch: pa.RecordBatch, hits: list[list[int]], items: list[list[int]], n_words: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, HITS), pa.array(items, ITEMS)], ["doc_id", "n_words", "hits", "items"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return passes(table, benchmark, most, finish, "doc_id long, n_words long, hits array<int>, items array<long>")


def verdicts(found: DataFrame) -> DataFrame:
    """The search's rows with n_hit, n_items, the digest of item ids and the contamination rule: 5 % of the words hit."""
    lengths = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(lengths, F.lit(0), lambda a, x: a + x).cast("long")
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that the rule leaves, all columns: for a benchmark of one block a single narrow pass.

    Null, empty and wordless texts stay, repeated rows go or stay alike, other columns ride along whatever their names.
    """

    def finish(batch: pa.RecordBatch, hits: list[list[int]], items: list[list[int]], n_words: list[int]) -> pa.RecordBatch:
        n_hit = [sum(h[1::2]) - sum(h[::2]) for h in hits]
        return batch.filter(pa.array([not k or 20 * k < n for k, n in zip(n_hit, n_words, strict=True)], pa.bool_()))

    return passes(docs, benchmark, most, finish, docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP8_SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
p AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
h AS (SELECT p.r, p.i, p.n, win.item_id FROM p JOIN win ON p.win = win.win AND p.n = win.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

"""Language identification by compression.

Each language has a raw-content zstandard dictionary, slices of its training texts. A text is lower-cased, cut into pieces of
``PIECE`` bytes, and every piece is compressed with every language's dictionary; the language whose sizes add up to the least
wins. ``accepted`` is false where the runner-up comes within ``MARGIN`` of it: the margin is too narrow to trust.

Fitted on a bounded sample: ``DOCS`` documents of each language (of the ``LANGUAGES`` most frequent), a slice of ``SLICE`` characters
from each, whole in any script. A dictionary need not hold more of a text: what tells languages apart are letter sequences that
occur all over it, and 200 places of 300 characters show them; a longer one slows every text down. The dictionaries are all that goes to the tasks: about 60 kB for a learned language in ASCII, 240 kB at most.

Cases: a null text, or one without a letter, is ``und`` with score 0 and not accepted; so is every text if nothing could be
learned; repeated rows each give a row; a null doc_id is predicted but never learned from; whole texts are compressed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry.llm.common import crc_mod, held_out, read, row_slices, tidy

DOCS, SLICE = 200, 300
#: Languages that are learned at most, the most frequent ones: as many dictionaries go to the tasks (240 kB each at most).
LANGUAGES = 400
PIECE = 1024
LEVEL = 7
MARGIN = 0.01
LETTER = re.compile(r"[^\W\d_]")


def train(docs: DataFrame, docs_each: int = DOCS, slice_chars: int = SLICE) -> dict[str, bytes]:
    """Dictionaries by language from ``docs`` (doc_id, text, lang), the rows already fit to learn from.

    Of each language the rows with the smallest hashes of id and text are taken, equal slices once, from those below a bound set
    by its number of distinct rows: no group is gathered whole, neither a language nor an id with very many rows.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.03).alias("n"))
    counts = {r["lang"]: r["n"] for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    spread = 1 << 40
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread))
    bound = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(spread * min(1, 1.5 * docs_each / max(1, n)))))), F.col("lang"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.greatest(F.length("text") - slice_chars, F.lit(1))).cast("int") + 1
    drawn = known.where(draw < bound).select("lang", draw.alias("d"), "doc_id", F.lower(F.substring("text", start, F.lit(slice_chars))).alias("t")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("d", "doc_id", "t"))
    rows = drawn.withColumn("p", place).where(F.col("p") <= docs_each).collect()
    out = {}
    for lang in sorted(counts):
        joined = "\n".join(r["t"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["d"], r["doc_id"])))
        if len(raw := joined.encode()) >= 8:
            out[lang] = raw
    return out


class Sizer:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for raw in dictionaries.values():
            words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.coders or not LETTER.search(text):
            return "und", 0.0, False
        raw = text.lower().encode()
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        best = sizes[order[0]]
        weights = [math.exp(-min(700.0, 0.5 * (s - best))) for s in sizes]
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return self.langs[order[0]], 1 / sum(weights), margin >= MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), accepted of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for batch in row_slices(batches, 1, 4_000_000):
            rows = [sizer.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, accepted boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, train(docs.where(crc_mod(F.col("doc_id"), 4) != 2)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "accepted")

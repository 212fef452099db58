"""Content digests and perceptual hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions.paths import as_column

WINDOW = 16 * 1024


def partial_key(text: Column | str, size: Column | str, window: int = WINDOW) -> Column:
    """A digest of the size and both ends of a content column; of all of it where the ends meet."""
    text, size = as_column(text), as_column(size)
    ends = F.concat(F.substring(text, 1, window), F.substr(text, F.greatest(F.char_length(text) - window + 1, F.lit(1))))
    return F.md5(F.concat(size.cast("string"), F.lit(":"), F.when(size <= 2 * window, text).otherwise(ends)))


def full_key(text: Column | str) -> Column:
    return F.sha2(as_column(text), 256)


def hash_files(files: DataFrame, window: int | None, chunk: int = 256 * 1024) -> DataFrame:
    """path, size, digest, error of ``files`` (path, size), read where they lie, in chunks; ``window`` null reads all.

    The digest of a window covers the size and both ends. A size that changed since the scan is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os

        import xxhash

        for batch in batches:
            out = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                digest, error = None, None
                try:
                    with open(path, "rb") as f:
                        if os.fstat(f.fileno()).st_size != size:
                            raise OSError("size changed since the scan")
                        if window is None:
                            h = hashlib.sha256()
                            while block := f.read(chunk):
                                h.update(block)
                        else:
                            h = xxhash.xxh3_128(int(size).to_bytes(8, "little"))
                            if size <= 2 * window:
                                h.update(f.read())
                            else:
                                h.update(f.read(window))
                                f.seek(-window, os.SEEK_END)
                                h.update(f.read(window))
                        digest = h.hexdigest()
                except OSError as e:
                    error = str(e)
                out.append((path, size, digest, error))
            yield pd.DataFrame(out, columns=["path", "size", "digest", "error"])

    return files.select("path", "size").mapInPandas(run, "path string, size long, digest string, error string")


def bits(values: Column, n: int) -> Column:
    """The first ``n`` booleans of an array as a number, the first one lowest."""
    powers = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(n)))
    numbered = F.zip_with(F.slice(values, 1, n), powers, lambda x, p: F.when(x, p).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(numbered, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def gradient_hash(vector: Column | str, n: int = 63) -> Column:
    """Bit i tells whether component i is below its successor."""
    v = as_column(vector)
    rising = F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda a, b: a < b)
    return bits(rising, n)


def mean_hash(vector: Column | str, n: int = 64) -> Column:
    """Bit i tells whether component i is above the mean of the first n."""
    v = F.slice(as_column(vector), 1, n)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.lit(float(n))
    return bits(F.transform(v, lambda x: x.cast("double") > mean), n)


def cosine_hash(values: Column | str, n: int, side: int = 8) -> Column:
    """The ``mean_hash`` of the ``side`` by ``side`` lowest frequencies of an ``n`` by ``n`` matrix, given row by row.

    Frequencies are those of the cosine transform, vertical ones outside. Null unless there are n * n values.
    """
    basis = F.array(*(F.array(*(F.lit(math.cos(math.pi * (2 * x + 1) * k / (2 * n))) for x in range(n))) for k in range(side)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    once = lambda value, use: F.transform(F.array(value), use)[0]
    lines = lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.transform(basis, lambda b: dot(F.slice(v, r * n + 1, n), b)))
    low = lambda half: F.flatten(F.transform(basis, lambda b: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: dot(F.transform(half, lambda h: F.get(h, j)), b))))
    v = as_column(values).cast("array<double>")
    return F.when(F.size(v) == n * n, once(once(lines(v), low), lambda x: mean_hash(x, side * side)))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(as_column(a).bitwiseXOR(as_column(b))).cast("int")

"""URL filters as a sort-merge range join.

A url's key is its host's labels in reverse, each ended by ``\\x01``, then its path, so a rule's host is a prefix and the urls
of that host and its subdomains are one interval of keys. Urls and rules are dealt over the same ranges of keys, cut at
quantiles of the urls (a salt from the row's place, not its values, cuts even a hot key of repeated rows); a rule goes to every range that its interval touches: its own,
plus one row for each further range, which only the few rules nested around a range's border need. Each range is sorted and
swept once with a stack of the hosts whose intervals are open; the rules on the stack are the only ones that can fit, and the
longest (host and path together; then the longer host) whose path starts the url's path wins.

Cases: a null url or one without ``://`` has empty host and path, which no rule fits; the verdict is then the default;
repeated rows each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import read

END = "\x01"
AFTER = "\x02"
#: Urls in a range, about; a range's rows stream through one task, sorted by Spark, which spills. No more than ``RANGES``
#: ranges are made, so borders and their sample (``SAMPLES`` rows a range) stay under 25 MB; they grow in rows instead.
RANGE_ROWS, RANGES, SAMPLES = 100_000, 4_096, 20
EXAMPLE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ROW = "pid int, key string, salt long, page_id long, host string, path string, verdict string"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, key, salt."""
    split = r"://([^/?#]*)([^?#]*)"
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    url = F.coalesce("url", F.lit(""))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), ascii_lower(F.regexp_extract(url, split, 1)).alias("host"), F.regexp_extract(url, split, 2).alias("path"))
    return out.withColumns({"key": host_key(F.col("host"), F.col("path")), "salt": F.xxhash64(F.monotonically_increasing_id())})


def host_key(host, path):  # noqa: ANN001, ANN201 (columns)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END), path)


def cuts(urls: DataFrame) -> list[tuple[str, int]]:
    """Borders of the key ranges from a sample of rows: about ``SAMPLES`` a range, keys cut to 300 characters."""
    rows = urls.count()
    ranges = min(RANGES, -(-rows // RANGE_ROWS))
    if ranges < 2:
        return []
    every = max(1, rows // (ranges * SAMPLES))
    sample = urls.where(F.pmod(F.xxhash64("salt"), F.lit(every)) == 0).select(F.substring("key", 1, 300), "salt").collect()
    sample = sorted((r[0], r[1]) for r in sample)
    return [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []


class Sweep:
    """The open hosts, outermost first: [end of interval, host, {path: verdict}, lengths of its paths]."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and key >= self.stack[-1][0]:
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][1] != host:
            self.stack.append((key[:-1] + AFTER, host, {}, []))
        paths, lengths = self.stack[-1][2:]
        paths.setdefault(path, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def fit(self, key: str, host: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        best, found = (-1, -1), (None, None)
        for _, at, paths, lengths in reversed(self.stack):
            if host != at and not host.endswith("." + at):
                continue
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])) is not None:
                    if (len(at) + n, len(at)) > best:
                        best, found = (len(at) + n, len(at)), (at + path[:n], hit)
                    break
        return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url); ``rules`` are (verdict, host, path).

    Of rules with the same host and path the one with the smaller verdict (allow before block) counts.
    """
    urls = parsed(pages)
    borders = cuts(urls)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pids = [bisect_right(borders, (k, s)) for k, s in zip(keys, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), *batch.columns, pa.nulls(len(pids), pa.string())], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last = bisect_right(borders, (key, -(1 << 63))), bisect_right(borders, (key[:-1] + AFTER, -(1 << 63)))
                rows += [(p, key, None, None, host, path, verdict) for p in range(first, last + 1)]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pid = Sweep(), None
        for batch in batches:
            out = []
            for p, key, _, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != pid:
                    state, pid = Sweep(), p
                if verdict is not None:
                    state.open(key, host, path, verdict)
                else:
                    out.append((page, host, path, *state.fit(key, host, path)))
            columns = [pa.array([r[i] for r in out], pa.int64() if i == 0 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    names = ["pid", "key", "salt", "page_id", "host", "path", "verdict"]
    own = urls.select("key", "salt", "page_id", "host", "path").mapInArrow(dealt, ROW)
    laid = rules.select(host_key(F.col("host"), F.lit("")).alias("key"), "host", "path", "verdict").mapInArrow(spread, ROW)
    # A rule's key is its interval's first key and its salt is null, so it sorts before every url that it fits.
    both = own.unionByName(laid).repartition(len(borders) + 1, "pid").sortWithinPartitions("pid", "key", F.col("salt").asc_nulls_first(), "path", "verdict")
    found = both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(EXAMPLE_RULES, "verdict string, host string, path string")
    return judge(read(spark, sf_dir, "pages"), rules)


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS r
  FROM pages
),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (r)
"""

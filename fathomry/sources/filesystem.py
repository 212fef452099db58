"""Filesystems as tables of entries: scans by a frontier of directories, in batch and as a stream, and mounted volumes.

A scan lists in rounds. The work of a round is a table of directories (and of parts of very large ones), dealt over tasks; a
task goes down from its directories until it has seen ``BUDGET`` entries and hands back what it hasn't listed as the next
round's work. The driver looks at the roots alone. A directory's own row is made by whoever lists it, so an error of listing is
part of it and no row has to be settled afterwards.
"""

from __future__ import annotations

import json
import os
import re
import stat
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fathomry.functions import paths as P
from fathomry.functions.globs import compiled
from fathomry.operators.graph import removed, shared_folder
from fathomry.schemas import ENTRY

#: Virtual filesystems that are never walked.
DEFAULT_EXCLUDED = ["/proc", "/sys", "/dev", "/run"]
#: Entries that a task sees in a round before it hands the rest back, and names of one directory that are looked at together.
BUDGET, CHUNK = 20_000, 5_000
FIELDS = [c.split() for c in ENTRY.replace("\n", " ").split(",")]
LINK = "struct<apparent bigint, allocated bigint, nlink bigint, dev bigint, ino bigint, mtime bigint, mtime_nanos int>"
#: Rows of a round: entries, and work (``work``) for the next: directories, or names of one to look at.
FOUND = f"{ENTRY}, work boolean, root_dev bigint, names array<string>, link {LINK}"


def mode_kind(mode: int) -> str:
    return "Dir" if stat.S_ISDIR(mode) else "File" if stat.S_ISREG(mode) else "Symlink" if stat.S_ISLNK(mode) else "Other"


class Lister:
    """Lists directories by the options of a scan. Rows are tuples of FOUND."""

    def __init__(self, options: dict, budget: int = BUDGET, chunk: int = CHUNK):
        self.paths = set(options.get("exclude_paths", DEFAULT_EXCLUDED))
        self.globs = [re.compile(r) for r in compiled(options.get("exclude_globs", []))[0]]
        self.follow, self.cross = options.get("follow_symlinks", False), options.get("cross_filesystems", False)
        self.budget, self.chunk = budget, chunk

    def excluded(self, path: str, name: str) -> bool:
        return path in self.paths or any(g.match(path) or g.match(name) for g in self.globs)

    @staticmethod
    def measures(s: os.stat_result) -> tuple:
        secs, nanos = divmod(abs(s.st_mtime_ns), 1_000_000_000)
        return s.st_size, s.st_blocks * 512, s.st_nlink, s.st_dev, s.st_ino, secs if s.st_mtime_ns >= 0 else -secs, nanos

    def entry(self, root: str, root_dev: int, path: str, name: str) -> tuple:
        """The row of a path: an entry, or work if it is a directory to be listed. When links are followed, one to a directory
        is such work too and keeps the measures of the link itself; all other links stay links."""
        link = None
        try:
            s = os.lstat(path)
            if stat.S_ISLNK(s.st_mode) and self.follow:
                try:
                    target = os.stat(path)
                except OSError:
                    target = s  # a dangling link
                if stat.S_ISDIR(target.st_mode):
                    link, s = self.measures(s), target
        except OSError as e:
            return (root, path, name, "Other", 0, 0, 0, None, None, 0, 0, False, False, str(e), False, root_dev, None, None)
        kind = mode_kind(s.st_mode)
        away = kind == "Dir" and s.st_dev != root_dev and not self.cross
        return (root, path, name, kind, *self.measures(s), False, away, None, kind == "Dir" and not away, root_dev, None, link)

    def listed(self, row: tuple) -> Iterator[tuple]:
        """The row of a directory, now an entry, and those of its children; further names of a very large one are work."""
        root, path, root_dev, names = row[0], row[1], row[15], row[16]
        if names is None:
            try:
                with os.scandir(path) as found:
                    names = sorted(c.name for c in found)
            except OSError as e:
                yield (*row[:13], str(e), False, *row[15:])
                return
            yield (*row[:14], False, *row[15:])
            for at in range(self.chunk, len(names), self.chunk):
                yield (*row[:14], True, root_dev, names[at : at + self.chunk], None)
            names = names[: self.chunk]
        for name in names:
            child = os.path.join(path, name)
            if not self.excluded(child, name):
                yield self.entry(root, root_dev, child, name)

    def walk(self, work: Iterable[tuple]) -> Iterator[tuple]:
        """Entries, and what is left as work once the budget is spent. Where links are followed each round is one level, as
        the round decides which of several ways to a directory counts."""
        todo, seen = list(work)[::-1], 0
        deeper = not self.follow
        while todo and seen < self.budget:
            for row in self.listed(todo.pop()):
                seen += 1
                if not row[14]:
                    yield row
                elif deeper and row[16] is None:
                    todo.append(row)
                else:
                    yield row
        yield from todo

    def roots(self, roots: list[str], leaves: bool = False) -> list[tuple]:
        """Work of the first round. A root that can't be read is an error, and so is one that is no directory, unless
        ``leaves`` makes it an entry (links not followed)."""
        if not roots:
            raise ValueError("no roots to scan")
        out = []
        for root in dict.fromkeys(map(os.path.abspath, roots)):
            s = os.lstat(root)
            if leaves and not stat.S_ISDIR(s.st_mode):
                out.append((*Lister({}).entry(root, s.st_dev, root, os.path.basename(root))[:14], False, s.st_dev, None, None))
                continue
            os.listdir(root)
            s = os.stat(root)
            out.append((root, root, os.path.basename(root) or root, "Dir", *self.measures(s), False, False, None, True, s.st_dev, None, None))
        return out


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*some, strict=True) if some else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array([dict(zip(f.type.names, v, strict=True)) if v else None for v in c] if f.name == "link" else list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield made()
            some = []
    yield made()


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    link = pa.struct([(n, pa.int64()) for n in ("apparent", "allocated", "nlink", "dev", "ino", "mtime")] + [("mtime_nanos", pa.int32())])
    return pa.schema([(n, kinds[k]) for n, k in FIELDS] + [("work", pa.bool_()), ("root_dev", pa.int64()), ("names", pa.list_(pa.string())), ("link", link)])


def first_ways(work: DataFrame, visited: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Work whose directory no earlier round listed, one way to each (the first path); and the entries of the other ways: a link
    stays a link, a directory a leaf. Parts of a large directory pass."""
    ways = work.where("names is null")
    place = F.struct(P.parts("path").alias("p"), F.col("root").alias("r"))
    best = ways.groupBy("dev", "ino").agg(F.min(place).alias("best"))
    if visited is not None:
        best = best.join(visited, ["dev", "ino"], "left_anti")
    told = ways.join(best, ["dev", "ino"], "left").withColumn("first", F.coalesce(place == F.col("best"), F.lit(False)))
    own = {c: F.when(F.col("link").isNull(), F.col(c)).otherwise(F.col(f"link.{c}")) for c in ("apparent", "allocated", "nlink", "dev", "ino", "mtime", "mtime_nanos")}
    columns = [n for n, _ in FIELDS]
    leaves = told.where("not first").withColumns(own | {"kind": F.when(F.col("link").isNull(), "Dir").otherwise("Symlink")}).select(*columns)
    return told.where("first").select(*work.columns).unionByName(work.where("names is not null")), leaves


def scan(spark: SparkSession, roots: list[str], exclude_paths: list[str] | None = None, exclude_globs: list[str] | None = None, follow_symlinks: bool = False, cross_filesystems: bool = False, leaf_roots: bool = False) -> DataFrame:
    """Entries of the roots, listed now. An unreadable directory is one row with its error. When links are followed, a directory
    that several ways lead to is listed once: by the way of the fewest steps, the first path among these. A root that
    is no directory is an error, or with ``leaf_roots`` one row, links not followed.

    Each round's rows are written to the shared folder; they go when the driver ends.
    """
    options = {"exclude_paths": DEFAULT_EXCLUDED + (exclude_paths or []), "exclude_globs": exclude_globs or [], "follow_symlinks": follow_symlinks, "cross_filesystems": cross_filesystems}
    first, schema, budget, chunk = Lister(options).roots(roots, leaf_roots), arrow_schema(), BUDGET, CHUNK
    place = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    removed(spark, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lister = Lister(options, budget, chunk)
        work = [tuple(tuple(v.values()) if isinstance(v, dict) else v for v in r.values()) for b in batches for r in b.to_pylist()]
        yield from batches_of(lister.walk(work), schema)

    start = spark.createDataFrame([r for r in first if r[14]], FOUND)
    entries = lambda rows: rows.select(*(n for n, _ in FIELDS))
    entries(spark.createDataFrame([r for r in first if not r[14]], FOUND)).write.parquet(f"{place}/rows/round=0")
    work, number = start, 1
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    visited = None
    while not work.isEmpty():
        if follow_symlinks:
            work, leaves = first_ways(work, visited)
            leaves.write.parquet(f"{place}/rows/round={number}")
            work.where("names is null").select("dev", "ino").write.parquet(f"{place}/visited/round={number}")
            visited = spark.read.schema("dev bigint, ino bigint").parquet(f"{place}/visited")
            number += 1
        work.repartition(tasks).mapInArrow(run, FOUND).write.parquet(f"{place}/found/round={number}")
        found = spark.read.schema(FOUND).parquet(f"{place}/found/round={number}")
        work, number = found.where("work"), number + 1
    listed = spark.read.schema(f"{FOUND}, round int").option("basePath", f"{place}/found").parquet(f"{place}/found").where("not work") if number > 1 else start.limit(0)
    leaves = spark.read.schema(f"{ENTRY}, round int").option("basePath", f"{place}/rows").parquet(f"{place}/rows")
    return entries(listed).unionByName(entries(leaves))


class Share(InputPartition):
    """A file of work, and the number of what it leads to."""

    def __init__(self, round_: int, file: str, number: int):
        self.round, self.file, self.number = round_, file, number


class LiveReader(DataSourceStreamReader):
    """Offsets are rounds of the frontier, which lies in a folder that all machines share (``state``).

    A round's tasks each list one file of its work, and write what is left as files of the next round's, then a mark that
    they are done. The next round is there once all marks are; a batch that is repeated writes the same files again.
    """

    def __init__(self, options: dict[str, str]):
        flag = lambda name: str(options.get(name, "false")).lower() == "true"
        if flag("follow_symlinks"):
            raise ValueError("a live scan doesn't follow links: use scan")
        self.roots = json.loads(options["roots"])
        self.options = {"exclude_paths": json.loads(options.get("exclude_paths", json.dumps(DEFAULT_EXCLUDED))), "exclude_globs": json.loads(options.get("exclude_globs", "[]")), "cross_filesystems": flag("cross_filesystems")}
        self.budget, self.chunk = int(options.get("budget", BUDGET)), int(options.get("chunk", CHUNK))
        self.state = options["state"]

    def store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.state) if "://" in self.state else (pafs.LocalFileSystem(), self.state)

    def files(self, round_: int, kind: str) -> list[str]:
        store, base = self.store()
        found = store.get_file_info(pafs.FileSelector(f"{base}/{round_}", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.startswith(kind))

    def put(self, name: str, rows: list) -> None:
        """Whole or not at all."""
        store, base = self.store()
        store.create_dir(os.path.dirname(f"{base}/{name}"), recursive=True)
        fresh = f"{base}/{os.path.dirname(name)}/new-{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write("\n".join(map(json.dumps, rows)).encode())
        store.move(fresh, f"{base}/{name}")

    def get(self, path: str) -> list[tuple]:
        with self.store()[0].open_input_stream(path) as f:
            return [tuple(json.loads(line)) for line in f.read().decode().split("\n") if line]

    def initialOffset(self) -> dict:  # noqa: N802
        if not self.files(0, "work"):
            self.put("0/work-0-0.json", Lister(self.options).roots(self.roots, True))
        return {"round": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Up to the first round that is empty or whose work isn't all there yet."""
        n = 0
        while (n == 0 or len(self.files(n, "done")) == len(self.files(n - 1, "work"))) and self.files(n, "work"):
            n += 1
        return {"round": n}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(n, f, k) for n in range(start["round"], end["round"]) for k, f in enumerate(self.files(n, "work"))]

    def read(self, partition: Share) -> Iterator[tuple]:
        rest: list[tuple] = []
        for row in Lister(self.options, self.budget, self.chunk).walk(r for r in self.get(partition.file) if r[14]):
            if row[14]:
                rest.append(row)
            else:
                yield row[: len(FIELDS)]
        if partition.round == 0:
            yield from (r[: len(FIELDS)] for r in self.get(partition.file) if not r[14])
        share = max(1, min(1000, len(rest) // 8))
        for j, at in enumerate(range(0, len(rest), share)):
            self.put(f"{partition.round + 1}/work-{partition.number}-{j}.json", rest[at : at + share])
        self.put(f"{partition.round + 1}/done-{partition.number}.json", [])


class EntrySource(DataSource):
    """``spark.readStream.format("fsentries")``. Options: ``roots``, ``exclude_paths``, ``exclude_globs`` (JSON lists),
    ``cross_filesystems``, ``state`` (a folder of the shared store), ``budget`` and ``chunk``."""

    @classmethod
    def name(cls) -> str:
        return "fsentries"

    def schema(self) -> str:
        return ENTRY

    def streamReader(self, schema) -> LiveReader:  # noqa: ANN001, N802
        return LiveReader(self.options)


def live_scan(spark: SparkSession, roots: list[str], state: str, **options: object) -> DataFrame:
    """A stream of the entries of the roots, a round of the frontier a batch; ``state`` is the stream's own folder."""
    spark.dataSource.register(EntrySource)
    reader = spark.readStream.format("fsentries").option("roots", json.dumps(roots)).option("state", state)
    for name, value in options.items():
        reader = reader.option(name, json.dumps(value) if isinstance(value, list) else str(value))
    return reader.load()


def volumes(spark: SparkSession, table: str = "/proc/mounts") -> DataFrame:
    """Mounted volumes with their capacity, by mount point, one row each."""
    # Filesystems of the network.
    network = {"nfs", "nfs4", "cifs", "smb3", "smbfs", "afpfs", "fuse.sshfs", "9p", "ceph"}
    found: dict[str, tuple] = {}
    with open(table) as f:
        for line in f:
            device, mount, fs = line.split()[:3]
            mount = mount.replace("\\040", " ")
            try:
                s = os.statvfs(mount)
            except OSError:
                continue
            if s.f_blocks:
                found[mount] = (mount, device, fs, s.f_blocks * s.f_frsize, s.f_bavail * s.f_frsize, fs in network)
    from fathomry.schemas import VOLUME

    return spark.createDataFrame([found[m] for m in sorted(found)], VOLUME)

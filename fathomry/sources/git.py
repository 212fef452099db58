"""What Git knows of the repositories of a scan: tracked paths and the time of the last commit, asked of ``git`` in tasks.

One row of work is one repository, dealt over tasks; each task runs two read-only commands in it and streams their output.
Repositories are untrusted: hooks, file system monitors and prompts of their configuration are switched off, and a command ends
after ``SECONDS``. Where ``git`` is missing, or a repository is broken, there is an error row and no answer, never a failed scan.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.operators.graph import staged

ANSWER = "repo string, tracked string, last_commit bigint, error string"
SECONDS = 60
SAFE = ["-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-c", "safe.directory=*", "--no-optional-locks"]


def repositories(entries: DataFrame) -> DataFrame:
    """repo: directories that hold a ``.git`` (a directory, or a file of a work tree)."""
    return entries.where(P.name("path") == ".git").select(P.parent("path").alias("repo")).where("repo is not null").distinct()


def asked(repo: str, *command: str) -> bytes:
    """A command's output; ValueError with Git's own words if it fails."""
    env = {"PATH": os.environ.get("PATH", ""), "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "HOME": "/nonexistent", "LC_ALL": "C"}
    try:
        done = subprocess.run(["git", "-C", repo, *SAFE, *command], capture_output=True, timeout=SECONDS, env=env, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise ValueError(str(e)) from e
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip().splitlines()[-1] if done.stderr.strip() else f"exit code {done.returncode}")
    return done.stdout


def answers(repos: DataFrame) -> DataFrame:
    """ANSWER rows: one a tracked path (absolute), one with the last commit of a repository that has any, one an error."""
    schema = pa.schema([("repo", pa.string()), ("tracked", pa.string()), ("last_commit", pa.int64()), ("error", pa.string())])

    def rows(repo: str) -> Iterator[tuple]:
        try:
            names = asked(repo, "ls-files", "-z").split(b"\0")
            yield from ((repo, f"{repo.rstrip('/')}/{n.decode('utf-8', 'replace')}", None, None) for n in names if n)
            if asked(repo, "for-each-ref", "--count=1") or asked(repo, "rev-list", "-n1", "--all"):
                yield repo, None, int(asked(repo, "log", "-1", "--format=%ct")), None
        except ValueError as e:
            yield repo, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo in batch.column(0).to_pylist():
                some = list(rows(repo))
                for at in range(0, len(some), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)

    tasks = 2 * repos.sparkSession.sparkContext.defaultParallelism
    return staged(repos.select("repo").repartition(tasks).mapInArrow(run, ANSWER), "git")


def tracked(found: DataFrame) -> DataFrame:
    """path of every tracked file and of every directory that holds one, inside its repository."""
    files = found.where("tracked is not null")
    spread = files.select("repo", F.explode(P.prefixes("tracked", 1)).alias("path"))
    return spread.where(F.length("path") > F.length("repo")).select("path").distinct()


def commits(found: DataFrame, rows: DataFrame) -> DataFrame:
    """path, last_commit of the rows (path) that lie in a repository: the nearest one at or above counts."""
    heads = found.where("last_commit is not null").select(F.col("repo").alias("dir"), "last_commit")
    above = rows.select("path").distinct().select("path", F.explode(P.prefixes("path", 1)).alias("dir"))
    near = above.join(found.select(F.col("repo").alias("dir")).distinct(), "dir").groupBy("path").agg(F.max_by("dir", P.depth("dir")).alias("dir"))
    return near.join(heads, "dir").select("path", "last_commit")

"""What Git knows, from repositories made here."""

import json
import os
import shutil
import subprocess

import pytest

from fathomry import cli
from fathomry.operators import buildtrees
from fathomry.sources import git
from fathomry.sources.filesystem import scan
from fathomry.sources.rules import builtin

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git")


def run(where, *command, when=1_600_000_000):
    env = {"PATH": os.environ["PATH"], "HOME": str(where), "GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "GIT_CONFIG_NOSYSTEM": "1"}
    subprocess.run(["git", "-C", where, "-c", "user.name=a", "-c", "user.email=a@b", *command], check=True, env=env, capture_output=True)


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_tracked_paths_and_commits(spark, tmp_path):
    for name in ("one", "two", "empty", "broken"):
        (tmp_path / name).mkdir()
        run(tmp_path / name, "init", "-q")
    for name in ("Cargo.toml", "target/kept", "src/a b.rs", "src/é.rs"):
        put(tmp_path / "one" / name)
    put(tmp_path / "one/.gitignore", "loose")
    put(tmp_path / "one/loose/file")
    run(tmp_path / "one", "add", "-A")
    run(tmp_path / "one", "commit", "-qm", "first")
    put(tmp_path / "one/src/b.rs")
    run(tmp_path / "one", "add", "-A")
    run(tmp_path / "one", "commit", "-qm", "second", when=1_650_000_000)
    run(tmp_path / "one", "gc", "-q")  # packed
    put(tmp_path / "two/package.json")
    put(tmp_path / "two/node_modules/m.js")
    put(tmp_path / "two/.git/hooks/post-index-change", "#!/bin/sh\ntouch hit")
    run(tmp_path / "two", "add", "package.json")
    run(tmp_path / "two", "commit", "-qm", "one", when=1_500_000_000)
    run(tmp_path / "two", "config", "core.fsmonitor", f"touch {tmp_path}/hit")
    (tmp_path / "broken/.git/HEAD").unlink()
    put(tmp_path / "plain/package.json")

    found = scan(spark, [str(tmp_path)])
    repos = git.repositories(found)
    assert sorted(r["repo"].removeprefix(f"{tmp_path}/") for r in repos.collect()) == ["broken", "empty", "one", "two"]
    known = git.answers(repos)
    at = lambda df, c: sorted(r[c].removeprefix(f"{tmp_path}/") for r in df.collect())
    assert at(known.where("tracked is not null"), "tracked") == ["one/.gitignore", "one/Cargo.toml", "one/src/a b.rs", "one/src/b.rs", "one/src/é.rs", "one/target/kept", "two/package.json"]
    assert at(known.where("error is not null"), "repo") == ["broken"]
    assert not (tmp_path / "hit").exists() and not (tmp_path / "two/hit").exists()
    assert at(git.tracked(known), "path") == ["one/.gitignore", "one/Cargo.toml", "one/src", "one/src/a b.rs", "one/src/b.rs", "one/src/é.rs", "one/target", "one/target/kept", "two/package.json"]
    projects = buildtrees.analyze(found, builtin(), tracked=git.tracked(known))
    assert {r["path"].removeprefix(f"{tmp_path}/"): r["risk"] for r in projects["artifacts"].collect()} == {"one/target": "Review", "two/node_modules": "Caution"}
    times = {r["path"].removeprefix(f"{tmp_path}/"): r["last_commit"] for r in git.commits(known, projects["projects"]).collect()}
    assert times == {"one": 1_650_000_000, "two": 1_500_000_000}

    out = type("Out", (list,), {"write": list.append, "flush": lambda _: None})()
    assert cli.run(["dev", str(tmp_path), "--json"], spark, out) == 0
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r["last_commit"] for r in json.loads("".join(out))}
    assert rows == {"one": 1_650_000_000, "two": 1_500_000_000, "plain": None}


def test_without_git(spark, tmp_path, monkeypatch):
    put(tmp_path / "r/.git")
    monkeypatch.setattr(git, "asked", lambda *_: (_ for _ in ()).throw(ValueError("no git here")))
    (r,) = git.answers(git.repositories(scan(spark, [str(tmp_path)]))).collect()
    assert (r["tracked"], r["last_commit"], r["error"]) == (None, None, "no git here")

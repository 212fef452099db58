"""Detection rules: which directories of a project can be made again, and how.

A rule's markers are globs of names in the project's directory; one with a ``/`` is a literal relative path. Its artifacts are
globs of names of direct subdirectories. A ``dir-contains`` rule instead claims any such subdirectory that holds a marker.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

from fathomry.functions.globs import GlobError, to_regex
from fathomry.schemas import RULE

RISKS = ("Safe", "Caution", "Review")
EXPLAINED = {
    "Safe": "Can be made again in full, by itself or with one command.",
    "Caution": "Can be made again, but slowly or over the network.",
    "Review": "May hold user data or files under version control; look inside first.",
}
NO_LOCKFILE = "No lockfile: a reinstall may resolve other versions and needs the network."
TRACKED = "Tracked by Git: deleting it changes the repository."
VCS = (".git", ".hg", ".svn")

# Ecosystems, their markers and artifacts, risks and commands.
# ecosystem, markers, artifacts, risk, regenerate, further fields
BUILTIN = [
    ("Rust", ["Cargo.toml"], ["target"], "Safe", "cargo build", {"clean": ["cargo", "clean", "--manifest-path", "{dir}/Cargo.toml"]}),
    ("Node.js", ["package.json"], ["node_modules"], "Safe", "npm ci / pnpm i / yarn", {"caution_without": ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock"]}),
    ("Next.js", ["next.config.*"], [".next"], "Safe", "next build", {}),
    ("Nuxt", ["nuxt.config.*"], [".nuxt", ".output"], "Safe", "nuxt build", {}),
    ("Vite", ["vite.config.*"], ["dist"], "Caution", "vite build", {"note": "Build output that may be published from here."}),
    ("Turborepo", ["turbo.json"], [".turbo"], "Safe", "automatic", {}),
    ("Python", ["pyproject.toml", "setup.py", "setup.cfg", "requirements*.txt", "Pipfile", "tox.ini"], [], "Safe", "", {}),
    ("Python", ["pyvenv.cfg"], ["*"], "Review", "python -m venv + install", {"kind": "dir-contains", "defines_project": False, "note": "A virtual environment; packages may have been installed by hand."}),
    ("Python", ["*.py", "pyproject.toml", "setup.py", "setup.cfg", "tox.ini"], ["__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox"], "Safe", "automatic", {"defines_project": False}),
    ("Maven", ["pom.xml"], ["target"], "Safe", "mvn package", {"clean": ["mvn", "-q", "-f", "{dir}/pom.xml", "clean"]}),
    ("Gradle", ["build.gradle*", "settings.gradle*"], ["build", ".gradle"], "Safe", "gradle build", {"clean": ["gradle", "-p", "{dir}", "clean"]}),
    ("Xcode", ["*.xcodeproj", "*.xcworkspace"], [], "Safe", "Xcode build", {}),
    ("CocoaPods", ["Podfile"], ["Pods"], "Caution", "pod install", {}),
    ("Flutter/Dart", ["pubspec.yaml"], ["build", ".dart_tool"], "Safe", "flutter pub get", {"clean": ["flutter", "clean"]}),
    ("Go", ["go.mod"], [], "Safe", "", {}),
    (".NET", ["*.csproj", "*.fsproj", "*.vbproj", "*.sln"], ["bin", "obj"], "Safe", "dotnet build", {"clean": ["dotnet", "clean"]}),
    ("CMake", ["CMakeLists.txt"], ["build", "cmake-build-*"], "Caution", "cmake --build", {"note": "Can be made again, but a full build may be slow."}),
    ("Zig", ["build.zig"], ["zig-cache", ".zig-cache", "zig-out"], "Safe", "zig build", {}),
    ("Haskell", ["stack.yaml"], [".stack-work"], "Safe", "stack build", {"clean": ["stack", "clean"]}),
    ("Elixir", ["mix.exs"], ["_build", "deps"], "Safe", "mix deps.get && mix compile", {"clean": ["mix", "clean"]}),
    ("Terraform", ["*.tf"], [".terraform"], "Caution", "terraform init", {"note": "Providers and modules are downloaded again."}),
    ("Unity", ["ProjectSettings/ProjectVersion.txt"], ["Library", "Temp", "obj"], "Caution", "Open in Unity", {"note": "Can be made again, but all assets are imported anew."}),
]


def _row(number: int, ecosystem: str, markers: list[str], artifacts: list[str], risk: str, regenerate: str, more: dict) -> tuple:
    kind = more.get("kind", "marker")
    if kind not in ("marker", "dir-contains"):
        raise ValueError(f"unknown kind {kind!r}")
    for glob in [*(m for m in markers if "/" not in m), *artifacts, *more.get("caution_without", [])]:
        to_regex(glob)
    return (number, ecosystem, markers, artifacts, risk, RISKS.index(risk), regenerate, more.get("caution_without", []), kind, more.get("defines_project", True), more.get("clean", []), more.get("note", ""))


def builtin() -> list[tuple]:
    return [_row(i, *r) for i, r in enumerate(BUILTIN)]


def from_toml(text: str, first: int = 0) -> tuple[list[tuple], list[str]]:
    """Rules of a ``[[rule]]`` document, numbered from ``first``, and what was wrong with those left out."""
    rows, errors = [], []
    for r in tomllib.loads(text).get("rule", []):
        try:
            rows.append(_row(first + len(rows), r["ecosystem"], r["markers"], r["artifacts"], r["risk"], r["regenerate"], r))
        except (KeyError, ValueError, GlobError) as e:
            errors.append(f"{r.get('ecosystem', '?')}: {e}")
    return rows, errors


def to_toml(rows: list[tuple]) -> str:
    import json

    names = [c.split()[0] for c in RULE.replace("\n", " ").split(", ")]
    out = []
    for row in rows:
        r = dict(zip(names, row, strict=True))
        out.append("[[rule]]")
        out += [f"{k} = {json.dumps(r[k])}" for k in names if k not in ("rule_id", "risk_rank")]
        out.append("")
    return "\n".join(out)


def rule_table(spark: SparkSession, custom: str = "") -> tuple[DataFrame, list[str]]:
    """The built-in rules and, after them, custom ones that are valid; with the errors of those that aren't."""
    rows = builtin()
    more, errors = from_toml(custom, len(rows)) if custom else ([], [])
    return spark.createDataFrame(rows + more, RULE), errors

"""Settings in a TOML file: a missing file means defaults, a malformed one defaults and a message; numbers are clamped."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace

from fathomry.sources.filesystem import DEFAULT_EXCLUDED

BOUNDS = {"rings": (1, 10), "min_angle_degrees": (0.1, 10.0), "stale_days": (1, 3650), "similar_distance": (0, 32), "confirm_count": (1, 1_000_000)}


@dataclass(frozen=True)
class Settings:
    follow_symlinks: bool = False
    cross_filesystems: bool = False
    exclude_paths: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    size_mode: str = "allocated"
    units: str = "binary"
    rings: int = 6
    min_angle_degrees: float = 0.5
    stale_days: int = 180
    pinned: tuple[str, ...] = ()
    custom_rules: str = ""
    min_duplicate_size: int = 1 << 20
    similar_distance: int = 8
    protected: tuple[str, ...] = ()
    confirm_bytes: int = 1 << 30
    confirm_count: int = 100
    delete_method: str = field(default="dry-run")

    def clamped(self) -> Settings:
        return replace(self, **{k: min(max(getattr(self, k), lo), hi) for k, (lo, hi) in BOUNDS.items()})

    def scan_options(self) -> dict:
        """Exclusions of the settings and the default ones, each once."""
        paths = list(dict.fromkeys([*DEFAULT_EXCLUDED, *self.exclude_paths]))
        return {"exclude_paths": paths, "exclude_globs": list(dict.fromkeys(self.exclude_globs)), "follow_symlinks": self.follow_symlinks, "cross_filesystems": self.cross_filesystems}


def load(path: str) -> tuple[Settings, str | None]:
    if not os.path.exists(path):
        return Settings(), None
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        known = {f.name for f in fields(Settings)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known}
        return Settings(**values).clamped(), None
    except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
        return Settings(), f"{path}: {e}; using defaults"


def save(settings: Settings, path: str) -> None:
    """Written beside and renamed into place."""
    lines = [f"{k} = {json.dumps(list(v) if isinstance(v, tuple) else v)}" for k, v in asdict(settings).items()]
    fresh = f"{path}.tmp"
    with open(fresh, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.replace(fresh, path)

"""Project configuration: defaults, then the nearest file upwards, then what the caller says."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from siftline.sources.packs import SEVERITIES

FILE = "siftline.toml"


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    root: str = "."
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    packs: list[str] = field(default_factory=list)
    pack_dirs: list[str] = field(default_factory=list)
    format: str = "auto"
    output: str | None = None
    exit_on_severity: str | None = None


def _strings(raw: dict, key: str) -> list[str]:
    value = raw.get(key, [])
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{key} must be a list of strings")
    return value


def load(start: str = ".") -> Config:
    """The configuration of the nearest folder upwards that has one; relative paths are seen from there."""
    here = Path(start).absolute()
    for folder in (here, *here.parents):
        if not (folder / FILE).is_file():
            continue
        try:
            raw = tomllib.loads((folder / FILE).read_text("utf-8"))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"unable to load '{folder / FILE}': {e}") from e
        report, policy = raw.get("report", {}), raw.get("policy", {})
        floor = policy.get("exit-on-severity")
        if floor is not None and str(floor).lower() not in SEVERITIES:
            raise ConfigError(f"unknown severity '{floor}'")
        whole = lambda xs: list(xs) if folder == here else [str(folder / x) for x in xs]
        return Config(
            str(folder), whole(_strings(raw, "include")), _strings(raw, "exclude"), _strings(raw, "packs"), whole(_strings(raw, "pack-dirs")),
            report.get("format", "auto"), report.get("output"), str(floor).lower() if floor is not None else None,
        )
    return Config(str(here))

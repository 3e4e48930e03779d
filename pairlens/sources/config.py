"""Settings of a study as plain Python."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Study:
    """Windows, patch and classes of a study; the defaults are fixed values."""

    t0: tuple[str, str] = ("2022-01-01", "2022-03-01")
    t1: tuple[str, str] = ("2023-01-01", "2023-03-01")
    climatology: tuple[str, str] = ("2015-01-01", "2022-01-01")
    patch_pixels: int = 64
    pixel_m: float = 10.0
    classes: tuple[str, ...] = ("stable", "decline", "increase")

    def merged(self, values: dict[str, Any]) -> Study:
        """With the given values; an unknown name is an error."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load_study(path: str) -> Study:
    """Settings from a YAML file where a YAML reader is installed, else from JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return Study().merged(json.loads(text))
    return Study().merged(yaml.safe_load(text) or {})

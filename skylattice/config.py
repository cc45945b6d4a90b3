"""Credentials and YAML settings."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import re
from pathlib import Path


def load(path: str | Path) -> dict:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return data


def dump(config: dict, path: str | Path) -> Path:
    import yaml

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(config, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return path


def merged(base: dict, over: dict) -> dict:
    """`base` with `over` on top; mappings merge, all else is replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def digest(config: dict) -> str:
    """A key for what was made from a config (K3): changes with any setting."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def secrets(path: str | Path = ".env") -> dict[str, str]:
    """NAME=value lines of a file, of lines with one name the first; other lines, and a file that isn't there, say nothing."""
    path = Path(path)
    lines = re.findall(r"^[ \t]*([A-Za-z_]\w*)[ \t]*=[ \t]*(.*?)[ \t\r]*$", path.read_text(encoding="utf-8"), re.M) if path.exists() else []
    return dict(reversed(lines))


def secret(name: str, path: str | Path = ".env") -> str:
    """A credential from the environment, or else from the file; never printed, an error where there is none."""
    value = os.environ.get(name) or secrets(path).get(name)
    if not value:
        raise ValueError(f"{name} is set neither in the environment nor in {path}")
    return value

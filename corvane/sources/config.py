"""Project configuration: defaults, and a JSON file merged over them section by section."""

from __future__ import annotations

import json
from copy import deepcopy
from pathlib import Path

from corvane.functions.words import DEFAULT_EXCLUDES, DENY_PATHS

FILE = ".corvane/config.json"


def defaults(name: str) -> dict:
    return {
        "project": {"name": name}, "indexing": {"excludes": list(DEFAULT_EXCLUDES), "max_file_bytes": 1 << 20}, "security": {"deny_paths": list(DENY_PATHS), "secret_guard": True},
        "context": {"budget": 20_000, "margin": 0.05, "max_hops": 2, "dictionary": []},
    }


def merge(base: dict, over: dict) -> dict:
    out = deepcopy(base)
    for section, values in over.items():
        out[section] = {**out.get(section, {}), **values} if isinstance(values, dict) else values
    return out


def synonym_groups(config: dict) -> list[list[str]]:
    """The configured groups of synonyms: a list of lists, or the values of an object whose keys belong to their groups."""
    own = config["context"].get("dictionary") or []
    groups = [[k, *v] for k, v in own.items()] if isinstance(own, dict) else own
    return [[str(w) for w in g] for g in groups if len(g) > 1]


def load(root: str) -> dict:
    path = Path(root, FILE)
    own = json.loads(path.read_text()) if path.exists() else {}
    return merge(defaults(Path(root).resolve().name), own)


def write(root: str, config: dict) -> Path:
    path = Path(root, FILE)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({k: v for k, v in config.items() if k != "root"}, indent=2, ensure_ascii=False) + "\n")
    return path

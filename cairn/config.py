"""Settings: defaults, a file that overrides them, and the folder in which it lies."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from cairn.operators import wiki as W


@dataclass(frozen=True)
class Config:
    name: str = "wiki"
    schema_version: int = 1
    allowed_names: list[str] = field(default_factory=lambda: list(W.ALLOWED_NAMES))
    skip_names: list[str] = field(default_factory=lambda: list(W.SKIP_NAMES))
    skip_parts: list[str] = field(default_factory=lambda: list(W.SKIP_PARTS))
    required_fields: list[str] = field(default_factory=lambda: list(W.REQUIRED_FIELDS))
    status_values: list[str] = field(default_factory=lambda: list(W.STATUS_VALUES))
    repo_prefixes: list[str] = field(default_factory=list)
    cite_skip: list[str] = field(default_factory=lambda: list(W.CITE_SKIP))
    pipelines: dict[str, str] = field(default_factory=dict)  # page type -> pipeline


def merged(base: Config, over: dict) -> Config:
    """``base`` with the settings of ``over``: scalars count unless zero or empty, lists and maps unless null, so ``[]`` does override."""
    known = {f.name for f in fields(Config)}
    take = {k: v for k, v in over.items() if k in known and (v is not None if isinstance(v, list | dict) else bool(v))}
    return replace(base, **take)


def load(path: str | Path) -> Config:
    """Defaults merged with a JSON file, or a YAML file where PyYAML is there; a missing file gives the defaults."""
    p = Path(path)
    if not p.exists():
        return Config()
    text = p.read_text()
    if p.suffix in (".yaml", ".yml"):
        import yaml

        return merged(Config(), yaml.safe_load(text) or {})
    return merged(Config(), json.loads(text))


def save(path: str | Path, changes: dict) -> None:
    """Writes settings back to a JSON file: keys of ``changes`` are set, or cleared where null or empty; all others stay as they are."""
    p = Path(path)
    doc = json.loads(p.read_text()) if p.exists() else {}
    if not isinstance(doc, dict):
        raise ValueError(f"{p} holds no settings at its top")
    for k, v in changes.items():
        if v in (None, "", [], {}):
            doc.pop(k, None)
        else:
            doc[k] = v
    p.write_text(json.dumps(doc, indent=2, ensure_ascii=False) + "\n")


def find_root(start: str | Path, markers: tuple[str, ...]) -> Path:
    """The nearest folder at or above ``start`` that holds the first marker, else the second, ...; else ``start``."""
    here = Path(start).resolve()
    for m in markers:
        for d in (here, *here.parents):
            if (d / m).exists():
                return d
    return here

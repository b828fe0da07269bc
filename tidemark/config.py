"""Settings from TOML, JSON or flat `key: value` text. A file wins over the environment; unknown keys are errors."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path, PurePath, PurePosixPath, PureWindowsPath


class ConfigError(ValueError):
    pass


# The names of the settings, and below the tails of their folders.
@dataclass(frozen=True)
class Config:
    data_home: str
    raw_data_dir: str = ""
    warehouse_directory: str = ""
    database_path: str = ""
    parquet_directory: str = ""
    temp_directory: str = ""
    export_directory: str = ""
    analysis_timezone: str = "UTC"
    session_gap_minutes: int = 30
    synthetic_seed: int = 20260809
    demo_mode: bool = False
    expected_rows: dict = field(default_factory=dict)  # by file name

    def to_dict(self) -> dict:
        return asdict(self)


_NAMES = {f.name: f.type for f in fields(Config)}
#: Where each folder is if it is not set: below data_home, or below another folder.
_CHILDREN = {
    "raw_data_dir": ("data_home", "raw/extracted"), "warehouse_directory": ("data_home", "warehouse"),
        "database_path": ("warehouse_directory", "tidemark.duckdb"),
    "parquet_directory": ("data_home", "parquet"), "temp_directory": ("data_home", "tmp"), "export_directory": ("data_home", "exports"),
}
#: Tables of a TOML file whose keys are settings, with the keys that only describe; and tables that are read past.
_TABLES, _OTHER_TABLES = {"project": {"name"}, "paths": set()}, {"dataset", "warehouse"}
#: Tables of [dataset]: the name of each source file, and its number of data rows.
_FILES, _ROWS = "files", "rows"
_WORDS = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}


def _path(text: object, name: str) -> PurePath:
    if not isinstance(text, (str, os.PathLike)) or not str(text).strip():
        raise ConfigError(f"{name}: {text!r} is not a path")
    text = str(text).strip()
    windows = text.startswith("\\\\") or text[:1].isalpha() and text[1:3] in (":\\", ":/")
    return PureWindowsPath(text) if windows else PurePosixPath(text)


def _value(name: str, raw: object) -> object:
    kind = _NAMES[name]
    if kind == "bool":
        found = raw if isinstance(raw, bool) else _WORDS.get(raw.strip().casefold()) if isinstance(raw, str) else None
        if found is None:
            raise ConfigError(f"{name}: {raw!r} is not true or false")
        return found
    if kind == "dict":
        try:
            found = json.loads(raw) if isinstance(raw, str) else raw
            if not isinstance(found, dict) or any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in found.values()):
                raise ValueError
            return found
        except ValueError:
            raise ConfigError(f"{name}: {raw!r} does not name files with their numbers of rows") from None
    if kind == "int":
        try:
            if isinstance(raw, bool):
                raise ValueError
            return int(raw)
        except (TypeError, ValueError):
            raise ConfigError(f"{name}: {raw!r} is not a whole number") from None
    return str(raw).strip() if name == "analysis_timezone" else str(_path(raw, name))


def _flat_toml(text: str) -> dict:
    out: dict = {}
    for key, value in tomllib.loads(text).items():
        if key in _OTHER_TABLES and isinstance(value, dict):
            if isinstance(rows := value.get(_ROWS), dict):
                named = value.get(_FILES) or {}
                out["expected_rows"] = {named.get(k, k if k.endswith(".csv") else f"{k}.csv"): n for k, n in rows.items()}
            continue
        table = value if key in _TABLES else {key: value}
        if not isinstance(table, dict) or any(isinstance(v, dict) for v in table.values()):
            raise ConfigError(f"[{key}] is not a table of settings")
        for name, x in table.items():
            if name in _TABLES.get(key, ()):
                continue
            if name in out:
                raise ConfigError(f"duplicate key: {name}")
            out[name] = x
    return out


def _scalar(text: str) -> object:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        try:
            return json.loads(text) if text[0] == '"' else text[1:-1]
        except ValueError:
            return text[1:-1]
    return text


def parse(text: str, kind: str = "") -> dict:
    """A flat dictionary; kind is the file's suffix."""
    if kind == ".toml":
        return _flat_toml(text)
    if kind == ".json" or text.lstrip().startswith("{"):
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ConfigError("a JSON configuration is an object")
        return found
    out: dict = {}
    for line in text.splitlines():
        if not line.strip() or line.strip().startswith("#"):
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or not key or not value or line[0].isspace() or key in out:
            raise ConfigError(f"not a flat, unique key with a value: {line!r}")
        out[key] = _scalar(value)
    return out


def build(values: dict) -> Config:
    """A checked configuration: data_home is a folder of its own, and all other folders are inside it."""
    if unknown := set(values) - set(_NAMES):
        raise ConfigError(f"unknown keys: {sorted(unknown)}")
    if not values.get("data_home"):
        raise ConfigError("data_home is missing")
    known = {k: _value(k, v) for k, v in values.items()}
    home = _path(known["data_home"], "data_home")
    for name, (under, tail) in _CHILDREN.items():
        known.setdefault(name, str(_path(known[under], under) / tail))
    cfg = Config(**known)
    broad = isinstance(home, PurePosixPath) and os.name != "nt" and str(home) in (str(Path.home()), str(Path.cwd()))
    if not home.is_absolute() or ".." in home.parts or len(home.parts) < 3 or broad:
        raise ConfigError(f"data_home: {home} must be absolute, without '..', and not a root, near one, the user's home or the working folder")
    for name in _CHILDREN:
        child = _path(getattr(cfg, name), name)
        if type(child) is not type(home) or ".." in child.parts or child == home or not child.is_relative_to(home):
            raise ConfigError(f"{name}: {child} is not within {home}")
    if not cfg.analysis_timezone or cfg.session_gap_minutes <= 0 or cfg.synthetic_seed < 0:
        raise ConfigError("analysis_timezone, session_gap_minutes or synthetic_seed is out of range")
    return cfg


def load(path: str | None = None, env: dict | None = None) -> Config:
    """From the environment (TIDEMARK_<KEY>), then from the file, which wins."""
    env = dict(os.environ) if env is None else env
    values = {k: env[f"TIDEMARK_{k.upper()}"] for k in _NAMES if f"TIDEMARK_{k.upper()}" in env}
    if path:
        try:
            with open(path, encoding="utf-8-sig") as f:
                values |= parse(f.read(), os.path.splitext(path)[1].lower())
        except (OSError, ValueError) as e:
            raise ConfigError(str(e)) from e
    return build(values)

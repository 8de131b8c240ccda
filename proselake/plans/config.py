"""Configuration of the driver: files in TOML, YAML or JSON, the environment, and custom texts. Never a column.

Layers, each over the one before: defaults, the user's file, the project's files, files given by name, the environment.
Maps are merged key by key; all other values are replaced.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

#: Ends of file names, in the order in which they are looked for.
EXTENSIONS = ("toml", "yaml", "yml", "json")
DEFAULTS = {
    "log_level": "info", "token_budget": None, "max_grade": None, "passive_max_percent": None, "style_min_score": None, "dialect": None,
    "max_input_bytes": None, "disable_input_limit": False, "templates": None, "rules": None, "custom": None,
}
_NUMBERS = {"token_budget": int, "max_grade": float, "passive_max_percent": float, "style_min_score": int, "max_input_bytes": int}
DIALECTS = ("en-us", "en-gb", "en-ca", "en-au")


class ConfigError(ValueError):
    """A file that is missing or cannot be read, or a value that does not fit."""


def read_file(path: str | Path) -> dict:
    """One configuration file by its ending; any other ending is read as TOML."""
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            out = json.loads(text)
        elif path.suffix in (".yaml", ".yml"):
            import yaml

            out = yaml.safe_load(text)
        else:
            import tomllib

            out = tomllib.loads(text)
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    except Exception as e:  # the YAML package's own errors
        if type(e).__module__.startswith("yaml"):
            raise ConfigError(f"{path}: {e}") from e
        raise
    if out is not None and not isinstance(out, dict):
        raise ConfigError(f"{path}: no table of settings")
    return out or {}


def merged(below: dict, above: dict) -> dict:
    out = dict(below)
    for key, value in above.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _checked(raw: dict) -> dict:
    out = merged(DEFAULTS, {k: v for k, v in raw.items() if k in DEFAULTS})
    for name, kind in _NUMBERS.items():
        if out[name] is not None:
            try:
                out[name] = kind(out[name])
            except (TypeError, ValueError) as e:
                raise ConfigError(f"{name}: {out[name]!r} is no number") from e
    if out["dialect"] is not None and out["dialect"] not in DIALECTS:
        raise ConfigError(f"dialect: {out['dialect']!r} is none of {', '.join(DIALECTS)}")
    if isinstance(out["disable_input_limit"], str):
        out["disable_input_limit"] = out["disable_input_limit"].lower() in ("1", "true")
    return out


@dataclass
class Loader:
    """Where to look for settings; `load` merges what is found."""

    project: str | Path | None = None
    user: bool = True
    boundary: str | None = ".git"
    files: list = field(default_factory=list)
    app: str = "proselake"
    environ: dict | None = None

    def project_files(self) -> list[Path]:
        """All files of the nearest folder that has any, from the weakest to the strongest: names with a dot before them
        are weaker. The search goes up and ends with a folder that holds the boundary, unless it is the first one."""
        start = Path(self.project).absolute() if self.project else None
        for folder in [start, *start.parents] if start else []:
            found = [p for dot in (".", "") for e in EXTENSIONS if (p := folder / f"{dot}{self.app}.{e}").is_file()]
            if found:
                return found
            if self.boundary and folder != start and (folder / self.boundary).exists():
                break
        return []

    def user_file(self) -> Path | None:
        env = os.environ if self.environ is None else self.environ
        home = env.get("XDG_CONFIG_HOME") or (f"{env['HOME']}/.config" if env.get("HOME") else None)
        return next((p for e in EXTENSIONS if (p := Path(home, self.app, f"config.{e}")).is_file()), None) if home and self.user else None

    def sources(self) -> list[Path]:
        """The files that count, from the weakest to the strongest."""
        user = self.user_file()
        return [*([user] if user else []), *self.project_files(), *map(Path, self.files)]

    def load(self) -> dict:
        out: dict = {}
        for path in self.sources():
            out = merged(out, read_file(path))
        prefix = self.app.upper() + "_"
        for name, value in (os.environ if self.environ is None else self.environ).items():
            if name.startswith(prefix):
                out[name[len(prefix) :].lower()] = value
        return _checked(out)

    def load_or_error(self) -> dict:
        if not self.sources():
            raise ConfigError("no configuration file found")
        return self.load()


def folders(app: str = "proselake", environ: dict | None = None) -> dict[str, Path] | None:
    """The user's folders for configuration, cache, data and data of this machine alone; None without a home."""
    env = os.environ if environ is None else environ
    if not env.get("HOME"):
        return None
    at = lambda name, default: Path(env.get(name) or f"{env['HOME']}/{default}", app)
    data = at("XDG_DATA_HOME", ".local/share")
    return {"config": at("XDG_CONFIG_HOME", ".config"), "cache": at("XDG_CACHE_HOME", ".cache"), "data": data, "data_local": data}


def input_limit(config: dict, default: int) -> int | None:
    """The bound on a document in bytes, or None for no bound."""
    return None if config["disable_input_limit"] else default if config["max_input_bytes"] is None else config["max_input_bytes"]


def custom_text(entry: dict, folder: str | Path) -> str:
    """A custom entry's content: its file, relative to the configuration's folder, wins over its instructions."""
    if entry.get("file"):
        path = Path(folder, entry["file"])
        try:
            return path.read_text(encoding="utf-8")
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e
    if entry.get("instructions") is None:
        raise ConfigError("a custom entry needs a file or instructions")
    return entry["instructions"]

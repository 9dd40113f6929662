"""Settings of the command line: flags before environment before the nearest settings file."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields, replace

FOLDER, PREFIX, STOP_FILE = ".corpusweave", "CORPUSWEAVE_", "stopwords"
#: Settings that may be zero: no limit, or none of it.
MAY_BE_ZERO = ("max_bytes", "least_chunk", "most_chunk", "overlap")
#: One letter for each setting that the command line takes.
SHORT = {
    "root": "r", "index": "i", "embedder": "e", "model": "m", "context": "c", "workers": "w", "batch_size": "b", "batch_ms": "t", "debounce_ms": "d", "max_bytes": "z", "parser_mode": "p",
    "search_mode": "s", "exclude_dirs": "x", "exclude_exts": "X", "allow_hidden": "a", "stop_words": "S", "reconcile": "R", "least_chunk": "l", "most_chunk": "L", "overlap": "o", "progress": "P",
}
MODES, PARSERS = ("dense", "sparse", "hybrid"), ("code", "doc", "full")


@dataclass(frozen=True)
class Settings:
    """root: the workspace; index: folder of the points; embedder: address of a model server, empty for the hashed stand-in."""

    root: str = "."
    index: str = ""
    embedder: str = ""
    model: str = ""
    context: int = 8192
    workers: int = 5
    batch_size: int = 100
    batch_ms: int = 200
    debounce_ms: int = 800
    max_bytes: int = 1 << 20
    parser_mode: str = "full"
    search_mode: str = "dense"
    exclude_dirs: tuple[str, ...] = ()
    exclude_exts: tuple[str, ...] = (".sql",)
    allow_hidden: tuple[str, ...] = ()
    stop_words: str = ""
    reconcile: bool = True
    least_chunk: int = 800
    most_chunk: int = 4000
    overlap: int = 200
    progress: bool = False

    @property
    def points(self) -> str:
        return f"{(self.index or os.path.join(self.root, FOLDER, 'index')).rstrip('/')}/points"

    def stop_file(self) -> str:
        """The stop-word file: the one that is set, else the workspace's own, in its folder first; empty if there is none."""
        places = [os.path.join(self.root, FOLDER, STOP_FILE), os.path.join(self.root, STOP_FILE)]
        return self.stop_words or next((x for x in places if os.path.isfile(x)), "")


def _value(name: str, default, raw):
    """raw as a value of the setting; the default where it isn't valid."""
    if isinstance(default, bool):
        low = str(raw).strip().lower()
        return True if low in ("1", "true", "t") else False if low in ("0", "false", "f") else default
    if isinstance(default, int):
        try:
            n = int(str(raw))
        except ValueError:
            return default
        return n if n > 0 or name in MAY_BE_ZERO and n == 0 else default
    if isinstance(default, tuple):
        items = raw if isinstance(raw, (list, tuple)) else str(raw).split(",")
        return tuple(str(x).strip() for x in items if str(x).strip())
    text = str(raw).strip()
    allowed = {"search_mode": MODES, "parser_mode": PARSERS}.get(name)
    return text if not allowed else text.lower() if text.lower() in allowed else default


def settings_file(folder: str) -> dict:
    """Values of the nearest settings.json or settings.toml, from the folder upward; what can't be read counts as none."""
    at = os.path.abspath(folder)
    while True:
        for name, load in (("settings.json", json.load), ("settings.toml", tomllib.load)):
            path = os.path.join(at, FOLDER, name)
            if os.path.isfile(path):
                try:
                    with open(path, "rb") as f:
                        found = load(f)
                except (json.JSONDecodeError, tomllib.TOMLDecodeError, UnicodeDecodeError):
                    continue
                if isinstance(found, dict) and found:
                    return found
        if os.path.dirname(at) == at:
            return {}
        at = os.path.dirname(at)


def load(flags: dict | None = None, env=None, folder: str | None = None) -> Settings:
    flags, env, base = flags or {}, os.environ if env is None else env, Settings()
    own = {f.name for f in fields(Settings)}
    given = {k: v for k, v in settings_file(folder or flags.get("root") or ".").items() if k in own}
    given |= {k: env[PREFIX + k.upper()] for k in own if env.get(PREFIX + k.upper())}
    given |= {k: v for k, v in flags.items() if k in own and v is not None}
    return replace(base, **{k: _value(k, getattr(base, k), v) for k, v in given.items()})

"""A folder of files as a data source: format "workspace", for tables and streams.

The driver walks the folder, in lexical order and without entering ignored folders; executors read the files, so the folder
must be one that all of them see. (files.workspace_scan reads any store that Spark reads, but Spark passes over names that
start with "_" or ".", and it can't prune.) As a stream it gives one row for each file that was made, written or removed.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .files import MAX_BYTES
from .ignore import Rule, compile_rule, fixed_rule, rule_hits

#: Files and bytes of a task, about.
FILES, BYTES = 512, 64 << 20


def _names(options: dict, key: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in options.get(key, "").split(",") if x.strip())


def walk(root: str, exclude_dirs=(), exclude_exts=(), allow_hidden=()) -> Iterator[tuple[str, int, int]]:
    """(relative path, modified in seconds, length) of each file that no rule ignores; each folder's ignore file holds below it."""

    def below(at: str, rules: list[Rule]):
        here = os.path.join(root, at)
        own = os.path.join(here, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="ignore") as f:
                rules = rules + [r for k, line in enumerate(f, len(rules)) if (r := compile_rule(line, k, at))]
        with os.scandir(here) as entries:
            found = sorted(entries, key=lambda e: e.name)
        for e in found:
            path, is_dir = f"{at}/{e.name}".lstrip("/"), e.is_dir(follow_symlinks=False)
            if fixed_rule(path, is_dir, exclude_dirs, exclude_exts, allow_hidden) or rule_hits(rules, path, is_dir):
                continue
            if is_dir:
                yield from below(path, rules)
            elif e.is_file():
                s = e.stat()
                yield path, int(s.st_mtime), s.st_size

    yield from below("", [])


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, root: str, most: int, rules: dict):
        self.root, self.most, self.rules = root, most, rules

    def partitions(self):
        out, held, size = [], [], 0
        for f in walk(self.root, **self.rules):
            if not f[2] or 0 < self.most < f[2]:
                continue
            held.append(f)
            size += f[2]
            if len(held) >= FILES or size >= BYTES:
                out.append(Files(held))
                held, size = [], 0
        return out + [Files(held)] if held or not out else out

    def read(self, partition):
        for path, modified, length in partition.files:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, modified, length, f.read()
            except FileNotFoundError:
                continue


class Changes(SimpleDataSourceStreamReader):
    """Differences of one walk to the last. What each offset saw is kept as a small file under `log`, so a restarted query goes on.

    For `settle` seconds after a change each walk also gives a row of no path, a tick: time goes on in the stream, so what waits
    for quiet learns that it is quiet.
    """

    def __init__(self, root: str, log: str, rules: dict, settle: float = 0.0):
        self.root, self.log, self.rules, self.settle = root, log, rules, settle

    def _seen(self, n: int) -> dict:
        if not n:
            return {}
        with open(os.path.join(self.log, f"{n}.json"), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"walk": 0}

    def read(self, start: dict):
        n = start["walk"]
        before = self._seen(n)
        now = {p: [m, s] for p, m, s in walk(self.root, **self.rules)}
        same, at = now == before.get("files", {}), time.time()
        changed = before.get("changed", 0.0) if same else at
        if same and at - changed > self.settle:
            return iter([]), start
        n += 1
        os.makedirs(self.log, exist_ok=True)
        part = os.path.join(self.log, f".{n}.part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"files": now, "at": at, "changed": changed}, f)
        os.replace(part, os.path.join(self.log, f"{n}.json"))
        end = {"walk": n}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        import datetime

        rows = []
        for n in range(start["walk"] + 1, end["walk"] + 1):
            old, now = self._seen(n - 1).get("files", {}), self._seen(n)
            ts = datetime.datetime.fromtimestamp(now["at"], datetime.timezone.utc)
            for p in sorted(old.keys() | now["files"].keys()):
                if old.get(p) != now["files"].get(p):
                    rows.append((p, "create" if p not in old else "write" if p in now["files"] else "remove", ts))
            rows += [("", "tick", ts)] if self.settle else []
        return iter(rows)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.log) if os.path.isdir(self.log) else ():
            if name.endswith(".json") and int(name[:-5]) < end["walk"]:
                os.remove(os.path.join(self.log, name))


class Workspace(DataSource):
    """Options: path; max_bytes (0: any size), exclude_dirs, exclude_exts, allow_hidden (comma-separated); for streams log, and settle (seconds of ticks)."""

    @classmethod
    def name(cls):
        return "workspace"

    def _streams(self) -> bool:
        return "log" in self.options

    def schema(self):
        return "path string, op string, ts timestamp" if self._streams() else "relative_path string, modified bigint, length bigint, content binary"

    def _rules(self) -> dict:
        return {k: _names(self.options, k) for k in ("exclude_dirs", "exclude_exts", "allow_hidden")}

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)), self._rules())

    def simpleStreamReader(self, schema):
        return Changes(self.options["path"], self.options["log"], self._rules(), float(self.options.get("settle", 0)))

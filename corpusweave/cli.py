"""Command line and tool server: ingest, search, evaluate, watch, serve.

python -m corpusweave.cli search --root . "retry policy" --ext py --branch main
"""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time

from pyspark.sql import SparkSession

from . import settings
from .plans import indexing, retrieval
from .streaming import timed, watch

# The protocol's version, error codes and the names of tools and their arguments.
PROTOCOL = "2024-11-05"
PARSE_ERROR, NO_METHOD, BAD_ARGUMENTS, FAILED = -32700, -32601, -32602, -32603
TOOLS = {
    "search": ("Searches the indexed workspace and returns the best snippets.", {"query": "string", "file_extensions": "array", "path_prefix": "string", "branch": "string"}, ["query"]),
    "get_sync_status": ("Tells what the last sync found, and whether one runs.", {}, []),
    "ingest_workspace": ("Scans the whole workspace and brings the index up to date.", {}, []),
}
_SAMPLE = ({"query": "workspace scan and ignore rules", "expect": "sources/"}, {"query": "reciprocal rank fusion", "expect": "operators/"})


class Engine:
    """One session and its settings behind all commands."""

    def __init__(self, spark: SparkSession, s: settings.Settings):
        self.spark, self.s = spark, s
        self.status = {"state": "idle", "syncs": 0, "pending": 0, "active": 0, "total": 0}
        self.lock = threading.Lock()
        self.progress, self.state = None, ""  # of a watch

    def _count(self, **change: int) -> None:
        with self.lock:
            for k, v in change.items():
                self.status[k] += v
            self.status["state"] = "syncing" if self.status["pending"] or self.status["active"] else "idle"

    def ingest(self, only=None) -> dict:
        """Syncs all, or the paths given; counts what waits, what is worked on and what was done, and tells how far it is."""
        waiting = only.select("path").distinct().count() if only is not None else 1
        self._count(pending=waiting)
        self._count(pending=-waiting, active=waiting)
        stop = threading.Event()
        if self.s.progress:
            threading.Thread(target=self._tell, args=(stop,), daemon=True).start()
        try:
            done = indexing.sync(self.spark, self.s, only)
            self._count(syncs=1, total=done["changed"] + done["deleted"])
        finally:
            stop.set()
            self._count(active=-waiting)
        self.status |= done
        return done

    def _tell(self, stop: threading.Event, every: float = 0.5) -> None:
        """A line on stderr every half second: tasks done of those that Spark knows of."""
        tracker = self.spark.sparkContext.statusTracker()
        while not stop.wait(every):
            stages = [x for i in tracker.getActiveStageIds() if (x := tracker.getStageInfo(i))]
            print(f"\rsyncing: {sum(x.numCompletedTasks for x in stages)}/{sum(x.numTasks for x in stages)} tasks", end="", file=sys.stderr, flush=True)
        print("\rsyncing: done", file=sys.stderr, flush=True)

    def _points(self):
        p = indexing.stored(self.spark, self.s.points)
        return self.spark.createDataFrame([], indexing.SCHEMA) if p is None else p

    def search(self, query: str, exts=None, prefix: str = "", branch: str = "") -> str:
        return retrieval.answer(self._points(), query, self.s.search_mode, indexing.embedder(self.s), exts, prefix, branch, stop=indexing.stop_words(self.spark, self.s), postings=indexing.stored_postings(self.spark, self.s.points))

    def evaluate(self, cases) -> list[tuple[str, bool]]:
        return retrieval.evaluate(self._points(), cases, self.s.search_mode, indexing.embedder(self.s), stop=indexing.stop_words(self.spark, self.s), postings=indexing.stored_postings(self.spark, self.s.points))

    def watch(self, checkpoint: str):
        """A running query that syncs settled paths. What waits is in its state, so status() can tell it."""
        self.spark.dataSource.register(indexing.Workspace)
        options = {"log": f"{checkpoint}/walks"} | {k: ",".join(getattr(self.s, k)) for k in ("exclude_dirs", "exclude_exts", "allow_hidden")}
        events = self.spark.readStream.format("workspace").options(**options).load(self.s.root)
        self.state = f"{checkpoint}/state"
        query, self.progress = watch.start(events, lambda df, _: self.ingest(df), self.state, quiet=self.s.debounce_ms, size=self.s.batch_size, wait=self.s.batch_ms)
        return query

    def status_now(self) -> dict:
        """Counts of what waits, is worked on and has been synced; with a watch also the paths that wait, and the stream's last batch and error."""
        with self.lock:
            now = dict(self.status)
        if self.progress is not None:
            paths = sorted(r["path"] for r in timed.waiting(self.spark, self.state).select("path").collect())
            now |= {"pending": now["pending"] + len(paths), "pending_files": paths, "watching": self.progress.running, "batch": self.progress.batch, "error": self.progress.error}
            now["state"] = "syncing" if now["pending"] or now["active"] else "idle"
        return now


def _tool(engine: Engine, name: str, args: dict) -> str:
    if name == "search":
        return engine.search(args["query"], args.get("file_extensions"), args.get("path_prefix") or "", args.get("branch") or "")
    if name == "get_sync_status":
        return json.dumps(engine.status_now())
    return json.dumps(engine.ingest())


def _valid(name: str, args) -> bool:
    if not isinstance(args, dict):
        return False
    _, types, needed = TOOLS[name]
    kinds = {"string": str, "array": list}
    return all(isinstance(args.get(k), str) and args[k].strip() for k in needed) and all(isinstance(v, kinds[types[k]]) for k, v in args.items() if k in types and v is not None)


def reply(engine: Engine, line: str) -> dict | None:
    """The answer to one line of JSON-RPC; None for a notification."""
    try:
        req = json.loads(line)
    except json.JSONDecodeError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
    if not isinstance(req, dict) or "id" not in req:
        return None
    out, method, params = {"jsonrpc": "2.0", "id": req["id"]}, req.get("method"), req.get("params") or {}

    def error(code: int, message: str) -> dict:
        return out | {"error": {"code": code, "message": message}}

    if method == "initialize":
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusweave", "version": "1"}}}
    if method == "tools/list":
        tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} | ({"items": {"type": "string"}} if t == "array" else {}) for k, t in p.items()}, "required": r}} for n, (d, p, r) in TOOLS.items()]
        return out | {"result": {"tools": tools}}
    if method != "tools/call":
        return error(NO_METHOD, f"no method {method}")
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return error(NO_METHOD, f"no tool {name}")
    if not _valid(name, args):
        return error(BAD_ARGUMENTS, f"arguments of {name} are not valid")
    try:
        return out | {"result": {"content": [{"type": "text", "text": _tool(engine, name, args)}]}}
    except Exception as e:  # a failed call must not end the server
        return error(FAILED, f"{type(e).__name__}: {e}")


def _checkpoint(engine: Engine) -> str:
    """Where a watch keeps its state: in the shared folder that the session names, else beside the index."""
    shared = engine.spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/watch" if shared else f"{engine.s.points.removesuffix('/points')}/watch"


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("corpusweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusweave", description=__doc__.splitlines()[0])
    common = argparse.ArgumentParser(add_help=False)
    for name, short in settings.SHORT.items():
        common.add_argument(f"-{short}", f"--{name.replace('_', '-')}", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "watch", "serve"):
        sub.add_parser(name, parents=[common])
    search = sub.add_parser("search", parents=[common])
    search.add_argument("query", nargs="+")
    search.add_argument("--ext", action="append")
    search.add_argument("--prefix", default="")
    search.add_argument("--branch", default="")
    ev = sub.add_parser("evaluate", parents=[common])
    ev.add_argument("--cases", help="JSON list of {query, expect, exts, prefix}")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(spark or _session(), settings.load(vars(a)))
    if a.command == "ingest":
        print(json.dumps(engine.ingest()))
    elif a.command == "search":
        print(engine.search(" ".join(a.query), a.ext, a.prefix, a.branch))
    elif a.command == "evaluate":
        engine.ingest()
        cases = _SAMPLE
        if a.cases:
            with open(a.cases, encoding="utf-8") as f:
                cases = json.load(f)
        found = engine.evaluate(cases)
        for query, ok in found:
            print(("PASS " if ok else "FAIL ") + query)
        print(f"{sum(ok for _, ok in found)}/{len(found)}")
        return 0 if all(ok for _, ok in found) else 1
    elif a.command == "watch":
        query = engine.watch(_checkpoint(engine))
        while query.isActive:
            time.sleep(1)
    else:
        engine.watch(_checkpoint(engine))
        for line in sys.stdin:
            if line.strip() and (got := reply(engine, line)) is not None:
                print(json.dumps(got), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())

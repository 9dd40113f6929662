"""A workspace from its files to answers: scan, points, upkeep, search, server, settings and change stream."""

import json

import pytest
from pyspark.sql import functions as F

from corpusweave import cli, settings
from corpusweave.plans import indexing, retrieval
from corpusweave.sources import ignore, workspace

FILES = {
    "app/retry_policy.py": "import pytest\n\n\ndef backoff_delay(attempt):\n    return 2 ** attempt\n\n\nclass RetryPolicy:\n    def should_retry(self, error):\n        return True\n",
    "app/__init__.py": "VERSION = 'one'\n",
    "docs/guide.md": "# Guide\n\nThe watcher notices new folders and waits until writes have settled before it syncs them.\n",
    "notes.yaml": "owner: platform team\npurpose: nightly sync of the search index\n",
    "data.bin": "a\0b",
    "node_modules/x.js": "function gone() {}\n",
    "kept.log": "important words here to keep in the index\n",
    "drop.log": "words that no one should find\n",
    ".gitignore": "node_modules/\n*.log\n!kept.log\n",
    "empty.txt": "",
}


@pytest.fixture
def root(tmp_path):
    for name, body in FILES.items():
        p = tmp_path / "ws" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return tmp_path / "ws"


def test_walk_prunes(root):
    assert [x[0] for x in workspace.walk(str(root))] == ["app/__init__.py", "app/retry_policy.py", "data.bin", "docs/guide.md", "empty.txt", "kept.log", "notes.yaml"]
    assert "docs/guide.md" not in [x[0] for x in workspace.walk(str(root), exclude_dirs=("docs",))]


def test_both_forms_of_rules_agree(spark):
    cases = [(p, d) for p in ("a/x.min.js", "a/Migrations", "a/migrations/b.cs", ".env", ".ok/a.txt", ".ok", "a/b.sql", "~a.docx", "a.tmp.1", "src/a.go", "a/b.tmp", "x/.git", "a.b/c") for d in (True, False)]
    df = spark.createDataFrame(cases, "p string, d boolean")
    how = {"exclude_exts": ("sql",), "allow_hidden": (".ok",), "exclude_dirs": ("b.tmp",)}
    a, b = (ignore.should_ignore(F.col("p"), F.lit(x), **how) for x in (True, False))
    for r in df.select("p", "d", F.when(F.col("d"), a).otherwise(b).alias("i")).collect():
        assert r["i"] == ignore.fixed_rule(r["p"], r["d"], **how), r


def test_sync_and_search(spark, root, tmp_path):
    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="hybrid"))
    assert e.ingest() | {"branch": 0, "default_branch": 0} == {"files": 5, "changed": 5, "deleted": 0, "branch": 0, "default_branch": 0}
    p = {(r["relative_path"], r["name"]): r for r in indexing.stored(spark, e.s.points).collect()}
    assert set(p) == {("app/retry_policy.py", "backoff_delay"), ("app/retry_policy.py", "should_retry"), ("app/__init__.py", "__init__.py"), ("docs/guide.md", ""), ("notes.yaml", ""), ("kept.log", "")}
    method = p["app/retry_policy.py", "should_retry"]
    assert method["container"] == "RetryPolicy" and {"function", "python", "pytest", "retry"} <= set(method["tags"]) and method["dense"] and method["sparse"]
    assert e.ingest()["changed"] == 0
    (root / "notes.yaml").unlink()
    (root / "docs/guide.md").write_text("A new text about the weather in the north and nothing else at all.\n")
    assert {k: v for k, v in e.ingest().items() if k in ("files", "changed", "deleted")} == {"files": 4, "changed": 1, "deleted": 1}
    q = indexing.stored(spark, e.s.points)
    assert q.where("relative_path = 'notes.yaml'").isEmpty() and q.where("contains(content, 'weather')").count() == 1 and q.count() == 5
    for mode in ("dense", "hybrid"):
        hits = retrieval.find(q, spark.createDataFrame([(1, "backoff_delay"), (2, "weather in the north")], "query_id int, query string"), mode)
        top = {r["query_id"]: r["relative_path"] for r in hits.where("position = 1").collect()}
        assert top == {1: "app/retry_policy.py", 2: "docs/guide.md"}
    assert "backoff_delay" in e.search("backoff_delay", ["py"], "app/") and "No relevant" in e.search("backoff", ["md"], "app")
    only = spark.createDataFrame([("kept.log",)], "path string")
    (root / "kept.log").unlink()
    (root / "app/__init__.py").write_text("VERSION = 'two'\n")
    assert e.ingest(only)["deleted"] == 1 and indexing.stored(spark, e.s.points).where("contains(content, 'one')").count() == 1


def test_branch_comes_first(spark, root, tmp_path):
    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse"))
    e.ingest()
    main = indexing.stored(spark, e.s.points)
    b = main.select("branch").first()[0]
    other = main.where("name = 'backoff_delay'").withColumns({"branch": F.lit("feature/x"), "default_branch": F.lit(b), "content": F.lit("def backoff_delay(): other")})
    hits = retrieval.find(main.unionByName(other), spark.createDataFrame([(1, "backoff delay guide watcher")], "query_id int, query string"), "sparse", branch="feature/x").collect()
    by = {(r["relative_path"], r["branch"]) for r in hits}
    assert ("app/retry_policy.py", "feature/x") in by and ("app/retry_policy.py", b) not in by and ("docs/guide.md", b) in by


def test_server(spark, root, tmp_path):
    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse"))

    def ask(method, **params):
        return cli.reply(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))

    assert ask("initialize")["result"]["protocolVersion"] and len(ask("tools/list")["result"]["tools"]) == 3
    assert "No relevant" in ask("tools/call", name="search", arguments={"query": "watcher"})["result"]["content"][0]["text"]
    assert json.loads(ask("tools/call", name="ingest_workspace")["result"]["content"][0]["text"])["files"] == 5
    assert "docs/guide.md" in ask("tools/call", name="search", arguments={"query": "watcher settled writes"})["result"]["content"][0]["text"]
    assert json.loads(ask("tools/call", name="get_sync_status")["result"]["content"][0]["text"])["syncs"] == 1
    assert ask("nothing")["error"]["code"] == cli.NO_METHOD and ask("tools/call", name="search", arguments={"query": 3})["error"]["code"] == cli.BAD_ARGUMENTS
    assert cli.reply(e, "{")["error"]["code"] == cli.PARSE_ERROR and cli.reply(e, '{"method": "x"}') is None


def test_settings(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / settings.FOLDER).mkdir()
    (tmp_path / settings.FOLDER / "settings.toml").write_text('workers = 9\nsearch_mode = "sparse"\nexclude_dirs = ["x", "y"]\nunknown = 1\n')
    s = settings.load({"batch_size": "7", "parser_mode": "none"}, {"CORPUSWEAVE_WORKERS": "3", "CORPUSWEAVE_SEARCH_MODE": ""}, str(inner))
    assert (s.workers, s.batch_size, s.search_mode, s.parser_mode, s.exclude_dirs) == (3, 7, "sparse", "full", ("x", "y"))
    assert settings.load({"max_bytes": "-4", "reconcile": "false"}, {}, str(inner)).max_bytes == 1 << 20


def test_change_stream(spark, root, tmp_path):
    spark.dataSource.register(workspace.Workspace)
    s = spark.readStream.format("workspace").option("log", str(tmp_path / "walks")).load(str(root))
    q = s.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (root / "notes.yaml").unlink()
    (root / "new.txt").write_text("x")
    q.processAllAvailable()
    q.stop()
    seen = [(r["path"], r["op"]) for r in spark.table("changes").collect()]
    assert ("app/retry_policy.py", "create") in seen and ("notes.yaml", "remove") in seen and ("new.txt", "create") in seen and not any("drop.log" in p for p, _ in seen)


def test_stop_words_and_dimension(spark, root, tmp_path):
    (root / "stopwords").write_text("# ours\nWatcher\n\n settled \n")
    s = settings.Settings(root=str(root), index=str(tmp_path / "idx"))
    assert s.stop_file() == str(root / "stopwords") and {"watcher", "settled", "the"} <= indexing.stop_words(spark, s)
    (root / settings.FOLDER).mkdir()
    (root / settings.FOLDER / "stopwords").write_text("other\n")
    assert s.stop_file() == str(root / settings.FOLDER / "stopwords") and settings.Settings(stop_words="x").stop_file() == "x"
    assert indexing.ensure_dimension(spark, s, lambda _: [0.0] * 3) == 3 == indexing.ensure_dimension(spark, s, lambda _: [1.0] * 3)
    with pytest.raises(ValueError, match="vectors of 3"):
        indexing.ensure_dimension(spark, s, lambda _: [0.0] * 4)


def test_flags_and_chunk_sizes():
    a = vars(cli.parser().parse_args(["search", "-s", "sparse", "-w3", "--most-chunk=900", "-o", "0", "what", "is it"]))
    s = settings.load(a, env={"CORPUSWEAVE_LEAST_CHUNK": "-5", "CORPUSWEAVE_BATCH_SIZE": "0"})
    assert (s.search_mode, s.workers, s.most_chunk, s.overlap, s.least_chunk, s.batch_size) == ("sparse", 3, 900, 0, 800, 100) and a["query"] == ["what", "is it"]


def test_answer_says_why(spark, root, tmp_path):
    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse", progress=True))
    e.ingest()
    assert e.status["state"] == "idle" and e.status["pending"] == e.status["active"] == 0 and e.status["total"] == 5
    out = e.search("should_retry RetryPolicy error")
    assert "Search intent: tags=`" in out and " | variants=" in out and "Signals: `" in out and "symbol-match:" in out and "```python\n" in out
    assert e.search("zzzz qqqq") .startswith("No relevant")


def test_watch_syncs_what_has_settled(spark, root, tmp_path, monkeypatch):
    """End to end: changes are synced once they are quiet, without any later change."""
    import time

    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse"))
    q = e.watch(str(tmp_path / "watch"))

    def until(test):
        for _ in range(240):
            if q.exception():
                raise q.exception()
            if test():
                return True
            time.sleep(0.5)

    def names():
        p = indexing.stored(spark, e.s.points)
        return {r["relative_path"] for r in p.select("relative_path").distinct().collect()} if p is not None and not e.status["active"] else set()

    def status():
        return json.loads(cli.reply(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "get_sync_status"}}))["result"]["content"][0]["text"])

    seen, sync = [], indexing.sync
    monkeypatch.setattr(indexing, "sync", lambda *a: (seen.append(status()), sync(*a))[1])
    try:
        assert until(lambda: "notes.yaml" in names())
        assert seen and all(x["state"] == "syncing" and x["active"] and x["watching"] for x in seen)  # as told while a batch was synced
        assert until(lambda: (now := status())["state"] == "idle" and now["total"] == 5 and now["pending_files"] == [] and now["batch"] >= 0 and now["error"] is None)
        (root / "notes.yaml").unlink()
        (root / "late.md").write_text("A late note about the harbour and the boats that lie in it.\n")
        assert until(lambda: "late.md" in names() and "notes.yaml" not in names())
    finally:
        q.stop()
    assert until(lambda: not e.progress.running)


def test_sync_rewrites_touched_buckets_only(spark, root, tmp_path):
    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse"))
    e.ingest()

    def parts():
        return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "idx").rglob("part-*.parquet")}

    before = parts()
    (root / "notes.yaml").write_text("owner: another team\npurpose: nightly sync of the index of another kind\n")
    (root / "kept.log").unlink()
    assert {k: v for k, v in e.ingest().items() if k in ("changed", "deleted")} == {"changed": 1, "deleted": 1}
    after, points = parts(), indexing.stored(spark, e.s.points)
    same = [p for p in before if after.get(p) == before[p]]
    assert len(same) >= 2 and len(after) <= len(before)
    assert {r["relative_path"] for r in points.collect()} == {"app/retry_policy.py", "app/__init__.py", "docs/guide.md", "notes.yaml"}
    assert "another" in points.where("relative_path = 'notes.yaml'").first()["content"]


def test_broken_sync_leaves_the_last_version(spark, root, tmp_path, monkeypatch):
    from corpusweave.operators import index

    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse"))
    e.ingest()

    def now():
        return {(r["relative_path"], r["content"]) for r in indexing.stored(spark, e.s.points).collect()}

    before = now()
    blocks = indexing.stored_postings(spark, e.s.points)
    assert {i for r in blocks.collect() for i in r["ids"]} == {r["point_id"] for r in indexing.stored(spark, e.s.points).collect()}
    (root / "notes.yaml").write_text("owner: someone else\npurpose: another text altogether\n")
    (root / "kept.log").unlink()
    publish = index.PointTable._publish

    def broken(self, now):
        raise OSError("killed")

    monkeypatch.setattr(index.PointTable, "_publish", broken)
    with pytest.raises(OSError, match="killed"):  # all is written, nothing is current
        e.ingest()
    assert now() == before and "platform" in e.search("platform team nightly") and e.status["active"] == 0
    monkeypatch.setattr(index.PointTable, "_publish", publish)
    assert {k: v for k, v in e.ingest().items() if k in ("changed", "deleted")} == {"changed": 1, "deleted": 1}
    assert {p for p, _ in now()} == {p for p, _ in before} - {"kept.log"} and any("altogether" in c for _, c in now())
    assert "No relevant" in e.search("platform") and "altogether" in e.search("altogether")


def test_stored_postings_give_what_all_vectors_give(spark, root, tmp_path):
    e = cli.Engine(spark, settings.Settings(root=str(root), index=str(tmp_path / "idx"), search_mode="sparse"))
    e.ingest()
    p, blocks = indexing.stored(spark, e.s.points), indexing.stored_postings(spark, e.s.points)
    q = spark.createDataFrame([(1, "retry policy should_retry"), (2, "watcher notices new folders"), (3, "zzz")], "query_id int, query string")
    for how in ({}, {"exts": ["py"], "branch": e.status["branch"]}):
        a, b = (retrieval.find(p, q, "sparse", postings=x, **how).select("query_id", "position", "point_id", "score").collect() for x in (None, blocks))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a

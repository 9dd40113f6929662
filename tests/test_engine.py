"""Small cases of text, chunks, code, ignore rules, documents, embedding and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusweave.functions import text
from corpusweave.operators import chunking, code, embedding, search
from corpusweave.sources import files, ignore
from corpusweave.streaming import watch


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column).first()[0]


def test_camel_and_tokens(spark):
    assert one(spark, text.tag_tokens(F.col("t")), t="src/HTTPServer2Go_userID.go") == ["go", "httpserver2", "id", "src", "user"]


def test_soft_breaks_and_noise(spark):
    assert one(spark, text.merge_soft_breaks(F.col("t")), t="a\nb\n\n\nc") == "a b\n\n\nc"
    assert one(spark, text.drop_noisy_lines(F.col("t")), t="ok\n-----\n\nx1") == "ok\n\nx1"


def test_line_chunks_quirks(spark):
    assert one(spark, chunking.line_chunks(F.col("t"), 4), t="abcdef\nx\n") == ["", "abcdef\n", "x\n\n"]


def test_overlap_cuts_bytes():
    parts = chunking.split_overlapping(b"aaaa. bbbb cccc dddd", 10, 2)
    assert all(len(p) <= 10 for p in parts) and parts[0] == b"aaaa. bbbb"
    assert chunking.merge_paragraphs(b"a\n\nb\n\n" + b"c" * 30, 5, 10, 0) == [b"a\n\nb", b"c" * 10, b"c" * 10, b"c" * 10]


def test_point_id(spark):
    assert one(spark, text.point_id(F.col("t")), t="a_chunk_0").count("-") == 4


def test_go_file():
    src = 'package main\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype Greeter struct{}\n\nfunc Hello() {}\n\nfunc (g *Greeter) Greet() { s := "}" }\n'
    r = code.parse("main.go", src)
    assert r["namespace"] == "main" and r["types"] == ["Greeter"] and [i["raw_path"] for i in r["imports"]] == ["fmt", "os"]
    assert [(f["name"], f["container"], f["start_line"]) for f in r["functions"]] == [("Hello", "", 10), ("Greet", "Greeter", 12)]


def test_other_languages():
    py = code.parse("s.py", "import os\ndef calculate_sum(a):\n    return a\nclass Math:\n    def mul(self): pass\n")
    assert [(f["name"], f["container"]) for f in py["functions"]] == [("calculate_sum", ""), ("mul", "Math")]
    cs = code.parse("T.cs", "using Xunit;\nnamespace App.Tests;\npublic class T\n{\n    public void Runs()\n    {\n    }\n}\n")
    assert cs["namespace"] == "App.Tests" and cs["types"] == ["T"] and [(f["name"], f["container"]) for f in cs["functions"]] == [("Runs", "T")]
    assert code.parse("notes.js", "1 + 1")["functions"][0]["name"] == "notes.js"


@pytest.mark.parametrize(
    "path,is_dir,want",
    [("a.log", False, True), ("important.log", False, False), ("node_modules", True, True), ("node_modules/x.js", False, True), ("dist/a", False, True), ("src/dist/a", False, False), (".git/config", False, True), ("src/a.go", False, False)],
)
def test_ignore_files(spark, path, is_dir, want):
    rules = [r for k, x in enumerate(["*.log", "node_modules/", "/dist", "!important.log", "# no"]) if (r := ignore.compile_rule(x, k))]
    df = spark.sql(f"SELECT '{path}' AS path, {str(is_dir).lower()} AS is_dir")
    assert ignore.ignored_by_rules(df, ignore.rules_frame(spark, rules)).first()["ignored"] == want


@pytest.mark.parametrize(
    "path,is_dir,want",
    [("a/x.min.js", False, True), ("a/Migrations", True, True), ("a/migrations/b.cs", False, True), (".env", False, True), (".ok/a.txt", False, False), ("a/b.sql", False, True), ("~a.docx", False, True), ("a.tmp.1", False, True), ("a/b.go", False, False)],
)
def test_fixed_rules(spark, path, is_dir, want):
    assert one(spark, ignore.should_ignore(F.col("p"), F.lit(is_dir), exclude_exts=("sql",), allow_hidden=(".ok",)), p=path) == want


def test_office_files():
    def packed(name, xml):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, xml)
        return b.getvalue()

    assert files.docx_text(packed("word/document.xml", "<d><p><t>Hello</t><tab/><t>x</t></p><p><t>b</t></p></d>")) == "Hello x\nb\n"
    assert files.xlsx_text(packed("xl/sharedStrings.xml", "<s><si><t>a</t></si></s>")) == "a\n\n"
    assert files.read_document("doc", b"")[1] and files.read_document("txt", b"\xff")[1]


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hi\x00")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    r = files.workspace_scan(spark, str(tmp_path), 50).select("relative_path", files.is_binary(F.col("content"), F.lit("txt")).alias("b")).collect()
    assert [(x[0], x[1]) for x in r] == [("a/x.txt", True)]


def test_limit_and_retries():
    lim = embedding.Limit(4)
    trace = []
    for f in (lim.failure, lim.failure, lim.failure, *[lambda: lim.success(10)] * 5, lambda: lim.success(2000)):
        f()
        trace.append(lim.now)
    assert trace == [2, 1, 1, 1, 1, 1, 1, 2, 1]
    answers = iter([OSError(), OSError(), [1.0]])

    def call(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert embedding.with_retries(call, lim, lambda s: None)("q") == [1.0]


def test_embed(spark):
    r = embedding.embed(spark.createDataFrame([(1, "a b")], "id int, t string"), "t", embedding.hashed(8)).first()
    assert len(r["dense"]) == 8


def test_all_tasks_share_the_calls_of_a_server(spark):
    import http.server
    import json
    import threading
    import time

    assert embedding.shares(1) == [1] and embedding.shares(5) == [5] and embedding.shares(12) == [4, 4, 4] and embedding.shares(7) == [4, 3]
    now, most, asked, lock = [0], [0], [], threading.Lock()

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                asked.append(prompt)
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            body = json.dumps({"embedding": [float(prompt), 1.0]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    class Server(http.server.ThreadingHTTPServer):
        request_queue_size = 64

    server = Server(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        d = spark.range(0, 300, 1, 8).selectExpr("id", "cast(id AS string) AS t")
        got = embedding.embed(d, "t", embedding.http_call(f"http://127.0.0.1:{server.server_port}", "m"), 7, shared=True)
        assert got.rdd.getNumPartitions() == 2
        assert {r["id"]: r["dense"] for r in got.collect()} == {i: [float(i), 1.0] for i in range(300)}
    finally:
        server.shutdown()
    assert len(asked) == 300 and 2 <= most[0] <= 7


def test_changes(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1)], "relative_path string, modified long, length long")
    b = spark.createDataFrame([("x", 2, 1), ("z", 1, 1)], "relative_path string, modified long, length long")
    assert sorted(map(tuple, watch.snapshot_changes(a, b).collect())) == [("x", "write"), ("y", "remove"), ("z", "create")]


def test_debounce_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("SELECT 'a' AS path, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:00:00.5' UNION ALL SELECT 'a', timestamp'2024-01-01 00:10:00'").write.parquet(str(src))
    s = spark.readStream.schema("path string, ts timestamp").parquet(str(src))
    q = watch.debounce(s).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n_events"] for r in spark.table("bursts").collect()] == [2]


def test_prefix_filter_strips_slashes(spark):
    d = spark.sql("SELECT 'md' AS extension, 'a/b/c.md' AS relative_path, array('a/b', 'a') AS relative_dirs, 'main' AS branch")
    assert d.where(search.search_filter([".MD"], "/a/b/", "main")).count() == 1 and d.where(search.search_filter(None, "a/x")).count() == 0


@pytest.mark.parametrize(
    "name,src,want",
    [
        ("a.go", "package p\n\nfunc F() interface{} {\n\treturn nil\n}\n", [("F", 3, 5)]),
        ("a.go", "package p\nfunc G(m map[string]struct{}) (x struct{ A int }, err error) {\n\treturn\n}\n", [("G", 2, 4)]),
        ("a.ts", "function load(a: { b: number }): { a: number } {\n  return a;\n}\n", [("load", 1, 3)]),
        ("a.ts", "class C {\n  get(x: string): Promise<{ a: number }> {\n    return x;\n  }\n}\nconst f = (a: number) => {\n  return a;\n};\n", [("get", 2, 4), ("f", 6, 8)]),
        ("a.ts", "const g = async (x) => x + 1;\nfunction h(): void;\n", [("g", 1, 1), ("h", 2, 2)]),
        ("a.cs", "public class C\n{\n    public int Twice(int x) => x * 2;\n    private void Go()\n    {\n        var a = new { B = 1 };\n    }\n}\n", [("Twice", 3, 3), ("Go", 4, 7)]),
        ("a.php", "<?php\nclass U {\n    private static function a(): ?array {\n        return [];\n    }\n}\n", [("a", 3, 5)]),
    ],
)
def test_bodies_behind_result_types(name, src, want):
    assert [(f["name"], f["start_line"], f["end_line"]) for f in code.parse(name, src)["functions"]] == want


def test_gate_follows_its_limit():
    import threading
    import time

    limit, now, most, lock = embedding.Limit(4), [0], [0], threading.Lock()
    gate = embedding.Gate(limit)

    def call(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return [1.0]

    def burst():
        most[0] = 0
        threads = [threading.Thread(target=gate, args=(call, "x")) for _ in range(12)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        return most[0]

    assert 1 < burst() <= 4
    limit.failure()
    limit.failure()
    assert burst() == 1


def test_payloads(spark):
    assert one(spark, text.first_full(F.col("a"), F.col("b")), a="  ", b=" x ") == " x "
    assert spark.sql("select array(' A', '', 'b ') as l, cast(null as array<string>) as n").select(text.payload_list(F.col("l")), text.payload_list(F.col("n"))).first()[:] == (["a", "b"], [])
    assert files.sanitised(b"a\xffb\tc\x01") == "ab\tc" and files.sanitised("é".encode()) == "é"


def test_pages_that_fail():
    class Page:
        def __init__(self, *found):
            self.found = found

        def extract_text(self, extraction_mode="plain"):
            x = self.found[extraction_mode == "plain"]
            if x is None:
                raise ValueError("bad page")
            return x

    assert [files.page_text(p) for p in (Page(" a   b \nc", ""), Page(None, "plain"), Page(None, None))] == ["a b\nc", "plain", ""]


def test_branches(tmp_path):
    import subprocess

    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    assert files.branches(str(tmp_path)) == ("main", "main")
    git("init", "-b", "master")
    (tmp_path / "a").write_text("x")
    git("add", "a")
    git("commit", "-m", "one")
    assert files.branches(str(tmp_path)) == ("master", "master")
    git("checkout", "-b", "feature/x")
    assert files.branches(str(tmp_path)) == ("feature/x", "master")
    git("branch", "main")
    assert files.branches(str(tmp_path)) == ("feature/x", "main")
    git("checkout", "--detach")
    assert files.branches(str(tmp_path))[0] == "main"


def brute_paragraph_chunks(page, least, most, overlap):
    """Another reading of the same rules, on whole strings of one-byte characters."""
    out, open_ = [], ""
    for p in [x.strip() for x in page.replace("\r\n", "\n").split("\n\n") if x.strip()]:
        p = " ".join(p.split("\n"))
        if len(p) <= most:
            open_ = f"{open_}\n\n{p}" if open_ else p
            if len(open_) >= least:
                out, open_ = [*out, open_], ""
            continue
        out, open_ = out + ([open_] if open_ else []), ""
        while len(p) > most:
            half = most // 2
            cut = p.rfind(". ", half + 1, most)
            cut = cut + 1 if cut > half else p.rfind(" ", half + 1, most) if p.rfind(" ", half + 1, most) > half else most
            out.append(p[:cut].strip())
            p = p[cut - overlap if cut > overlap else cut :].strip()
        out += [p] if p else []
    return out + ([open_] if open_ else [])


def test_paragraph_chunks_by_brute_force(spark):
    import random

    r = random.Random(3)
    docs = ["\n\n".join("\n".join(" ".join(r.choice(["word", "end.", "more"]) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 5))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got: dict = {}
    for x in chunking.paragraph_chunks(d, "id", "text", 40, 100, 15).orderBy("id", "at", "k").collect():
        got.setdefault(x["id"], []).append(x["content"])
    assert [got[i] for i in range(len(docs))] == [brute_paragraph_chunks(t, 40, 100, 15) for t in docs]

"""Code extraction: the shapes of each language, by name, container and lines."""

import pytest

from corpusweave.operators import code


def names(path, src):
    return [(f["name"], f["container"]) for f in code.parse(path, src)["functions"]]


def lines(path, src):
    return [(f["name"], f["start_line"], f["end_line"]) for f in code.parse(path, src)["functions"]]


def paths(path, src):
    return [(i["raw_path"], i["alias"]) for i in code.parse(path, src)["imports"]]


JS = r"""
import def, { a as b } from 'one';
import 'two';
import * as ns from "three"
export { q } from './four';
const five = require('five');
// function no() {}
/* function no2() {} */
const text = "function no3() {}", re = /[/"'`{]+function no4\(\) \{/g, ratio = 4 / 2 / 1;
const tpl = `function no5() { ${ (() => { const inner = (x) => x; return inner(1); })() } ${`${1}`} }`;
export default async function load(a = {}, [b, c] = [1, 2]) { return `}`; }
function plain() { if (a) /}/.test(b); }
const arrow = async (x) => { return x; };
const one = x => x + 1, two = (y) =>
  y * 2;
let three = (a) => ({ a })
const notArrow = function named() {};
function* gen() {}
class Q extends mixin({ m() { return 1; } }) { static async *n() {} get v() { return 1 } #hidden() {} ['computed']() {} field = () => { const deep = () => 1; }
  constructor(a) { super(a) }
  other = 5
  last() { }
}
const o = { om() { return 1; }, async an() {}, k: function () {}, v: 1, get g() { return 2; } };
export const El = () => <div className="a">don't { list.map(x => <b key={x}>it's</b>) }</div>;
(function iife() {})();
export class Named { run() {} }
const Expr = class Inner { go() {} };
"""


def test_javascript_shapes():
    r = code.parse("a.js", JS)
    got = [(f["name"], f["container"]) for f in r["functions"]]
    want = [("inner", ""), ("load", ""), ("plain", ""), ("arrow", ""), ("one", ""), ("two", ""), ("three", ""), ("m", ""), ("n", "Q"), ("v", "Q"), ("deep", "Q"), ("constructor", "Q"), ("last", "Q")]
    want += [("om", ""), ("an", ""), ("g", ""), ("El", ""), ("run", "Named"), ("go", "Inner")]
    assert sorted(got) == sorted(want)
    assert r["types"] == ["Q", "Named"]
    assert [i["raw_path"] for i in r["imports"]] == ["one", "two", "three", "./four", "five"]
    two = next(f for f in r["functions"] if f["name"] == "two")
    assert two["content"] == "const one = x => x + 1, two = (y) =>\n  y * 2;"


TS = r"""
import type { T } from './t'
import React, { useState } from "react";
export default async function load<T extends { a: number }>(x: T, f: (y: string) => void): Promise<{ a: number }> {
  return x;
}
const useX = async <T,>(a: T) => { return a; };
const typed: (a: number) => string = (a) => String(a);
function over(a: string): void;
function over(a: number): void;
function over(a: any): asserts a is string { }
export abstract class Repo<T extends Base<T>> extends Other<Map<string, T>> implements A, B {
  private readonly x: { a: number } = { a: 1 };
  constructor(private readonly a: string) { super(); }
  abstract find(id: string): T;
  @decorated({ a: 1 }) public async get<K extends keyof T>(k: K): Promise<T[K]> { return this.x as any; }
  static of(): Repo<any> { return null!; }
  handler = async (e: Event): Promise<void> => { };
  optional?(): void { }
}
interface Shape { area(): number; nested: { deep(): void } }
type Alias<T> = T extends string ? { a: T } : never;
export enum Color { Red = 'r', Green = 'g' }
declare function outside(a: string): void;
namespace Inner { export function within() { return 1 < 2 && 3 > 2; } }
export const config = { method(a: number): string { return `${a}`; }, arrow: (a: number) => a };
"""


def test_typescript_shapes():
    r = code.parse("src/a.tsx", TS)
    assert [(f["name"], f["container"]) for f in r["functions"]] == [
        ("load", ""), ("useX", ""), ("typed", ""), ("over", ""), ("over", ""), ("over", ""), ("constructor", "Repo"), ("get", "Repo"), ("of", "Repo"), ("optional", "Repo"), ("outside", ""), ("within", ""), ("method", ""),
    ]
    assert sorted(r["types"]) == ["Alias", "Color", "Repo", "Shape"]
    assert [i["raw_path"] for i in r["imports"]] == ["./t", "react"]
    assert lines("a.ts", TS)[0] == ("load", 4, 6)
    assert names("w.tsx", "import React from 'react'\nimport { describe, it } from 'vitest'\n\nexport function UserList() { return <div /> }\n") == [("UserList", "")]


GO = r"""
// Package p
package p

import (
	"fmt"
	alias "github.com/a/b"
	. "dot"
	_ `raw/path`
)
import "single"

type Store[T any] struct {
	items map[string]interface{}
	f     func(a int) struct{ b int }
}

type (
	A struct{ x int }
	B interface {
		Method(a int) error
		int | string
	}
	C = A
	D func(a int) error
)
type Old = A

func Plain() interface{} { return `}` }
func Generic[K comparable, V any](m map[K]V) (keys []K, err error) {
	f := func(x int) { fmt.Println('}', "}") }
	return
}
func (s *Store[T]) Get(k string) map[string]struct{} {
	return nil
}
func (Store[T]) NoName() chan struct{} { return nil }
func asm(a int) int
func last(f func(a int) (b int, c error)) struct{ x int } { type local struct{}; return struct{ x int }{1} }
"""


def test_go_shapes():
    r = code.parse("a.go", GO)
    assert [(f["name"], f["receiver"], f["container"]) for f in r["functions"]] == [
        ("Plain", "", ""), ("Generic", "", ""), ("Get", "(s *Store[T])", "T"), ("NoName", "(Store[T])", "T"), ("asm", "", ""), ("last", "", ""),
    ]
    assert r["types"] == ["Store", "A", "B", "D", "local"] and r["namespace"] == "p"
    assert [(i["raw_path"], i["alias"]) for i in r["imports"]] == [("fmt", ""), ("github.com/a/b", "alias"), ("dot", "."), ("raw/path", "_"), ("single", "")]
    at = GO.split("\n").index("func (s *Store[T]) Get(k string) map[string]struct{} {") + 1
    assert lines("a.go", GO)[1:3] == [("Generic", at - 4, at - 1), ("Get", at, at + 2)]
    greet = "\npackage main\n\nimport \"fmt\"\n\n// Hello is a greeting function\nfunc Hello(name string) string {\n\treturn fmt.Sprintf(\"Hello, %s\", name)\n}\n\ntype Greeter struct{}\n\nfunc (g Greeter) Greet(name string) {\n\tfmt.Println(\"Hi \" + name)\n}\n"
    r = code.parse("main.go", greet)
    assert [(f["name"], f["start_line"], f["receiver"], f["container"]) for f in r["functions"]] == [("Hello", 7, "", ""), ("Greet", 13, "(g Greeter)", "Greeter")]
    assert r["types"] == ["Greeter"] and r["namespace"] == "main" and paths("main.go", greet) == [("fmt", "")]


CS = r'''
#region using }
global using System;
using System.Text;
using static System.Math;
using Json = Newtonsoft.Json.JsonConvert;
#endregion
namespace App.Tests;

public record P(int X);
public record struct V(int A) { public int Twice() => A * 2; }
public interface IRun<T> where T : class, new() { Task Run(int a); string Name { get; } void Both() { } }
[Serializable]
public sealed class Box<T> : IRun<T>, IDisposable where T : class
{
    private readonly Dictionary<string, List<int>> map = new() { ["}"] = new() };
    public int Count { get; private set; } = Compute(1);
    public Func<int, int> F => x => x + 1;
    public event EventHandler Changed;
    public delegate void Handler(int a);
    public Box(int a) : base(a) { }
    ~Box() { }
    void Hidden() { }
    [Fact, Trait("a", "}")]
    public async Task<List<int>> Load<K>(K k, string s = "}") where K : struct { var v = @"a ""}"; var i = $"{map["k"]} {{ {(1 + 2)}"; int Local(int q) { return q; } return null; }
    public (int A, string B) Pair() => (1, "x");
    public static Box<T> operator +(Box<T> a, Box<T> b) => a;
    void IDisposable.Dispose() { using (var x = new X()) { } using var y = Open(); }
    protected abstract int Abstract(int[] a);
    public int this[int i] { get { return 1; } }
    string raw = """
        } "quoted" {
        """;
    int?[] Arrays(params int[] a) { return null; }
    private struct Inner { internal void Deep() { } }
    enum Kind { A, B }
}
'''


def test_csharp_shapes():
    r = code.parse("T.cs", CS)
    assert [(f["name"], f["container"]) for f in r["functions"]] == [
        ("Twice", ""), ("Both", "IRun"), ("Run", "IRun"), ("Hidden", "Box"), ("Load", "Box"), ("Pair", "Box"), ("Dispose", "Box"), ("Abstract", "Box"), ("Arrays", "Box"), ("Deep", "Inner"),
    ]
    assert r["types"] == ["P", "V", "IRun", "Box", "Inner", "Kind"] and r["namespace"] == "App.Tests"
    assert [(i["raw_path"], i["alias"]) for i in r["imports"]] == [("System", ""), ("System.Text", ""), ("System.Math", ""), ("Newtonsoft.Json.JsonConvert", "Json")]
    load = next(f for f in r["functions"] if f["name"] == "Load")
    assert load["content"].startswith("[Fact, Trait") and load["content"].endswith("return null; }")
    block = "using Xunit;\nnamespace A.B\n{\n    using C.D;\n    class T { public void Runs() {} }\n}\n"
    r = code.parse("B.cs", block)
    assert (r["namespace"], paths("B.cs", block), names("B.cs", block)) == ("A.B", [("Xunit", ""), ("C.D", "")], [("Runs", "T")])


PHP = r"""<html><?php echo "function no() {"; ?> it's function no2() {
<?php
namespace App\Models;
use A\{B, C as D};
use Illuminate\Model as Base;
use function A\helper;
use E\F, G\H;
# function no3() {
function &byRef(array $a = ['}']): ?string { return <<<EOT
it's { $x
  EOT; }
$f = function ($x) use ($y) { return fn($z) => $z; };
abstract class U extends Base implements I {
    use SomeTrait;
    public const X = 'it\'s';
    public function name() { return "{$this->a['k']}"; }
    abstract protected function none(int $a): int;
    final public static function of() { return static::class; }
    #[Attr('}')]
    private function attr() { return <<<'RAW'
don't }
RAW;
    }
}
interface I { public function decl(); }
trait T { function mixed() {} }
enum Suit: string { case A = 'a'; public function label() { return 1; } }
$anon = new class { function inside() {} };
if (true) { function nested() {} }
?>
tail's text
"""


def test_php_shapes():
    r = code.parse("u.php", PHP)
    assert [(f["name"], f["container"]) for f in r["functions"]] == [
        ("byRef", ""), ("name", "U"), ("none", "U"), ("of", "U"), ("attr", "U"), ("decl", "I"), ("mixed", ""), ("label", ""), ("inside", ""), ("nested", ""),
    ]
    assert r["types"] == ["U", "I", "T"] and r["namespace"] == "App\\Models"
    assert [(i["raw_path"], i["alias"]) for i in r["imports"]] == [("A\\B", ""), ("A\\C", "D"), ("Illuminate\\Model", "Base"), ("A\\helper", ""), ("E\\F", ""), ("G\\H", "")]


PY = '''
import os, numpy as np
from a.b import (
    c, d,
)
class Math:
    """def no(): pass"""
    @property
    def multiply(self, x, y):
        def inner():
            return 1
        return x * y
    async def later(self): pass
def top(a,
        b): return a
'''


def test_python_shapes_whole_and_broken():
    want = [("multiply", "Math", 9, 12), ("inner", "Math", 10, 11), ("later", "Math", 13, 13), ("top", "", 14, 15)]
    for src in (PY, PY + "print 'old'\n"):
        r = code.parse("m.py", src)
        assert [(f["name"], f["container"], f["start_line"], f["end_line"]) for f in r["functions"]] == want
        assert r["types"] == ["Math"] and [(i["raw_path"], i["alias"]) for i in r["imports"]] == [("os", ""), ("numpy", "np"), ("a.b", "")]


@pytest.mark.parametrize("name", ["a.js", "a.ts", "a.go", "a.cs", "a.php", "a.py"])
def test_broken_files_give_something(name):
    for whole in (JS, TS, GO, CS, PHP, PY):
        for cut in range(0, len(whole), 37):
            for src in (whole[:cut], whole[cut:]):
                assert code.parse(name, src)["functions"]
    for src in ("", "`" * 1001, "${" * 500, "{" * 3000, "}" * 3000, "<<<A\n", '"""', '$"{', "'", "class", "function", "const", "const a =", "type (", "func", "using", "use", "/" * 99, "<" * 2000 + "a"):
        assert code.parse(name, src)["functions"][0]["name"] == name


def test_tags_of_tests_in_other_languages():
    assert names("h.go", "package api\n\nimport (\n\t\"github.com/gin-gonic/gin\"\n\t\"github.com/stretchr/testify/require\"\n)\n\nfunc TestHandler() {}\n") == [("TestHandler", "")]
    assert paths("t.py", "from fastapi import FastAPI\nimport pytest\n\ndef test_orders_api():\n    assert True\n") == [("fastapi", ""), ("pytest", "")]
    assert paths("U.php", "<?php\nuse PHPUnit\\Framework\\TestCase;\nuse Doctrine\\ORM\\EntityManager;\nclass UserRepositoryTest extends TestCase {}\n") == [("PHPUnit\\Framework\\TestCase", ""), ("Doctrine\\ORM\\EntityManager", "")]


def test_rules_meet_paths_by_folder(spark):
    """Rules of nested ignore files, against the walk's own reading of them."""
    import random

    from pyspark.sql import functions as F

    from corpusweave.sources import ignore

    lines = [("", "*.log"), ("", "node_modules/"), ("", "/dist"), ("", "!important.log"), ("src/nested", "nested_ignored.txt"), ("src", "build/**"), ("src", "!keep/"), ("src/nested", "*.md"), ("src/nested", "!a.md"), ("a", "/b?"), ("a/b", "c/*.x")]
    rules = [r for k, (base, line) in enumerate(lines) if (r := ignore.compile_rule(line, k, base))]
    want = {("app.log", False): True, ("src/app.log", False): True, ("important.log", False): False, ("node_modules", True): True, ("node_modules/module", False): True, ("dist", True): True, ("src/dist", True): False}
    want |= {("src/nested/nested_ignored.txt", False): True, ("nested_ignored.txt", False): False, (".git", True): True, (".git/config", False): True}
    r = random.Random(3)
    names = ["a", "b", "b1", "c", "src", "nested", "build", "keep", "dist", "x.log", "important.log", "a.md", "q.x", ".git", "node_modules", "nested_ignored.txt"]
    more = {("/".join(r.choice(names) for _ in range(r.randint(1, 5))), r.random() < 0.3) for _ in range(300)}
    for p, d in more:
        parts = p.split("/")
        own = [("/".join(parts[:i]), i < len(parts) or d) for i in range(1, len(parts) + 1)]
        want.setdefault((p, d), ".git" in parts or any(ignore.rule_hits(rules, x, y) for x, y in own))
    found = ignore.ignored_by_rules(spark.createDataFrame(list(want), "path string, is_dir boolean"), ignore.rules_frame(spark, rules))
    assert {(x["path"], x["is_dir"]): x["ignored"] for x in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where(F.col("ignored")).count() > 50


def test_declarations_are_held_for_few_files_at_a_time():
    import pandas as pd

    from corpusweave.operators import code

    n = 3 * code.ROWS + 5
    paths, texts = pd.Series([f"a{i}.py" for i in range(n)]), pd.Series([f"def f{i}():\n    pass\n" if i % 9 else None for i in range(n)])
    out = list(code._pieces(iter([(paths, texts), (paths[:0], texts[:0]), (paths[:1], texts[:1])])))
    assert max(map(len, out)) <= code.ROWS and sum(map(len, out)) == n + 1
    got = pd.concat(out[:-1])["functions"].tolist()
    assert got == [code.parse(p, t or "")["functions"] for p, t in zip(paths, texts)]


def test_chunks_are_held_for_few_pages_at_a_time():
    import pyarrow as pa

    from corpusweave.operators import chunking

    n = 3 * chunking.ROWS + 5
    pages = [f"{i} " + "word " * (i % 400) if i % 7 else None for i in range(n)]
    b = pa.RecordBatch.from_pydict({"id": list(range(n)), "page_number": [0] * n, "at": [0] * n, "page": pages})
    out = list(chunking._pieces(b, 80, 400, 20))
    assert len(out) == 4 and all(len(set(x.column("id").to_pylist())) <= chunking.ROWS for x in out)
    want = [(i, c.decode()) for i, t in enumerate(pages) for c in chunking.merge_paragraphs((t or "").encode(), 80, 400, 20)]
    assert [(i, c) for x in out for i, c in zip(x.column("id").to_pylist(), x.column("content").to_pylist())] == want

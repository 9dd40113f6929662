"""Source files with known declarations: for each language, pieces of code and what is declared in them.

A file holds a document's whole text as its first comment and then all pieces of its language; `§` stands for the document's
id. A piece is its lines and the functions in it: name, container, first and last line in the piece, and its text where that
isn't just those lines (without an `export` before them).
"""

from __future__ import annotations

Function = tuple[str, str, int, int, str | None]

#: By extension: the language, its label, namespace, imports as (path, alias), what opens and closes a comment of many lines, pieces.
SHAPES: dict[str, tuple[str, str, list[tuple[str, str]], tuple[str, str], list[tuple[str, list[Function]]]]] = {
    "js": ("javascript", "", [("react", ""), ("./styles.css", ""), ("./lib", ""), ("./all", ""), ("jest", "")], ("/* ", " */"), [
        ("import a, { b as c } from 'react';\nimport './styles.css';\nimport * as lib from \"./lib\";\nexport * from './all';\nconst j = require('jest');", []),
        ("function plain§(a, { b }, [c] = [1]) {\n  return '}';\n}", [("plain§", "", 0, 2, None)]),
        ("export default async function load§(a) {\n  return a;\n}", [("load§", "", 0, 2, None)]),
        ("const arrow§ = async (x) => {\n  return x;\n};", [("arrow§", "", 0, 2, None)]),
        ("const short§ = x => x + 1", [("short§", "", 0, 0, None)]),
        ("const first§ = (x) => x, second§ = (y) => {\n  return y;\n};", [("first§", "", 0, 2, None), ("second§", "", 0, 2, None)]),
        ("const re§ = /[/\"'`{]+function no1\\(\\) \\{/g, half§ = 4 / 2 / 1;", []),
        ("const tpl§ = `function no2() { ${ [1].map((x) => `${x} {`) } }`;", []),
        ("class Box§ extends Base {\n  one() { return `}`; }\n  static async *two(a) {\n    yield a;\n  }\n  get size() { return 1 }\n  #own() {}\n  field = 5\n}", [("one", "Box§", 1, 1, None), ("two", "Box§", 2, 4, None), ("size", "Box§", 5, 5, None)]),
        ("class Line§ { m§() { return 1; } static async n§() {} }", [("m§", "Line§", 0, 0, "m§() { return 1; }"), ("n§", "Line§", 0, 0, "static async n§() {}")]),
        ("export const obj§ = {\n  method§(a) {\n    return { a };\n  },\n  k: function () {},\n};", [("method§", "", 1, 3, "method§(a) {\n    return { a };\n  }")]),
        ("function* gen§() {}\n(function iife§() {})();\nconst no3§ = function named§() {};", []),
        ("if (a) { function nested§() {} }", [("nested§", "", 0, 0, "function nested§() {}")]),
    ]),
    "ts": ("typescript", "", [("./types", ""), ("vitest", "")], ("/* ", " */"), [
        ("import type { T } from './types'\nimport def, { it } from \"vitest\";", []),
        ("export default async function load§<T extends { a: number }>(x: T, f: (y: string) => void): Promise<{ a: number }> {\n  return x;\n}", [("load§", "", 0, 2, None)]),
        ("const useX§ = async <T,>(a: T) => {\n  return a;\n};", [("useX§", "", 0, 2, None)]),
        ("const typed§: (a: number) => string = (a) => String(a);", [("typed§", "", 0, 0, None)]),
        ("function over§(a: string): void;\nfunction over§(a: any): asserts a is string { }", [("over§", "", 0, 0, None), ("over§", "", 1, 1, None)]),
        ("export abstract class Repo§<T extends Base<T>> extends Other<Map<string, T>> implements A, B {\n  private readonly x: { a: number } = { a: 1 };\n  constructor(private readonly a: string) { super(); }\n  abstract find(id: string): T;", [("constructor", "Repo§", 2, 2, None)]),
        ("  public async get<K extends keyof T>(k: K): Promise<T[K]> {\n    return this.x as any;\n  }\n  optional?(): void { }\n}", [("get", "Repo§", 0, 2, None), ("optional", "Repo§", 3, 3, None)]),
        ("interface Shape§ { area(): number; nested: { deep(): void } }", []),
        ("type Alias§<T> = T extends string ? { a: T } : never;\nexport enum Color§ { Red = 'r' }", []),
        ("declare function outside§(a: string): void;", [("outside§", "", 0, 0, "function outside§(a: string): void;")]),
        ("namespace Inner§ {\n  export function within§() { return 1 < 2 && 3 > 2; }\n}", [("within§", "", 1, 1, None)]),
        ("export const conf§ = {\n  method§(a: number): string { return `${a}`; },\n};", [("method§", "", 1, 1, "method§(a: number): string { return `${a}`; }")]),
        ("class Deco§ {\n  @memo({ a: 1 })\n  load(): number[] { return []; }\n}", [("load", "Deco§", 2, 2, None)]),
    ]),
    "go": ("go", "p", [("fmt", ""), ("github.com/gin-gonic/gin", "web"), ("raw/path", "_"), ("testing", "")], ("/* ", " */"), [
        ("package p\n\nimport (\n\t\"fmt\"\n\tweb \"github.com/gin-gonic/gin\"\n\t_ `raw/path`\n)\nimport \"testing\"", []),
        ("type Store§[T any] struct {\n\titems map[string]interface{}\n}", []),
        ("type (\n\tA§ struct{ x int }\n\tB§ interface {\n\t\tMethod(a int) error\n\t}\n)", []),
        ("func Plain§() interface{} {\n\treturn `}`\n}", [("Plain§", "", 0, 2, None)]),
        ("func Generic§[K comparable, V any](m map[K]V) (keys []K, err error) {\n\tf := func(x int) { fmt.Println('}', \"}\") }\n\treturn\n}", [("Generic§", "", 0, 3, None)]),
        ("func (s *Store§) Get(k string) map[string]struct{} {\n\treturn nil\n}", [("Get", "Store§", 0, 2, None)]),
        ("func (Store§) NoName() chan struct{} { return nil }", [("NoName", "Store§", 0, 0, None)]),
        ("func (s *Store§[T]) Put(v T) { }", [("Put", "T", 0, 0, None)]),
        ("func asm§(a int) int", [("asm§", "", 0, 0, None)]),
        ("func taker§(f func(a int) (b int, c error)) struct{ x int } {\n\treturn struct{ x int }{1}\n}", [("taker§", "", 0, 2, None)]),
        ("var lit§ = func() { panic(\"func no() {\") }", []),
        ("func variadic§(a ...string) (n int) { return len(a) }", [("variadic§", "", 0, 0, None)]),
    ]),
    "cs": ("csharp", "App.Tests", [("System", ""), ("System.Text", ""), ("System.Math", ""), ("Newtonsoft.Json.JsonConvert", "Json")], ("/* ", " */"), [
        ("#region using }\nglobal using System;\nusing System.Text;\nusing static System.Math;\nusing Json = Newtonsoft.Json.JsonConvert;\n#endregion\nnamespace App.Tests;", []),
        ("public record P§(int X);", []),
        ("public interface IRun§<T> where T : class, new()\n{\n    Task Run(int a);\n    string Name { get; }\n    void Both() { }\n}", [("Run", "IRun§", 2, 2, None), ("Both", "IRun§", 4, 4, None)]),
        ("public sealed class Box§<T> : IRun<T> where T : class\n{\n    public int Count { get; private set; } = Compute(1);\n    public Func<int, int> F => x => x + 1;\n    public Box§(int a) : base(a) { }\n    void Hidden() { }", [("Hidden", "Box§", 5, 5, None)]),
        ("    public async Task<List<int>> Load<K>(K k, string s = \"}\") where K : struct\n    {\n        var v = @\"a \"\"}\";\n        return $\"{map[\"k\"]} {{ {(1 + 2)}\";\n    }", [("Load", "Box§", 0, 4, None)]),
        ("    public (int A, string B) Pair() => (1, \"x\");", [("Pair", "Box§", 0, 0, None)]),
        ("    void IDisposable.Dispose() { using (var x = new X()) { } int Local(int q) { return q; } }", [("Dispose", "Box§", 0, 0, None)]),
        ("    protected abstract int Abstract(int[] a);", [("Abstract", "Box§", 0, 0, None)]),
        ("    public static Box operator +(Box a, Box b) => a;\n    public delegate void Handler(int a);", []),
        ("    string raw = \"\"\"\n        } \"quoted\" {\n        \"\"\";\n    int?[] Arrays(params int[] a) { return null; }", [("Arrays", "Box§", 3, 3, None)]),
        ("    private struct Inner§ { internal void Deep() { } }\n}", [("Deep", "Inner§", 0, 0, "internal void Deep() { }")]),
        ("public class One§ { public static int M§() => 1; int N§() { return '}'; } }", [("M§", "One§", 0, 0, "public static int M§() => 1;"), ("N§", "One§", 0, 0, "int N§() { return '}'; }")]),
    ]),
    "php": ("php", "App\\Models", [("A\\B", ""), ("A\\C", "D"), ("Illuminate\\Model", "Base"), ("A\\helper", "")], ("/* ", " */"), [
        ("namespace App\\Models;\nuse A\\{B, C as D};\nuse Illuminate\\Model as Base;\nuse function A\\helper;", []),
        ("function &byRef§(array $a = ['}']): ?string {\n    return 'it\\'s }';\n}", [("byRef§", "", 0, 2, None)]),
        ("function here§() {\n    return <<<EOT\nit's { $x\nEOT;\n}", [("here§", "", 0, 4, None)]),
        ("# function no1() {\n// it's function no2() {", []),
        ("$f§ = function ($x) use ($y) { return fn($z) => $z; };", []),
        ("abstract class U§ extends Base implements I {\n    use SomeTrait;\n    public const X = 'a';\n    public function name() { return \"{$this->a['k']}\"; }", [("name", "U§", 3, 3, None)]),
        ("    abstract protected function none(int $a): int;", [("none", "U§", 0, 0, None)]),
        ("    final public static function of() {\n        return static::class;\n    }\n}", [("of", "U§", 0, 2, None)]),
        ("interface I§ { public function decl§(); }", [("decl§", "I§", 0, 0, "public function decl§();")]),
        ("trait T§ {\n    function mixed§() {}\n}", [("mixed§", "", 1, 1, None)]),
        ("if (true) {\n    function nested§() {}\n}", [("nested§", "", 1, 1, None)]),
        ("?>\n<p>it's function no3() {</p>\n<?php\nfunction after§() {}", [("after§", "", 3, 3, None)]),
    ]),
    "py": ("python", "", [("os", ""), ("numpy", "np"), ("pytest", "")], ('"""', '"""'), [
        ("import os\nimport numpy as np\nfrom pytest import (\n    fixture,\n)", []),
        ("def top§(a,\n          b):\n    return a", [("top§", "", 0, 2, None)]),
        ("async def later§(): pass", [("later§", "", 0, 0, None)]),
        ("class Math§:\n    '''def no1(): pass'''\n    @property\n    def multiply(self, x):\n        return x", [("multiply", "Math§", 3, 4, None)]),
        ("    def outer(self):\n        def inner():\n            return 1\n        return inner", [("outer", "Math§", 0, 3, None), ("inner", "Math§", 1, 2, None)]),
        ("    class Deep§:\n        def m(self): return '\\'\\''", [("m", "Deep§", 1, 1, None)]),
        ("text§ = 'def no2(): pass'", []),
        ("if True:\n    def nested§(): return {'a': 1}", [("nested§", "", 1, 1, None)]),
        ("lam§ = lambda x: x", []),
        ("def generic§[T](x: T) -> list[T]: return [x]", [("generic§", "", 0, 0, None)]),
        ("def doc§():\n    \"\"\"a\n    def no3(): pass\n    \"\"\"", [("doc§", "", 0, 3, None)]),
    ]),
}


def template(ext: str) -> tuple[str, str]:
    """What stands before and behind a document's text in its file."""
    opens, closes = SHAPES[ext][3]
    return ("<?php\n" if ext == "php" else "") + opens, closes + "\n" + "\n".join(piece for piece, _ in SHAPES[ext][4]) + "\n"


def expected(ext: str) -> list[tuple[str, str, int, int, str | None]]:
    """(name, container, first line, last line, text) of the functions of a file whose text has no line end."""
    out, line = [], 1 + sum(part.count("\n") for part in (template(ext)[0], template(ext)[1].split("\n", 1)[0] + "\n"))
    for piece, found in SHAPES[ext][4]:
        out += [(name, box, line + lo, line + hi, own) for name, box, lo, hi, own in found]
        line += piece.count("\n") + 1
    return out

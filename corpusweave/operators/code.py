"""Functions, types, imports and namespace of source files.

Python is read by its own parser, and by lines and indents where a file doesn't parse. The brace languages are read as
tokens with a bracket tree (see tokens): declarations are found by the tokens around their keywords, and bodies of types by
their members. What counts as a function follows the syntax: declarations with a name, methods with one (of classes and
objects), and arrow functions that a const or let names; not generators that are no methods, function expressions, nor
constructors of C#. A function's container is the class, interface or struct around it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import memory, tables
from .tokens import Tokens

SCHEMA = (
    "struct<language:string,namespace:string,types:array<string>,imports:array<struct<raw_path:string,alias:string>>,"
    "functions:array<struct<name:string,receiver:string,container:string,start_line:bigint,end_line:bigint,content:string>>>"
)
FALLBACK_BYTES = 4000
#: Files whose declarations a task holds at once.
ROWS = 128

_JS_WORDS = frozenset("if for while switch catch return new else do function throw await typeof with super import".split())
_JS_MODIFIERS = frozenset("public private protected static async get set override readonly abstract declare accessor *".split())
_CS_MODIFIERS = frozenset("public private protected internal static async virtual override sealed abstract partial extern unsafe new readonly required volatile".split())
_PHP_MODIFIERS = frozenset("public private protected static abstract final readonly var".split())
_OPERATORS = frozenset("= + - * / % ? : & | ^ ! ~ < > , . ( [ { => && || ?? ... ${".split())
_EXPRESSION = (_OPERATORS - {"{"}) | frozenset("return typeof new void await yield case in of delete throw instanceof extends".split())


def _inner(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'`" else text


class _File:
    """What has been found in a file's tokens."""

    def __init__(self, src: str, lang: str):
        self.t, self.types, self.refs, self.functions, self.space = Tokens(src, lang), [], [], [], ""
        self.boxes: dict[int, tuple[str, bool]] = {}  # of the brace that opens a type's body: its name, whether it holds functions

    def box(self, name: str, brace: int, holds: bool = True, listed: bool = True) -> None:
        if listed and name and name not in self.types:
            self.types.append(name)
        if brace >= 0:
            self.boxes[brace] = (name, holds)

    def container(self, i: int) -> str:
        while (i := self.t.up[i]) >= 0:
            if (own := self.boxes.get(i)) and own[0] and own[1]:
                return own[0]
        return ""

    def function(self, name: str, first: int, last: int, receiver: str = "", container: str | None = None) -> None:
        """Tokens first to last, inclusive."""
        t = self.t
        lo, hi = t.start[first], t.end[min(last, len(t) - 1)]
        box = self.container(first) if container is None else container
        self.functions.append({"name": name, "receiver": receiver, "container": box, "start_line": t.line(lo), "end_line": t.line(hi), "content": t.src[lo:hi]})

    def statement_end(self, i: int) -> int:
        """The last token of the statement that goes on at i: its semicolon, or the token before a line or bracket ends it."""
        t, k, before = self.t, i, ""
        while k < len(t):
            text = t.text[k]
            if text == ";":
                return k
            if text in (")", "]", "}") or k > i and t.new_line(k) and before not in _OPERATORS and text not in _OPERATORS:
                return k - 1
            nxt = t.past(k)
            before, k = t.text[nxt - 1] if t.kind[nxt - 1] == "punct" else "", nxt
        return len(t) - 1


# JavaScript and TypeScript


def _past_type(t: Tokens, i: int) -> int:
    """Behind the type that begins at i."""
    k, wants = i, True
    while k < len(t):
        text = t.text[k]
        if text == "<":
            nxt = t.past_angles(k)
            if nxt == k:
                return k
            k, wants = nxt, False
        elif text == "{" and not wants or text in (";", ",", ")", "]", "}", "="):
            return k
        elif text in ("|", "&", ".", "=>", "?", ":"):
            k, wants = k + 1, True
        elif not wants and t.new_line(k) and text not in ("[", "extends", "is"):
            return k
        else:
            wants = t.kind[k] == "name" and text in ("keyof", "typeof", "readonly", "infer", "is", "extends", "asserts", "unique", "new", "abstract")
            k = t.past(k)
    return k


def _js_parameters(t: Tokens, i: int) -> int:
    """Behind parameters and result type at i (type parameters allowed); i where there are none."""
    k = t.past_angles(i) if t.at(i) == "<" else i
    if t.at(k) != "(":
        return i
    k = t.past(k)
    return _past_type(t, k + 1) if t.at(k) == ":" else k


def _js_statement(t: Tokens, i: int) -> bool:
    """Whether what stands at i begins a statement."""
    before = t.at(i - 1)
    if t.kind[i - 1] == "string" and i and not t.new_line(i):
        return False
    return not i or before in (";", "{", "}", "export", "default", "declare", "else", "do") or before not in _EXPRESSION and t.new_line(i)


def _js_member(f: _File, k: int) -> int:
    """Takes in the member of a class that begins at k; where the next one begins."""
    t = f.t
    while t.at(k).startswith("@"):  # a decorator
        k += 1
        while t.at(k) == ".":
            k += 2
        k = t.past(k) if t.at(k) == "(" else k
    first = k
    while t.at(k) in _JS_MODIFIERS and t.at(k + 1) not in ("(", "=", ";", "?", "!", ":", "<", "}", ""):
        k += 1
    name, own = t.at(k), t.is_name(k) and t.at(k)[0] != "#"
    k = t.past(k) if k < len(t) else k
    k += t.at(k) in ("?", "!")
    behind = _js_parameters(t, k)
    if behind > k and t.at(behind) == "{":
        if own:
            f.function(name, first, t.match[behind])
        return t.past(behind)
    return max(first, f.statement_end(behind)) + 1


def _javascript(f: _File, typed: bool) -> None:
    t = f.t
    for i, (kind, text) in enumerate(zip(t.kind, t.text)):
        if kind != "name" and text != "*" or t.at(i - 1) in (".", "?."):
            continue
        if text == "class" and t.at(i + 1) not in (":", "=", ")", ",", ";"):
            named = t.is_name(i + 1) and t.at(i + 1) not in ("extends", "implements")
            k = i + 1 + named
            while k < len(t) and t.text[k] not in ("{", ";", ")", "}"):
                k = (t.past_angles(k) if t.text[k] == "<" else k) if t.text[k] == "<" and t.past_angles(k) > k else t.past(k)
            if t.at(k) == "{":
                declares = _js_statement(t, i) or t.at(i - 1) == "abstract" or t.at(i - 1).startswith("@") or t.at(i - 1) == ")"
                f.box(t.at(i + 1) if named else "", k, listed=declares)
        elif typed and text in ("interface", "enum", "type") and t.is_name(i + 1):
            k = t.past_angles(i + 2) if t.at(i + 2) == "<" else i + 2
            if text == "type" and t.at(k) == "=" or text != "type" and t.at(k) in ("{", "extends"):
                while text == "interface" and k < len(t) and t.text[k] not in ("{", ";"):
                    k = t.past_angles(k) if t.text[k] == "<" and t.past_angles(k) > k else t.past(k)
                f.box(t.at(i + 1), k if t.at(k) == "{" else -1, holds=text == "interface")
        elif text == "function" and t.is_name(i + 1):
            first = i - (t.at(i - 1) == "async" and not t.new_line(i))
            body = _js_parameters(t, i + 2)
            if body > i + 2 and _js_statement(t, first) and (typed or t.at(body) == "{"):
                f.function(t.at(i + 1), first, t.match[body] if t.at(body) == "{" else body if t.at(body) == ";" else body - 1)
        elif text in ("const", "let") and t.at(i - 1) != "(":
            _js_arrows(f, i)
        elif t.up[i] >= 0 and t.text[t.up[i]] == "{" and t.up[i] not in f.boxes and t.at(i - 1) in ("{", ","):
            k = i
            while t.at(k) in ("async", "get", "set", "*") and t.at(k + 1) not in ("(", ",", ":", "}", "="):
                k += 1
            behind = _js_parameters(t, k + 1)
            if t.is_name(k) and t.text[k] not in _JS_WORDS and behind > k + 1 and t.at(behind) == "{":
                f.function(t.text[k], i, t.match[behind])
        elif text in ("import", "export", "require"):
            _js_import(f, i)
    for brace, (_, holds) in list(f.boxes.items()):
        k, last = brace + 1, t.match[brace]
        while holds and k < last:
            k = k + 1 if t.text[k] in (";", ",") else _js_member(f, k)


def _js_arrows(f: _File, i: int) -> None:
    """The arrow functions that the declaration at i names."""
    t, k, found = f.t, i + 1, []
    while t.is_name(k):
        name, k = t.text[k], k + 1
        k += t.at(k) == "!"
        k = _past_type(t, k + 1) if t.at(k) == ":" else k
        if t.at(k) != "=":
            break
        k += 1
        k += t.at(k) == "async" and (t.is_name(k + 1) or t.at(k + 1) in ("(", "<"))
        behind = _js_parameters(t, k)
        behind = k + 1 if behind == k and t.is_name(k) else behind
        if t.at(behind) == "=>":
            found.append(name)
            k = behind + 1
        while k < len(t) and t.text[k] not in (",", ";", ")", "]", "}"):  # the value
            if t.new_line(k) and t.at(k - 1) not in _OPERATORS and t.text[k] not in _OPERATORS:
                break
            k = t.past(k)
        if t.at(k) != ",":
            break
        k += 1
    for name in found:
        f.function(name, i, k if t.at(k) == ";" else k - 1)


def _js_import(f: _File, i: int) -> None:
    t, k = f.t, i + 1
    if t.text[i] == "require":
        if t.at(k) == "(" and k + 1 < len(t) and t.kind[k + 1] == "string":
            f.refs.append((_inner(t.text[k + 1]), ""))
    elif t.at(k) not in ("(", ".", ":", "=") and (t.text[i] == "import" or t.at(k) in ("*", "{", "type")) and _js_statement(t, i):
        while k < len(t) and k < i + 400:
            if t.kind[k] == "string":
                f.refs.append((_inner(t.text[k]), ""))
                return
            if t.text[k] in (";", "=", "(") or k > i + 1 and t.new_line(k) and t.at(k - 1) not in _OPERATORS and t.text[k] not in _OPERATORS | {"from"}:
                return
            k = t.past(k)


# Go


def _go(f: _File) -> None:
    t = f.t
    for i, (kind, text) in enumerate(zip(t.kind, t.text)):
        if kind != "name":
            continue
        if text == "package" and t.up[i] < 0 and not f.space:
            f.space = t.at(i + 1)
        elif text == "import" and t.up[i] < 0:
            for k in t.inside(i + 1) if t.at(i + 1) == "(" else range(i + 1, min(i + 3, len(t))):
                if t.kind[k] == "string":
                    alias = t.at(k - 1)
                    f.refs.append((_inner(t.text[k]), alias if (t.is_name(k - 1) and alias != "import" or alias == ".") and not t.new_line(k) else ""))
                    if t.at(i + 1) != "(":
                        break
        elif text == "type" and t.at(i - 1) != ".":
            if t.at(i + 1) == "(":
                k, fresh = i + 2, True
                while k < t.match[i + 1]:
                    if fresh and t.is_name(k) and t.at(k + 1) != "=":
                        f.box(t.text[k], -1)
                    k = t.past(k)
                    fresh = t.at(k - 1) == ";" or k < len(t) and t.new_line(k)
            elif t.is_name(i + 1) and t.at(i + 2) != "=":
                f.box(t.at(i + 1), -1)
        elif text == "func" and t.up[i] < 0:
            k, receiver = i + 1, ""
            if t.at(k) == "(":
                receiver = t.src[t.start[k] : t.end[t.match[k]]]
                k = t.past(k)
            if not t.is_name(k):
                continue
            name, k = t.text[k], k + 1
            k = t.past(k) if t.at(k) == "[" else k
            if t.at(k) != "(":
                continue
            k = t.past(k)
            while k < len(t) and not t.new_line(k) and t.text[k] != ";":
                if t.text[k] == "{" and t.at(k - 1) not in ("interface", "struct"):
                    k = t.past(k)
                    break
                k = t.past(k)
            own = re.sub(r"[()*\[\]{}]", " ", receiver).split()
            f.function(name, i, k - 1, receiver, own[-1] if own else "")


# C#


def _csharp(f: _File) -> None:
    t = f.t
    for i, (kind, text) in enumerate(zip(t.kind, t.text)):
        if kind != "name" or t.at(i - 1) == ".":
            continue
        if text == "namespace" and t.is_name(i + 1):
            k = i + 2
            while t.at(k) == ".":
                k += 2
            f.space = f.space or "".join(t.text[i + 1 : k])
            if t.at(k) == "{":
                f.box("", k, holds=False, listed=False)
        elif text == "using" and (t.up[i] < 0 or t.up[i] in f.boxes):
            k, alias = i + 1 + (t.at(i + 1) == "static"), ""
            if t.at(k + 1) == "=":
                alias, k = t.at(k), k + 2
            end = k
            while end < len(t) and (t.kind[end] == "name" or t.text[end] in (".", "::", "<", ">", ",", "?", "[", "]")):
                end += 1
            if t.at(end) == ";" and end > k and (end == k + 1 or not t.is_name(k + 1)):
                f.refs.append((t.src[t.start[k] : t.end[end - 1]], alias))
        elif text in ("class", "interface", "struct", "record", "enum") and t.at(i - 1) not in (":", ",", "="):
            k = i + 1 + (text == "record" and t.at(i + 1) in ("class", "struct"))
            if not t.is_name(k) or text != "record" and t.at(i - 1) == "record" or t.at(k + 1) not in ("{", ":", "<", "(", ";", "where"):
                continue
            name, k = t.text[k], k + 1
            while k < len(t) and t.text[k] not in ("{", ";"):
                nxt = t.past_angles(k) if t.text[k] == "<" else k
                k = nxt if nxt > k else t.past(k)
            f.box(name, k if t.at(k) == "{" else -1, holds=text in ("class", "interface", "struct"))
            if t.at(k) == "{" and text != "enum":
                _cs_members(f, k)


def _cs_members(f: _File, brace: int) -> None:
    t, k, last = f.t, brace + 1, f.t.match[brace]
    while k < last:
        first = k
        while t.at(k) == "[":
            k = t.past(k)
        while t.at(k) in _CS_MODIFIERS:
            k += 1
        began, name, stop = k, -1, k
        while stop < last and t.text[stop] not in ("{", ";", "=", "=>"):
            text = t.text[stop]
            if text in ("class", "interface", "struct", "record", "enum", "delegate", "event", "operator", "implicit", "explicit", "~") and name == -1:
                name = -2
            nxt = t.past_angles(stop) if text == "<" else stop
            if text == "(" and stop > began and name == -1:  # parameters: before them a name, perhaps with type parameters, and a type
                back, depth = stop - 1, 0
                while back > began and (t.text[back] == ">" or depth):
                    depth += (t.text[back] == ">") - (t.text[back] == "<")
                    back -= 1
                typed = back
                while t.at(typed - 1) in (".", "::") and typed - 2 >= began:  # of an interface that is named
                    typed -= 2
                    while t.at(typed) == ">" and typed > began:
                        typed -= 1
                name = back if t.is_name(back) and typed > began else -2
            stop = nxt if nxt > stop else t.past(stop)
        if t.at(stop) == "=" or t.at(stop) == "=>":
            while stop < last and t.text[stop] != ";":
                stop = t.past(stop)
        end = t.match[stop] if t.at(stop) == "{" else stop
        if name >= 0:
            f.function(t.text[name], first, min(end, last))
        k = end + 1
        if t.at(stop) == "{" and t.at(k) == "=":  # a property's first value
            while k < last and t.text[k] != ";":
                k = t.past(k)
            k += 1


# PHP


def _php(f: _File) -> None:
    t = f.t
    for i, (kind, text) in enumerate(zip(t.kind, t.text)):
        if kind != "name" or t.at(i - 1) in ("->", "::"):
            continue
        word = text.lower()
        if word == "namespace" and t.at(i - 1) in ("", ";", "}"):
            f.space = f.space or (t.at(i + 1) if t.is_name(i + 1) else "")
            brace = i + 1 + t.is_name(i + 1)
            if t.at(brace) == "{":
                f.box("", brace, holds=False, listed=False)
        elif word == "use" and (t.up[i] < 0 or f.boxes.get(t.up[i], ("x", True)) == ("", False)) and t.is_name(i + 1):
            _php_use(f, i + 1)
        elif word in ("class", "interface", "trait", "enum") and t.is_name(i + 1) and t.at(i + 1).lower() not in ("extends", "implements"):
            k = i + 2
            while k < len(t) and t.text[k] not in ("{", ";", ")"):
                k = t.past(k)
            if t.at(k) == "{":
                f.box(t.at(i + 1), k, holds=word in ("class", "interface"), listed=word != "enum")
        elif word == "function":
            k = i + 1 + (t.at(i + 1) == "&")
            if not t.is_name(k) or t.at(k + 1) != "(":
                continue
            behind = t.past(k + 1)
            while behind < len(t) and t.text[behind] not in ("{", ";", "}"):
                behind = t.past(behind)
            first = i
            while t.at(first - 1).lower() in _PHP_MODIFIERS:
                first -= 1
            f.function(t.text[k], first, t.match[behind] if t.at(behind) == "{" else behind if t.at(behind) == ";" else behind - 1)


def _php_use(f: _File, k: int) -> None:
    t = f.t
    if t.at(k).lower() in ("function", "const"):
        k += 1
    stem = ""
    while k < len(t) and t.text[k] not in (";", "(", ")"):
        if t.text[k] == "{":
            stem = t.at(k - 1)
        elif t.is_name(k) and t.at(k + 1) != "{" and t.text[k].lower() not in ("function", "const"):
            alias = t.at(k + 2) if t.at(k + 1).lower() == "as" else ""
            f.refs.append((stem + t.text[k], alias))
            k += 2 * bool(alias)
        elif t.text[k] == "}":
            stem = ""
        k += 1


# Python


def _python(src: str) -> tuple[list[str], list, list[dict]]:
    tree = ast.parse(src)
    lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", src)  # as the parser counts them
    types, refs, functions = [], [], []

    def walk(node, container):
        for x in ast.iter_child_nodes(node):
            inner = container
            if isinstance(x, ast.ClassDef):
                types.append(x.name)
                inner = x.name
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                functions.append({"name": x.name, "receiver": "", "container": container, "start_line": x.lineno, "end_line": x.end_lineno, "content": "".join(lines[x.lineno - 1 : x.end_lineno]).strip("\n").lstrip()})
            elif isinstance(x, ast.Import):
                refs.extend((a.name, a.asname or "") for a in x.names)
            elif isinstance(x, ast.ImportFrom) and x.module:
                refs.append((x.module, ""))
            walk(x, inner)

    walk(tree, "")
    return types, refs, functions


def _python_by_lines(src: str) -> tuple[list[str], list, list[dict]]:
    """The same of a file that doesn't parse: definitions by their first tokens, bodies by indents; strings and brackets don't count as lines."""
    t = Tokens(src, "python")
    lines, types, refs, functions = src.split("\n"), [], [], []
    begin = [i for i in range(len(t)) if (not i or t.new_line(i)) and t.up[i] < 0]
    indent = [t.start[i] - (src.rfind("\n", 0, t.start[i]) + 1) for i in begin]
    boxes: list[tuple[int, str]] = []
    for n, i in enumerate(begin):
        while boxes and boxes[-1][0] >= indent[n]:
            boxes.pop()
        word = i + (t.at(i) == "async")
        if t.text[i] == "class" and t.is_name(i + 1):
            types.append(t.at(i + 1))
            boxes.append((indent[n], t.at(i + 1)))
        elif t.text[word] == "def" and t.is_name(word + 1):
            after = next((m for m in range(n + 1, len(begin)) if indent[m] <= indent[n]), len(begin))
            last = (begin[after] if after < len(begin) else len(t)) - 1
            lo, hi = t.line(t.start[i]), t.line(t.end[last])
            functions.append({"name": t.at(word + 1), "receiver": "", "container": boxes[-1][1] if boxes else "", "start_line": lo, "end_line": hi, "content": "\n".join(lines[lo - 1 : hi]).lstrip()})
        elif t.text[i] in ("import", "from"):
            line = src[t.start[i] : src.find("\n", t.start[i]) if "\n" in src[t.start[i] :] else len(src)]
            if m := re.match(r"from\s+([\w.]+)", line):
                refs.append((m[1], ""))
            elif t.text[i] == "import":
                refs.extend((m[1], m[2] or "") for m in re.finditer(r"([\w.]+)(?:\s+as\s+(\w+))?\s*(?:,|;|$)", line[6:].split("#")[0].strip()))
    return types, refs, functions


_READERS = {"go": _go, "javascript": lambda f: _javascript(f, False), "typescript": lambda f: _javascript(f, True), "csharp": _csharp, "php": _php}


def parse(path: str, src: str) -> dict:
    """What a source file declares; a file without a function is one function named after it. Broken files give what is found in them."""
    name = path.rsplit("/", 1)[-1]
    lang = tables.LANGUAGES.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", "unknown")
    types, refs, functions, space = [], [], [], ""
    if lang == "python":
        try:
            types, refs, functions = _python(src)
        except (SyntaxError, ValueError, RecursionError):
            types, refs, functions = _python_by_lines(src)
    elif lang in _READERS:
        f = _File(src, "javascript" if lang == "typescript" else lang)
        _READERS[lang](f)
        types, refs, functions, space = f.types, f.refs, f.functions, f.space
    once = {(f["name"], f["start_line"], f["end_line"]): f for f in reversed(functions)}
    functions = sorted(reversed(once.values()), key=lambda f: (f["start_line"], f["name"]))
    imports = [{"raw_path": p, "alias": a} for p, a in dict.fromkeys((p.strip(), a) for p, a in refs) if p]
    if not functions:
        data = src.encode()
        cut = data[:FALLBACK_BYTES].decode("utf-8", "ignore") + "..." if len(data) > FALLBACK_BYTES else src
        functions = [{"name": name, "receiver": "", "container": "", "start_line": 1, "end_line": src.count("\n") + 1, "content": cut}]
    return {"language": lang, "namespace": space, "types": list(dict.fromkeys(types)), "imports": imports, "functions": functions}


def _pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """What the files of batches of paths and texts declare, ROWS files at a time, so that no more is held whatever a batch's size."""
    for paths, texts in batches:
        for k in range(0, len(paths), ROWS):
            own = zip(paths.iloc[k : k + ROWS], texts.iloc[k : k + ROWS])
            yield pd.DataFrame([parse(p or "", t or "") for p, t in own], columns=["language", "namespace", "types", "imports", "functions"])
        memory.give_back()


def extract(files: DataFrame, path_col: str = "relative_path", text_col: str = "content") -> DataFrame:
    """files with a `code` struct of what they declare."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from _pieces(batches)

    return files.withColumn("code", run(F.col(path_col), F.col(text_col)))


def functions_of(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row for each function of extract()'s rows, with its place i."""
    return parsed.select(*keep, "code.language", "code.namespace", F.posexplode("code.functions").alias("i", "f")).select(*keep, "language", "namespace", "i", "f.*")

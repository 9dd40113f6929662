"""Tokens of source files and the brackets around them.

One pattern a language finds names, numbers, plain strings and comments; what a pattern can't bound (template literals, regex
literals, here-documents, raw, verbatim and interpolated strings) is a mode of its own. Code inside a template is tokenized
like any other, between brackets `${` and `}`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_SPACE = r"(?P<space>[^\S\n]+|\n|\\\n|{comment})"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_NAME = r"(?P<name>[@#]?[^\W\d][\w$]*|[$][\w$]*)"
_NUMBER = r"(?P<number>\.?\d(?:[eE][+-]\d|\.(?!\.)|\w)*)"
_QUOTED = r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\""


def _pattern(comment: str, string: str, name: str = _NAME, arrows: str = r"=>|::|->|\.\.\.|\?\?|&&|\|\|") -> re.Pattern:
    return re.compile("|".join((_SPACE.format(comment=comment), f"(?P<string>{string})", name, _NUMBER, f"(?P<punct>{arrows}|.)")), re.S)


_TOKENS = {
    "go": _pattern(_C_COMMENT, r"`[^`]*(?:`|\Z)|" + _QUOTED),
    "javascript": _pattern(_C_COMMENT, _QUOTED),
    "csharp": _pattern(_C_COMMENT + r"|(?:(?<=\n)|\A)[^\S\n]*#[^\n]*", r"@\"(?:\"\"|[^\"])*(?:\"|\Z)|" + _QUOTED),
    "php": _pattern(r"//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?(?:\*/|\Z)", r"'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)", r"(?P<name>\$?[\w\\]+)"),
    "python": _pattern(r"#[^\n]*", r"(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)|" + _QUOTED + ")"),
}
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")": "(", "]": "[", "}": "{"}
#: Names after which a slash begins a regex literal.
_BEFORE_REGEX = frozenset("return typeof case in of do else void delete instanceof new throw yield await".split())
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_HEREDOC = re.compile(r"<<<[ \t]*(['\"]?)(\w+)\1\n")
_RAW_CS = re.compile(r"\$*\"\"\"+")
_INTERPOLATED_CS = re.compile(r"(?:\$@|@\$|\$)\"")


class Tokens:
    """Tokens text[i] of a kind at start[i]:end[i]; match[i] is the token that closes or opens the bracket i, up[i] the bracket around i, or -1."""

    def __init__(self, src: str, lang: str):
        self.src = src
        self.kind, self.text, self.start, self.end = [], [], [], []
        self._lines = [m.end() for m in re.finditer("\n", src)]
        self._read(lang)
        self._nest()

    def __len__(self) -> int:
        return len(self.text)

    def line(self, at: int) -> int:
        """The line, from 1, of a place in the source."""
        return bisect_right(self._lines, at) + 1

    def new_line(self, i: int) -> bool:
        """Whether a line ends between the token before i and i."""
        return i > 0 and self.src.find("\n", self.end[i - 1], self.start[i]) >= 0

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "name"

    def _add(self, kind: str, lo: int, hi: int) -> None:
        self.kind.append(kind)
        self.text.append(self.src[lo:hi])
        self.start.append(lo)
        self.end.append(hi)

    def _read(self, lang: str) -> None:
        src, k, pattern, depth = self.src, 0, _TOKENS[lang], []  # depth: of each open template, its unclosed braces
        if lang == "php" and "<?" in src:
            k = self._html(0)
        while k < len(src):
            special = None
            if lang == "javascript":
                special = self._javascript(k, depth)
            elif lang == "csharp":
                special = self._csharp(k)
            elif lang == "php" and src[k] in "<?":
                if src.startswith("?>", k):
                    self._add("punct", k, k)  # ends a statement
                    self.text[-1] = ";"
                    special = self._html(k)
                elif m := _HEREDOC.match(src, k):
                    over = re.compile(rf"^[ \t]*{m[2]}\b", re.M).search(src, m.end())
                    special = over.end() if over else len(src)
                    self._add("string", k, special)
            if special is not None:
                k = special
                continue
            m = pattern.match(src, k)
            if m.lastgroup != "space":
                self._add(m.lastgroup, k, m.end())
            k = m.end()

    def _html(self, k: int) -> int:
        m = re.compile(r"<\?(?:php\b|=)?", re.I).search(self.src, k)
        return m.end() if m else len(self.src)

    def _javascript(self, k: int, depth: list[int]) -> int | None:
        src, ch = self.src, self.src[k]
        if ch == "`" or ch == "}" and depth and not depth[-1]:
            if ch == "}":
                depth.pop()
                self._add("punct", k, k + 1)
            m = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S).match(src, k + 1)
            self._add("string", k + (ch == "}"), m.end() + (src[m.end() : m.end() + 1] == "`"))
            if src.startswith("${", m.end()):
                depth.append(0)
                self._add("punct", m.end(), m.end() + 2)
                return m.end() + 2
            return m.end() + 1
        if depth and ch in "{}":
            depth[-1] += 1 if ch == "{" else -1
        if ch == "/" and self._before_regex() and (m := _REGEX.match(src, k)):
            self._add("string", k, m.end())
            return m.end()
        return None

    def _before_regex(self) -> bool:
        if not self.text or self.kind[-1] == "punct":
            last = self.at(len(self.text) - 1)
            if last == ")":  # a condition, or what is divided
                level = 0
                for i in range(len(self.text) - 1, -1, -1):
                    level += (self.text[i] == ")") - (self.text[i] == "(") if self.kind[i] == "punct" else 0
                    if not level:
                        return self.at(i - 1) in ("if", "while", "for", "with")
            return last not in ("]", "<")
        return self.text[-1] in _BEFORE_REGEX

    def _csharp(self, k: int) -> int | None:
        src = self.src
        if src[k] not in "$@\"":
            return None
        if m := _RAW_CS.match(src, k):
            quotes = m[0].lstrip("$")
            over = src.find(quotes, m.end())
            end = len(src) if over < 0 else over + len(quotes)
        elif m := _INTERPOLATED_CS.match(src, k):
            end = self._interpolated(m.end(), "@" in m[0])
        else:
            return None
        self._add("string", k, end)
        return end

    def _interpolated(self, k: int, verbatim: bool) -> int:
        """Behind an interpolated string whose text begins at k."""
        src, level = self.src, 0
        while k < len(src):
            ch = src[k]
            if not level:
                if ch == '"':
                    if not verbatim or src[k + 1 : k + 2] != '"':
                        return k + 1
                    k += 1
                elif ch == "\\" and not verbatim or src.startswith("{{", k) or src.startswith("}}", k):
                    k += 1
                elif ch == "{":
                    level = 1
                elif ch == "\n" and not verbatim:
                    return k
            elif ch in "{}":
                level += 1 if ch == "{" else -1
            elif (inner := self._string_at(k)) is not None:
                k = inner - 1
            k += 1
        return k

    def _string_at(self, k: int) -> int | None:
        m = _INTERPOLATED_CS.match(self.src, k)
        if m:
            return self._interpolated(m.end(), "@" in m[0])
        m = re.compile(r"@\"(?:\"\"|[^\"])*\"|" + _QUOTED).match(self.src, k)
        return m.end() if m else None

    def _nest(self) -> None:
        """Pairs brackets; one that is never closed ends with the one around it, and a stray closer counts for nothing."""
        self.match, self.up, stack = [-1] * len(self), [-1] * len(self), []
        for i, (kind, text) in enumerate(zip(self.kind, self.text)):
            if kind != "punct":
                self.up[i] = stack[-1] if stack else -1
            elif text in _OPENS:
                self.up[i] = stack[-1] if stack else -1
                stack.append(i)
            elif text in _CLOSES and any(_OPENS[self.text[j]] == text for j in stack):
                while _OPENS[self.text[stack[-1]]] != text:
                    self.match[stack.pop()] = i
                j = stack.pop()
                self.match[j], self.match[i] = i, j
                self.up[i] = stack[-1] if stack else -1
            else:
                self.up[i] = stack[-1] if stack else -1
        for j in stack:
            self.match[j] = len(self) - 1

    def past(self, i: int) -> int:
        """The token behind i, or behind the bracket that i opens."""
        return max(i, self.match[i]) + 1 if self.kind[i] == "punct" and self.text[i] in _OPENS else i + 1

    def past_angles(self, i: int) -> int:
        """Behind the type arguments or parameters that i, a `<`, opens; i where it opens none."""
        depth, k = 0, i
        while k < len(self):
            t = self.text[k]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in (";", ")", "]", "}"):
                return i
            k = self.past(k)
        return i

    def inside(self, i: int) -> range:
        """The tokens between the bracket i and its end."""
        return range(i + 1, self.match[i] if self.text[self.match[i]] in _CLOSES else len(self))

"""Which files of a workspace count: fixed rules, and ignore files compiled to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file: applies below `base`."""

    order: int
    base: str
    regex: str
    dir_only: bool
    negate: bool


def compile_rule(line: str, order: int = 0, base: str = "") -> Rule | None:
    """None for blank lines, comments and what is no regular expression."""
    p = line.strip()
    if not p or p.startswith("#"):
        return None
    negate, p = p.startswith("!"), p.removeprefix("!")
    dir_only, p = p.endswith("/"), p.removesuffix("/")
    anchored, p = "/" in p, p.removeprefix("/")
    out = []
    for token in re.findall(r"\*\*/?|.", p):
        out.append(".*" if token.startswith("**") else {"*": "[^/]*", "?": "[^/]"}.get(token) or (token if token in "[]^-" else re.escape(token)))
    regex = ("^" if anchored else "(^|/)") + "".join(out) + "(/|$)"
    try:
        re.compile(regex)
    except re.error:
        return None
    return Rule(order, base.strip("/"), regex, dir_only, negate)


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.order, r.base, r.regex, r.dir_only, r.negate) for r in rules], "rule_order int, base string, regex string, dir_only boolean, negate boolean")


def ignored_by_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (path, is_dir) with `ignored`: the last matching rule of the path or of any ancestor decides; .git always is.

    Rules are kept by the folder that they hold below and meet a path by equality with one of its ancestors, so expressions
    run on what lies below their folder only. A row holds the rules of one folder.
    """
    by = rules.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("rule_order", "negate", "regex", "dir_only"))).alias("rules"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("base")))
    each = paths.select("path", "is_dir", F.explode(folders).alias("f")).select("path", "is_dir", "f.depth", "f.base").join(by, "base", "left")
    # of the path and its ancestors below the folder: the last rule that matches
    last = F.expr("""transform(sequence(depth + 1, size(split(path, '/'))), i -> struct(i AS at, array_max(transform(
        filter(rules, r -> (is_dir OR i < size(split(path, '/')) OR NOT r.dir_only) AND rlike(array_join(slice(split(path, '/'), depth + 1, i - depth), '/'), r.regex)),
        r -> struct(r.rule_order AS rule_order, r.negate AS negate))) AS hit))""")
    met = each.select("path", "is_dir", F.explode(last).alias("x")).groupBy("path", "is_dir", "x.at").agg(F.max("x.hit").alias("hit"))
    git = F.array_contains(F.split("path", "/"), ".git")
    return met.groupBy("path", "is_dir").agg(F.bool_or(F.coalesce(~F.col("hit.negate"), F.lit(False)) | git).alias("ignored"))


# Files that are never indexed. The folder of our own settings is one as well.
SUFFIXES = (".designer.cs", "dbcontextmodelsnapshot.cs", "dbcontextsnapshot.cs", ".min.js", ".min.css", ".js.map", ".css.map")
OWN_FOLDER = ".corpusweave"


def should_ignore(path: Column, is_dir: Column, exclude_dirs=(), exclude_exts=(), allow_hidden=()) -> Column:
    """The fixed rules, as one predicate over a relative path."""
    low = F.lower(path)
    base = F.element_at(F.split(path, "/"), -1)
    out = path.contains(OWN_FOLDER) | low.contains("/migrations/")
    for s in SUFFIXES:
        out |= low.endswith(s)
    hidden = base.startswith(".") & (F.length(base) > 1)
    folder = base.isin("Migrations", "migrations", *exclude_dirs) | (hidden & ~base.isin(*allow_hidden) if allow_hidden else hidden)
    exts = ["." + e.lower().lstrip(".") for e in exclude_exts]
    allowed = F.lit(False)
    for a in allow_hidden:
        allowed |= F.concat(F.lit("/"), path).contains(f"/{a}/")
    file = F.regexp_extract(low, r"(\.[^./]*)$", 1).isin(*exts) if exts else F.lit(False)
    file = file | (hidden & ~allowed) | base.startswith("~") | base.endswith(".tmp") | base.contains(".tmp.")
    return out | F.when(is_dir, folder).otherwise(file)


def fixed_rule(path: str, is_dir: bool, exclude_dirs=(), exclude_exts=(), allow_hidden=()) -> bool:
    """should_ignore() of one path, for a walk that must not enter ignored folders."""
    low, base = path.lower(), path.rsplit("/", 1)[-1]
    if OWN_FOLDER in path or "/migrations/" in low or low.endswith(SUFFIXES):
        return True
    hidden = base.startswith(".") and len(base) > 1
    if is_dir:
        return base in ("Migrations", "migrations", *exclude_dirs) or hidden and base not in allow_hidden
    dot = low.rsplit("/", 1)[-1].rfind(".")
    ext = low.rsplit("/", 1)[-1][dot:] if dot >= 0 else ""
    allowed = any(f"/{a}/" in f"/{path}" for a in allow_hidden)
    excluded = ext in ["." + e.lower().lstrip(".") for e in exclude_exts]
    return excluded or hidden and not allowed or base.startswith("~") or base.endswith(".tmp") or ".tmp." in base


def rule_hits(rules: list[Rule], path: str, is_dir: bool) -> bool:
    """Whether the last matching rule ignores the path; its ancestors aren't asked."""
    out = path == ".git" or path.endswith("/.git")
    for r in sorted(rules, key=lambda r: r.order):
        below = path if not r.base else path[len(r.base) + 1 :] if path.startswith(r.base + "/") else None
        if below is not None and (is_dir or not r.dir_only) and re.search(r.regex, below):
            out = not r.negate
    return out

"""Column to Column functions over text: cleaning, tags, symbols, identifiers, hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

#: White space as the cleaning steps see it.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SEPARATORS = r"[./\\\-_:()\[\]{},]"
CAMEL = r"([\p{Ll}\p{Nd}])(\p{Lu})"


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, F.lit(f"^{SPACE}+|{SPACE}+$"), F.lit(""))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"\r\n?"), F.lit("\n"))


def _kept(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, F.lit(pattern), F.lit("")))


def drop_noisy_lines(c: Column, least: float = 0.2) -> Column:
    """Lines trimmed; blank ones stay as such; of the others those go whose share of letters and digits is under `least`."""
    lines = F.transform(F.split(c, "\n"), trim)
    return F.array_join(F.filter(lines, lambda x: (x == "") | (_kept(x, r"[^\p{L}\p{Nd}]") >= F.lit(least) * _kept(x, SPACE))), "\n")


def merge_soft_breaks(c: Column) -> Column:
    """Runs of non-blank lines joined by a space; each blank line stays a line of its own."""
    lines = F.transform(F.split(c, "\n"), trim)
    both = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open")),
        lambda s, x: F.when(
            x == "",
            F.struct(F.concat(s["out"], F.when(s["open"] != "", F.array(s["open"], F.lit(""))).otherwise(F.array(F.lit("")))).alias("out"), F.lit("").alias("open")),
        ).otherwise(F.struct(s["out"].alias("out"), F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x)).alias("open"))),
        lambda s: F.when(s["open"] != "", F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]),
    )
    return F.array_join(both, "\n")


def clean_text(c: Column) -> Column:
    return trim(merge_soft_breaks(drop_noisy_lines(normalize_newlines(c))))


def is_clean(c: Column) -> Column:
    """At least half letters, at most 2 % replacement or control characters (other than new line, tab, return)."""
    t = trim(c)
    n = F.length(t)
    return (n > 0) & (_kept(t, r"[^\p{L}]") >= 0.5 * n) & (_kept(t, r"[^\x{FFFD}\p{Cc}]|[\n\t\r]") <= 0.02 * n)


def unique_sorted(tags: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted; empties go."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda x: F.lower(trim(x))), lambda x: x != "")))


def tag_tokens(c: Column, stop=tables.STOP_WORDS) -> Column:
    """Words of a path, name or text: cut at separators and camel humps, two bytes or more, no stop words; distinct, sorted."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), F.lit(SEPARATORS), F.lit(" ")), F.lit(CAMEL), F.lit("$1 $2")), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, F.lower), lambda x: (F.octet_length(x) >= 2) & ~x.isin(sorted(stop)))))


def roles_of(tokens: Column) -> Column:
    """Roles that tokens give. The tokens are bound once by a transform, so they aren't worked out again for each role."""
    def found(t):
        return F.array_compact(F.array(*(F.when(F.arrays_overlap(t, F.array(*map(F.lit, words))), F.lit(role)) for role, words in tables.ROLES.items())))

    return F.array_sort(F.flatten(F.transform(F.array(tokens), found)))


def role_tags(c: Column) -> Column:
    """Roles that the tokens of a path or name give."""
    return roles_of(tag_tokens(c))


def _matched(low: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    found = [F.when(F.greatest(*(low.contains(w) for w in (*words, words[0]))), F.array(F.lit(tag), *([F.lit("test")] if tag in tables.TEST_FRAMEWORKS else []))).otherwise(F.array().cast("array<string>")) for tag, words in patterns.items()]
    return unique_sorted(F.concat(*found))


def framework_tags(c: Column) -> Column:
    """Frameworks named anywhere in free text, as substrings."""
    return _matched(F.lower(F.coalesce(c, F.lit(""))), tables.FREE_FRAMEWORKS)


def import_tags(language: Column, imports: Column) -> Column:
    """Frameworks of a language's imports."""
    out = F.array().cast("array<string>")
    for lang in tables.IMPORT_FRAMEWORKS:
        patterns = tables.IMPORT_FRAMEWORKS[lang]
        out = F.when(language == lang, unique_sorted(F.flatten(F.transform(imports, lambda x: _matched(F.lower(x), patterns))))).otherwise(out)
    return out


def test_framework(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array_intersect(F.array(*map(F.lit, tables.TEST_FRAMEWORKS)), tags), F.lit(1)), F.lit(""))


def symbol_variants(c: Column) -> Column:
    """A symbol's base name without extension: lower, without underscores, as words; and its tokens."""
    base = F.regexp_extract(F.regexp_replace(trim(c), F.lit(r"\\"), F.lit("/")), r"([^/]*)/*$", 1)
    base = F.regexp_replace(base, F.lit(r"\.[^.]*$"), F.lit(""))
    variants = F.array(base, F.replace(base, F.lit("_"), F.lit("")), F.translate(base, "_.", "  "))
    return F.when(trim(c) == "", F.array().cast("array<string>")).otherwise(unique_sorted(F.concat(variants, tag_tokens(base))))


def symbol_candidates(query: Column) -> Column:
    words = F.regexp_extract_all(query, F.lit(r"([A-Za-z_][A-Za-z0-9_./-]*)"), F.lit(1))
    return unique_sorted(F.flatten(F.transform(words, symbol_variants)))


def looks_exact(query: Column) -> Column:
    return query.rlike(r"[/._]|[a-z][A-Z]|[A-Z][a-z]+[A-Z]")


def parent_dirs(path: Column) -> Column:
    """All ancestors of a relative path, nearest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def first_full(*values: Column) -> Column:
    """The first value that isn't blank, untrimmed; empty if all are."""
    return F.coalesce(*(F.when(trim(v) != "", v) for v in values), F.lit(""))


def payload_list(values: Column) -> Column:
    """A list of a payload as it is read: trimmed, lower-cased, without empties; a missing one is empty."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(trim(x))), lambda x: x != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def language_label(path: Column) -> Column:
    e = extension(path)
    out = F.when(e == "", F.lit("text")).otherwise(e)
    for k, v in tables.LABELS.items():
        out = F.when(e == k, F.lit(v)).otherwise(out)
    return out


def file_kind(ext: Column, mode: str = "full") -> Column:
    """code, document or raw, as the parser mode allows."""
    kinds = (["code"] if mode in ("code", "full") else []) + (["document"] if mode in ("doc", "full") else [])
    out = F.lit("raw")
    for kind, which in (("document", tables.DOCUMENTS), ("code", tables.CODE)):
        out = F.when(ext.isin(*which), F.lit(kind)).otherwise(out) if kind in kinds else out
    return out


def point_id(seed: Column) -> Column:
    """The first 16 bytes of the seed's SHA-1, written as a UUID."""
    return F.regexp_replace(F.substring(F.sha1(seed), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def search_text(tags: Column, symbols: Column, namespace: Column, container: Column, path: Column, content: Column) -> Column:
    def full(c):
        return F.when(c != "", c)

    return F.concat_ws("\n", full(F.array_join(tags, " ")), full(F.array_join(symbols, " ")), full(namespace), full(container), full(path), F.coalesce(content, F.lit("")))


def file_tags(path: Column) -> Column:
    e = extension(path)
    base = F.element_at(F.split(path, "/"), -1)
    own = F.when(e != "", F.array(F.lit("file"), F.concat(F.lit("."), e), language_label(path))).otherwise(F.array(F.lit("file")))
    return unique_sorted(F.concat(own, tag_tokens(path), tag_tokens(base), role_tags(path)))


def fnv_fold(token: Column, ascii_only: bool = False) -> Column:
    """64-bit FNV-1a of the bytes, folded to 32 bits by xor; two 32-bit limbs, since bigint overflow is an error."""
    if ascii_only:
        codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.ascii(F.substring(token, i, F.lit(1))).cast("bigint"))
    else:
        hx = F.hex(F.encode(token, "utf-8"))
        codes = F.transform(F.sequence(F.lit(0), F.octet_length(token) - 1), lambda i: F.conv(F.substring(hx, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    full = F.lit(0xFFFFFFFF).cast("bigint")

    def step(s, b):
        lo = s["lo"].bitwiseXOR(b)
        return F.struct(((s["hi"] * 435) + F.shiftright(lo * 435, 32) + F.shiftleft(lo, 8)).bitwiseAND(full).alias("hi"), (lo * 435).bitwiseAND(full).alias("lo"))

    return F.aggregate(codes, F.struct(F.lit(3421674724).cast("bigint").alias("hi"), F.lit(2216829733).cast("bigint").alias("lo")), step, lambda s: s["hi"].bitwiseXOR(s["lo"]))

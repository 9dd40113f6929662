"""Workspace scan, guards and document readers."""

from __future__ import annotations

import io
import subprocess
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

MAX_BYTES = 1 << 20


def workspace_scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(relative_path, modified, length, content) of the files under root; size limits are applied before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.col("length") > 0)
    files = files.where(F.col("length") <= max_bytes) if max_bytes > 0 else files
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace("path", F.lit(r"^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base)), F.lit(""))
    return files.select(rel.alias("relative_path"), F.unix_timestamp("modificationTime").alias("modified"), "length", "content")


def is_binary(content: Column, ext: Column) -> Column:
    """A NUL in the first 1024 bytes; office files and PDF are let through."""
    return ~ext.isin("pdf", "doc", "docx", "xls", "xlsx") & (F.position(F.lit(b"\x00"), F.substring(content, 1, 1024)) > 0)


def _xml_text(data: bytes, after: set[str], before: set[str]) -> str:
    out: list[str] = []
    for event, e in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        tag = e.tag.rsplit("}", 1)[-1]
        if event == "start":
            out.append(" " if tag in before else "")
            e.set("__at", str(len(out)))
            out.append("")
        else:
            out[int(e.get("__at"))] = e.text or ""
            out.append(("\n" if tag in after else "") + (e.tail or ""))
    return "".join(out)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _xml_text(z.read("word/document.xml"), {"p", "br", "cr"}, {"tab"})


def xlsx_text(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if n == "xl/sharedStrings.xml" or n.startswith("xl/worksheets/") and n.endswith(".xml"):
                try:
                    out.append(_xml_text(z.read(n), {"t", "si", "row"}, set()))
                except ElementTree.ParseError:
                    continue
    return "".join(out)


def page_text(page) -> str:
    """A page's text: its lines as they are laid out, or as they come where that fails; a page that can't be read is empty."""
    for how in ({"extraction_mode": "layout"}, {}):
        try:
            found = page.extract_text(**how)
        except Exception:  # a bad page must not take the others with it
            continue
        if found and found.strip():
            return "\n".join(" ".join(x.split()) for x in found.splitlines())
    return ""


def sanitised(data: bytes) -> str:
    """Text of bytes: as UTF-8, or else the printable ASCII among them."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return bytes(b for b in data if 32 <= b <= 126 or b in b"\n\r\t").decode()


def read_document(ext: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a document file."""
    try:
        if ext == "docx":
            return docx_text(data), None
        if ext == "xlsx":
            return xlsx_text(data), None
        if ext in ("doc", "xls"):
            return None, f"legacy .{ext} files are not supported"
        if ext == "pdf":
            try:
                from pypdf import PdfReader
            except ImportError:
                return pdf.text(data), None
            return "\f".join(map(page_text, PdfReader(io.BytesIO(data)).pages)), None
        return data.decode("utf-8"), None
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return None, f"{type(e).__name__}: {e}"


def document_text(files: DataFrame, ext_col: str = "extension", content_col: str = "content") -> DataFrame:
    """files with text and error in place of bytes."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_document(e, bytes(d)) for e, d in zip(ext, data)], columns=["text", "error"])

    return files.withColumn("__d", run(F.col(ext_col), F.col(content_col))).select("*", "__d.text", "__d.error").drop("__d", content_col)


def drop_invalid(data: bytes) -> str:
    """Text without the bytes that aren't UTF-8."""
    return data.decode("utf-8", "ignore")


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """Words of a stop-word file: a line each, lower-cased; blanks and # lines don't count."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> '' and not startswith(w, '#')").distinct()
    return sorted(r["w"] for r in rows.collect())


def branches(folder: str) -> tuple[str, str]:
    """(current, default) branch of a working copy; main where there is none."""

    def git(*a: str) -> str:
        try:
            return subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=20).stdout.strip()
        except (OSError, subprocess.TimeoutExpired):
            return ""

    current = git("rev-parse", "--abbrev-ref", "HEAD")
    current = "main" if current in ("", "HEAD") else current
    origin = git("symbolic-ref", "refs/remotes/origin/HEAD")
    if origin:
        return current, origin.rsplit("/", 1)[-1]
    return current, next((b for b in ("main", "master") if git("rev-parse", "--verify", "--quiet", b)), "main")

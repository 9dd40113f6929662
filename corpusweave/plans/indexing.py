"""From a workspace to its points: what changed is read, cut, tagged, embedded and put in place of what was stored."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import chunking, code, embedding, index, vectors
from ..settings import Settings
from ..sources import files as documents
from ..sources.workspace import Workspace

SCHEMA = """branch string, point_id string, kind string, chunk_idx int, sub_idx int, file_path string, relative_path string, relative_dirs array<string>,
 extension string, language string, content string, chunk_hash string, page_number bigint, name string, receiver string, container string, namespace string,
 start_line bigint, end_line bigint, symbol_names array<string>, framework_tags array<string>, layer_tags array<string>, tags array<string>, is_test boolean,
 test_framework string, file_hash string, modified bigint, updated bigint, default_branch string, dense array<float>, sparse array<struct<idx:bigint,w:double>>"""
#: Buckets of paths that a branch's points are kept in; a sync writes those anew that it touches.
BUCKETS = 64
#: Rows of a file of points for each row of batch_size.
ROWS_A_BATCH = 10_000
#: What a point takes over from its file.
_OF_FILE = ("relative_path", "extension", "branch", "default_branch", "file_hash", "modified")


def workspace(spark: SparkSession, s: Settings, branch: str, default: str) -> DataFrame:
    """Files that count, with bytes, hash and branch; empty, large, binary and ignored ones don't."""
    spark.dataSource.register(Workspace)
    options = {"max_bytes": str(s.max_bytes)} | {k: ",".join(getattr(s, k)) for k in ("exclude_dirs", "exclude_exts", "allow_hidden")}
    found = spark.read.format("workspace").options(**options).load(s.root)
    found = found.withColumns({"extension": text.extension(F.col("relative_path")), "file_hash": F.sha2("content", 256), "branch": F.lit(branch), "default_branch": F.lit(default)})
    return found.where(~documents.is_binary(F.col("content"), F.col("extension")))


def _text(found: DataFrame) -> DataFrame:
    """content as text, without bytes that aren't UTF-8."""
    drop = F.pandas_udf(lambda x: x.map(lambda b: documents.drop_invalid(bytes(b))), "string")
    return found.withColumn("content", F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string")).otherwise(drop("content")))


def _none() -> Column:
    return F.array().cast("array<string>")


def _sets(tags: list[Column]) -> Column:
    return text.unique_sorted(F.concat(*tags))


def function_points(found: DataFrame, size: int = chunking.FUNCTION_BYTES) -> DataFrame:
    """One point for each function of code files, or for each piece of a long one; pieces without text count but give no point."""
    parsed = code.extract(_text(found)).drop("content")
    parsed = parsed.withColumns({"imports": F.transform("code.imports", lambda x: x["raw_path"]), "types": F.col("code.types")})
    f = code.functions_of(parsed, *_OF_FILE, "imports", "types")
    pieces = F.when(F.octet_length("content") > size, chunking.line_chunks(F.col("content"), size)).otherwise(F.array("content"))
    f = f.withColumn("pieces", pieces).select("*", F.posexplode("pieces").alias("sub_idx", "piece")).withColumn("content", F.col("piece"))
    c, rel = F.col, F.col("relative_path")
    seed = F.concat(rel, F.lit("_func_"), c("name"), F.lit("_"), c("i").cast("string"), F.when(F.size("pieces") > 1, F.concat(F.lit("_chunk_"), c("sub_idx").cast("string"))).otherwise(""))
    fields = ("name", "receiver", "container", "namespace")
    # tokens of each field are columns of their own, so that tags, layers and symbols share them
    f = f.withColumns({"seed": seed, "t_path": text.tag_tokens(rel), "own": text.file_tags(rel), "framework_tags": text.import_tags(c("language"), c("imports"))} | {f"t_{x}": text.tag_tokens(c(x)) for x in fields})
    f = f.withColumns({"t_fields": F.concat(*(c(f"t_{x}") for x in fields)), "t_imports": F.flatten(F.transform("imports", lambda x: text.tag_tokens(x))), "t_types": F.flatten(F.transform("types", lambda x: text.symbol_variants(x)))})
    f = f.withColumn("layer_tags", text.roles_of(F.concat("t_path", "t_name", "t_container", "t_namespace")))
    member = F.when(c("container") != "", F.concat_ws(".", "container", "name")).otherwise("")
    symbols = [c("t_path"), c("t_namespace"), c("t_types"), c("t_name"), c("t_container"), *(text.symbol_variants(x) for x in (c("name"), c("container"), member))]
    tags = [c("own"), F.array(F.lit("function"), c("language")), c("framework_tags"), c("layer_tags"), c("t_fields"), c("t_imports"), text.roles_of(c("t_fields"))]
    f = f.where(text.trim(c("content")) != "").withColumns({"kind": F.lit("function"), "chunk_idx": c("i").cast("int"), "sub_idx": c("sub_idx").cast("int"), "symbol_names": _sets(symbols), "tags": _sets(tags)})
    return f.drop("pieces", "piece", "i", "imports", "types", "own", *(x for x in f.columns if x.startswith("t_")))


def document_points(found: DataFrame, least: int = chunking.LEAST, most: int = chunking.MOST, overlap: int = chunking.OVERLAP) -> DataFrame:
    """One point for each clean chunk of documents, numbered within its file."""
    read = documents.document_text(found).where("error is null")
    chunks = chunking.paragraph_chunks(read, "relative_path", "text", least, most, overlap).withColumnRenamed("hash", "chunk_hash")
    numbered = chunks.withColumn("chunk_idx", F.expr("row_number() over (partition by relative_path order by at, k) - 1").cast("int")).drop("at", "k")
    rel = F.col("relative_path")
    layers = text.role_tags(rel)
    return numbered.join(found.select(*_OF_FILE), "relative_path").withColumns({
        "seed": chunking.write_identity(rel, "doc_chunk", F.col("chunk_idx")), "kind": F.lit("doc_chunk"), "language": text.language_label(rel), "framework_tags": _none(), "layer_tags": layers,
        "symbol_names": _sets([text.tag_tokens(rel), text.symbol_variants(rel)]), "tags": _sets([text.file_tags(rel), layers, F.array(F.lit("document"))]),
    })


def raw_points(found: DataFrame, size: int = chunking.RAW_BYTES) -> DataFrame:
    """One point for each clean chunk of lines; others count in the numbering."""
    rel = F.col("relative_path")
    chunks = _text(found).select(*_OF_FILE, F.posexplode(chunking.line_chunks(F.col("content"), size)).alias("chunk_idx", "content")).where(text.is_clean(F.col("content")))
    layers = text.role_tags(rel)
    return chunks.withColumns({
        "seed": chunking.write_identity(rel, "chunk", F.col("chunk_idx")), "kind": F.lit("chunk"), "chunk_idx": F.col("chunk_idx").cast("int"), "language": text.language_label(rel),
        "framework_tags": _none(), "layer_tags": layers, "symbol_names": _sets([text.tag_tokens(rel), text.symbol_variants(rel)]),
        "tags": _sets([text.file_tags(rel), layers, F.array(F.lit("file_chunk"))]),
    })


def points(found: DataFrame, call: Callable[[str], list[float]], keep: Callable[[DataFrame], DataFrame], mode: str = "full", stop=tables.STOP_WORDS, sizes: tuple[int, int, int] = (chunking.LEAST, chunking.MOST, chunking.OVERLAP), workers: int = embedding.WORKERS, shared: bool = False) -> DataFrame:
    """The points of files in the columns of SCHEMA. Documents that give no chunk are cut as raw text, but legacy office files are not.

    keep writes a step as a table and reads it, so that files are cut once and texts are embedded once.
    """
    kind = text.file_kind(F.col("extension"), mode)
    doc = found.where(kind == "document")
    chunks = keep(document_points(doc, *sizes))
    rest = doc.where(~F.col("extension").isin("doc", "xls")).join(chunks.select("relative_path").distinct(), "relative_path", "left_anti")
    raw = found.where(kind == "raw").unionByName(rest.select(*found.columns))
    p = function_points(found.where(kind == "code")).unionByName(chunks, True).unionByName(raw_points(raw), True)
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "receiver", "container", "namespace", "chunk_hash")}
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("start_line", "end_line", "page_number")}
    p = p.withColumns(blank | zero | {
        "point_id": text.point_id(F.col("seed")), "sub_idx": F.coalesce("sub_idx", F.lit(0)), "file_path": F.col("relative_path"), "relative_dirs": text.parent_dirs(F.col("relative_path")),
        "is_test": F.array_contains("tags", "test"), "test_framework": text.test_framework(F.col("framework_tags")), "updated": F.unix_timestamp(),
    })
    p = p.withColumn("search_text", text.search_text(*map(F.col, ("tags", "symbol_names", "namespace", "container", "relative_path", "content"))))
    p = keep(embedding.embed(p, "search_text", call, workers, shared))
    return p.join(vectors.sparse_vectors(p.select("point_id", "search_text"), "point_id", "search_text", stop), "point_id", "left")


def bucket() -> Column:
    return F.pmod(F.xxhash64("relative_path"), F.lit(BUCKETS)).cast("int")


#: Posting blocks of the points, by the branch and bucket of these.
POSTINGS = "branch string, block string, idx bigint, top double, ids array<string>, ws array<double>"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored points, or None before the first sync."""
    return index.PointTable(spark, path).read(SCHEMA)


def stored_postings(spark: SparkSession, path: str) -> DataFrame | None:
    """The posting blocks of the stored points, with branch; ids are those of points."""
    return index.PointTable(spark, path).read(POSTINGS, "postings")


def _shaped(df: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.replace("array<struct<idx:bigint,w:double>>", "x").split(",")]
    return df.select(*names)


def embedder(s: Settings) -> Callable[[str], list[float]]:
    return embedding.http_call(s.embedder, s.model, s.context) if s.embedder else embedding.hashed()


def stop_words(spark: SparkSession, s: Settings) -> frozenset[str]:
    """The stop words of a workspace, for its index and its searches alike."""
    path = s.stop_file()
    return tables.STOP_WORDS | frozenset(documents.stop_words(spark, path)) if path else tables.STOP_WORDS


def ensure_dimension(spark: SparkSession, s: Settings, call: Callable[[str], list[float]]) -> int:
    """The length of the vectors: as recorded beside the points, or asked of the model once and recorded. Another one is an error."""
    path, now = f"{s.points.removesuffix('/points')}/dimension", len(call("hello"))
    try:
        was = spark.read.schema("dimension int, model string").json(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        was = None
    if was is None:
        spark.createDataFrame([(now, s.model)], "dimension int, model string").coalesce(1).write.mode("overwrite").json(path)
    elif was["dimension"] != now:
        raise ValueError(f"the index holds vectors of {was['dimension']} numbers ({was['model'] or 'no model'}), the model gives {now}")
    return now


def sync(spark: SparkSession, s: Settings, only: DataFrame | None = None, call: Callable[[str], list[float]] | None = None) -> dict:
    """Brings the stored points of the current branch up to date; only: paths (column path) to look at, all if None.

    Files of a known hash are skipped before they are cut. The buckets that change get a new version, which one commit makes
    current; other buckets stay as they are. Returns numbers of files found, changed and deleted.
    """
    branch, default = documents.branches(s.root)
    call, stop = call or embedder(s), stop_words(spark, s)
    found, old = workspace(spark, s, branch, default), stored(spark, s.points)
    if only is not None:
        found = found.join(only.select(F.col("path").alias("relative_path")).distinct(), "relative_path", "left_semi")
    staging = f"{s.points.removesuffix('/points')}/staging/{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{staging}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        # all files are read and hashed once; of what changed the bytes are read once more and kept for all that cut them
        names = keep(found.select("relative_path", "branch", "file_hash"))
        if old is None:
            changed, kept, n_deleted = names, None, 0
        else:
            old = index.migrate_branch(old, branch, default).where(F.col("branch") == branch)
            state = keep(old.select("relative_path", "branch", "file_hash").distinct())
            changed, gone = keep(index.changed_files(names, state)), index.deleted_files(state, names)
            if only is not None:
                gone = gone.join(only.select(F.col("path").alias("relative_path")).distinct(), "relative_path", "left_semi")
            gone = keep(gone if s.reconcile or only is not None else gone.limit(0))
            kept, n_deleted = index.purge(index.purge(old, changed), gone), gone.count()
        total, n_changed = names.count(), changed.count()
        if n_changed or n_deleted or kept is None:
            ensure_dimension(spark, s, embedding.with_retries(call))
            touched = sorted(r["bucket"] for r in changed.select("relative_path").union(gone.select("relative_path") if old is not None else changed.select("relative_path")).select(bucket().alias("bucket")).distinct().collect())
            fresh = keep(found.join(changed.select("relative_path"), "relative_path", "left_semi").select(*found.columns))
            new = _shaped(points(fresh, call, keep, s.parser_mode, stop, (s.least_chunk, s.most_chunk, s.overlap), s.workers, bool(s.embedder)))
            ready = keep((new if kept is None else index.upsert(_shaped(kept.where(bucket().isin(touched))), new)).withColumn("bucket", bucket()))
            arrays = ready.where(F.size("sparse") > 0).select("branch", "bucket", "point_id", F.col("sparse.idx").alias("idx"), F.col("sparse.w").alias("w"))
            blocks = vectors.posting_blocks(arrays, "point_id", "branch", "bucket")
            index.PointTable(spark, s.points).commit([(branch, k) for k in touched], s.batch_size * ROWS_A_BATCH, points=ready, postings=blocks)
    finally:
        _clear(spark, staging)
    return {"files": total, "changed": n_changed, "deleted": n_deleted, "branch": branch, "default_branch": default}


def _clear(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

"""File replication: scan, manifest difference, chunks, verified reassembly, embedding."""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` stay within a folder."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include pattern fits (none given: all) and no exclude pattern does."""
    any_of = lambda ps: F.lit(False) if not ps else path.rlike("|".join(f"(?:{glob_regex(p)})" for p in ps))
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def safe_path(path: Column) -> Column:
    """Local: relative, without NUL, not leading out."""
    return path.isNotNull() & (path != "") & ~path.contains("\x00") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.contains("\\")


def scan_directory(spark, root: str, *, include: list[str] = (), exclude: list[str] = (), max_bytes: int = 1 << 30) -> DataFrame:
    """path (below root), size, mod_time, sha256 and content of the files; one beyond the limit fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root)  # the reader leaves out empty files
    none = [(i.path, i.mtime, 0, b"") for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.type == pafs.FileType.File and i.size == 0]
    files = files.select("path", "modificationTime", "length", "content").unionByName(
        spark.createDataFrame(none, "path string, modificationTime timestamp, length long, content binary")
    )
    prefix = root.split("://", 1)[-1].rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    path = F.substr(plain, F.instr(plain, prefix) + len(prefix))
    sized = F.when(F.col("length") > max_bytes, F.raise_error(F.lit("file is too large"))).otherwise(F.col("length"))
    return files.select(path.alias("path"), sized.alias("size"), F.col("modificationTime").alias("mod_time"), F.sha2("content", 256).alias("sha256"), "content").where(
        included(F.col("path"), list(include), list(exclude))
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and operation: create, update or delete. Manifests have path and sha256 (more columns may follow)."""
    a, b = old.select("path", F.col("sha256").alias("_a")), new.select("path", F.col("sha256").alias("_b"))
    op = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").otherwise("update")
    return a.join(b, "path", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", op.alias("operation"))


def to_chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """path, sha256, size, chunk, chunks, data; an empty file has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    return (
        files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"), n.alias("chunks"), "content")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("path", "sha256", "size", "chunk", "chunks", F.substring("content", F.col("chunk") * size + 1, F.lit(size)).alias("data"))
    )


def reassemble(chunks: DataFrame) -> DataFrame:
    """path, content and ok: all chunks there once, size and hash right. A file's bytes are bounded by the scan's limit."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    got = chunks.groupBy("path").agg(parts.alias("_p"), F.max("chunks").alias("_n"), F.max("sha256").alias("_sha"), F.max("size").alias("_size"))
    content = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    dense = (F.size("_p") == F.col("_n")) & F.forall(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.get("_p", i)["chunk"] == i)
    whole = got.withColumn("content", content)
    ok = dense & (F.octet_length("content") == F.col("_size")) & (F.sha2("content", 256) == F.col("_sha"))
    return whole.select("path", "content", ok.alias("ok"))


def embed(rows: DataFrame, column: str, files: DataFrame, *, max_bytes: int = 16 << 20) -> DataFrame:
    """Put a file's Base64 in the place of its path: value, source_value and encoding. A missing file fails the job."""
    content = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    path = F.ltrim(F.translate(F.col(column), "\\", "/"))
    found = rows.withColumn("_want", F.when(F.col(column).isNull(), None).otherwise(path)).join(content, F.col("_want") == F.col("_path"), "left")
    bad = F.col("_want").isNotNull() & (F.col("_content").isNull() | ~safe_path(F.col("_want")) | (F.octet_length("_content") > max_bytes))
    data = F.when(bad, F.raise_error(F.lit("file of a path column is missing, unsafe or too large"))).otherwise(F.translate(F.base64("_content"), "\r\n", ""))
    return found.select(
        *[c for c in rows.columns if c != column], F.when(F.col("_want").isNotNull(), data).alias(column), F.col(column).alias(f"{column}__source"),
        F.when(F.col("_want").isNotNull(), "base64").alias(f"{column}__encoding"),
    )


def split_embedded(rows: DataFrame, column: str, content_column: str) -> DataFrame:
    """The path back in its column, the bytes in another."""
    return rows.select(
        *[c for c in rows.columns if c not in (column, f"{column}__source", f"{column}__encoding")],
        F.col(f"{column}__source").alias(column), F.unbase64(column).alias(content_column),
    )


def totals(manifest: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Files and bytes of each group."""
    return manifest.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col(size).cast("long")).alias("bytes"))


def message_errors(messages: DataFrame, *, max_bytes: int) -> DataFrame:
    """Adds ``error`` to file messages (kind, path, operation, transaction, size, chunks, sha256, data): what is wrong first, or null."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    batch = F.col("kind").isin("file_begin", "file_chunk", "file_end")
    delete = F.col("kind") == "file_delete"
    in_limits = ~empty("transaction") & F.coalesce((F.col("size") >= 0) & (F.col("size") <= max_bytes) & (F.col("chunks") > 0), F.lit(False))
    error = (
        F.when(~F.coalesce(safe_path(F.col("path")), F.lit(False)), "path")
        .when(~F.coalesce(batch | delete, F.lit(False)), "kind")
        .when(delete, F.when(~F.coalesce(F.col("operation") == "delete", F.lit(False)) | ~empty("transaction") | ~empty("data"), "operation"))
        .when(~F.coalesce(F.col("operation").isin("create", "update"), F.lit(False)), "operation")
        .when(~in_limits, "limits")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "digest")
        .when((F.col("kind") != "file_chunk") & ~empty("data"), "content")
    )
    return messages.withColumn("error", error)

"""Source files of a directory tree, by Spark's binary reader, and the rules by which files are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, dirname, language

#: The folder of an index beside the sources, and what names of files hold that are still being written.
INDEX_FOLDER, UNFINISHED = ".symgraph", ".symgraph-tmp-"
# Directories that are never read, at any depth.
SKIPPED = (
    ".git", ".hg", ".svn", INDEX_FOLDER, "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build",
    "target", "vendor", ".next", ".nuxt", ".turbo", ".gradle", ".idea", ".vscode-test", "coverage", ".terraform", ".build", ".swiftpm", "DerivedData", "Pods", "Carthage",
)
MAX_BYTES = 1_500_000


def admitted(path: Column) -> Column:
    """Whether a relative path is below no skipped directory, isn't unfinished and has a known language."""
    parts = F.split(path, "/")
    inside_skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(*SKIPPED))
    return ~inside_skipped & ~F.contains(F.element_at(parts, -1), F.lit(UNFINISHED)) & language(path).isNotNull()


def files(
    spark: SparkSession,
    root: str,
    max_bytes: int = MAX_BYTES,
    scope: str = "",
    ignore: list[str] | None = None,
    ignore_files: tuple[str, ...] = (".gitignore",),
) -> DataFrame:
    """path, size, mtime_ms, lang, hash and text of each text file below ``root`` that has a known language.

    Paths are relative to the root.  Files with a NUL among their first 8192 bytes are binary and are left
    out, as are those above ``max_bytes``, those in skipped directories or outside of ``scope``, and what rules
    exclude: ``ignore`` and the root's ignore files in one layer, an ignore file below it in one of its own.
    Any layer can exclude, and none takes back what another excludes.  A byte order mark is dropped.

    Names are judged on the listing, so contents of files that are left out aren't read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    named, name = reader.load(root), relative(spark, root)
    kept = named.filter(admitted(name) & in_scope(name, scope) & (F.col("_metadata.file_size") <= max_bytes))
    rules = nested_rules(spark, root, ignore_files) if ignore_files else {}
    verdict = ignored(name, [*(ignore or []), *rules.pop("", [])])
    for folder, own in rules.items():
        verdict = verdict | (name.startswith(folder + "/") & ignored(F.substring(name, len(folder) + 2, 1 << 20), own))
    listed = kept.filter(~verdict).select(
        name.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content"
    )
    plain = listed.filter("locate(decode(X'00', 'ISO-8859-1'), decode(substring(content, 1, 8192), 'ISO-8859-1')) = 0")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    lang = language(F.col("path")).alias("lang")
    return plain.withColumn("text", text).select("path", "size", "mtime_ms", lang, content_hash(F.col("text")).alias("hash"), "text")


def relative(spark: SparkSession, root: str) -> Column:
    """The path of a listed file below ``root``, whatever scheme either is written with."""
    top = _qualified(spark, root).getPath().rstrip("/")
    # the listing's names are URIs, so they are decoded; a plus is one
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring(F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), len(top) + 2, 1 << 20)


def _qualified(spark: SparkSession, root: str):
    """The URI of a root, as its file system names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()


def in_order(found: DataFrame) -> DataFrame:
    """Files in the order of their paths."""
    return found.orderBy("path")


def nested_rules(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, list[str]]:
    """The rules of the tree's ignore files by folder.  There are few such files, and the plan holds their rules.

    Spark's readers pass hidden files over, so tasks look for them in each folder that has files.
    """
    uri = _qualified(spark, root)
    scheme, authority, top = uri.getScheme(), uri.getAuthority() or "", uri.getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]
        for batch in batches:
            folders = batch.column("folder").to_pylist()
            paths = [(f, "/".join(x for x in (top.rstrip("/"), f, n) if x)) for f in folders for n in names]
            there = [(f, p) for (f, p), info in zip(paths, store.get_file_info([p for _, p in paths])) if info.is_file]
            texts = [store.open_input_stream(p).readall().decode("utf-8", "replace") for _, p in there]
            yield pa.record_batch([pa.array([f for f, _ in there], pa.string()), pa.array(texts, pa.string())], names=["folder", "text"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(spark, root).alias("path"))
    parts = F.split(dirname(F.col("path")), "/")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    found = listed.select(F.explode(upto).alias("folder")).distinct().mapInArrow(run, "folder string, text string").orderBy("folder").collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r["folder"], []).extend(r["text"].splitlines())
    return out


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is the scope or below it; an empty scope is everything."""
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope.rstrip("/") + "/")


def linked(spark: SparkSession, indexes: dict[str, str], table: str) -> DataFrame | None:
    """A table of several indexes in one, with ``repo``; an index that can't be read is left out with a warning."""
    import warnings

    from pyspark.errors import AnalysisException

    out = None
    for repo, folder in indexes.items():
        try:
            rows = spark.read.parquet(f"{folder.rstrip('/')}/{table}").withColumn("repo", F.lit(repo))
        except AnalysisException as missing:
            warnings.warn(f"{repo}: {str(missing)[:200]}", stacklevel=2)
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _pattern(rule: str) -> str:
    """A rule of an ignore file as a regular expression over relative paths."""
    anchored = "/" in rule.rstrip("/")
    body, only_dirs = rule.strip("/"), rule.endswith("/")
    out, k = "", 0
    while k < len(body):
        if body[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif body[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if only_dirs else "(?:/.*)?$")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether an ignore file's rules exclude a path: the last rule that fits decides, ! includes again."""
    verdict = F.lit(False)
    for rule in (r.rstrip() for r in rules):
        if rule and not rule.startswith("#"):
            keep = rule.startswith("!")
            verdict = F.when(path.rlike(_pattern(rule.lstrip("!"))), F.lit(not keep)).otherwise(verdict)
    return verdict

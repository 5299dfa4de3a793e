"""Source trees as corpora: discovery, hashes, language, size and encoding checks.

Directories that are ignored are left out while descending, so that the reader
never lists them; contents are read by executors.  The walk here sees the
driver's own disk; trees of other stores are listed by :mod:`siftline.sources.listing`.
"""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import glob_regex
from siftline.sources.syntax import EXTENSIONS

#: Larger files become issues and are not read.
MAX_BYTES = 8 * 1024 * 1024
#: The engine's own folder in a project.
STATE = ".siftline"
# Folders that discovery leaves out wherever they are.
IGNORED = (
    ".git", STATE, "node_modules", ".next", ".nuxt", "dist", "coverage", "target", "build", ".venv", "venv", "__pycache__",
    ".tox", ".mypy_cache", ".pytest_cache", "vendor", ".idea", ".gradle",
)


class ScopeError(ValueError):
    """A path to scan that isn't there; fatal for the whole scan."""


def resolve(paths: list[str]) -> list[str]:
    """Paths to scan, the working directory if none; all must exist."""
    for p in paths or ["."]:
        if not os.path.exists(p):
            raise ScopeError(f"path does not exist: {p}")
    return list(paths) or ["."]


def excluded(relative: str, globs: list[str]) -> bool:
    """Whether a glob of one segment matches any component, or one of several a run of components."""
    parts = [p for p in relative.replace("\\", "/").split("/") if p not in ("", ".")]
    for g in globs:
        want = [re.compile(glob_regex(x) + r"\Z", re.S) for x in g.strip("/").split("/")]
        if any(all(w.match(p) for w, p in zip(want, parts[i:])) for i in range(len(parts) - len(want) + 1)):
            return True
    return False


def exclude_col(path: Column, globs: list[str]) -> Column:
    """:func:`excluded` natively, for path columns of any table."""
    out = F.lit(False)
    for g in globs:
        segments = [glob_regex(x).replace(".*", "[^/]*") for x in g.strip("/").split("/")]
        out = out | path.rlike("(?:^|/)" + "/".join(segments) + "(?:/|$)")
    return out


def discover(targets: list[str], excludes: list[str] | None = None) -> list[str]:
    """Regular files below targets, by name within each folder; links aren't followed.

    A target that is a file is taken whatever its name; a target folder's own name is never ignored.
    """
    out: list[str] = []

    def descend(folder: str, root: str) -> None:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            relative = os.path.relpath(entry.path, root)
            if entry.is_symlink() or excluded(relative, excludes or []):
                continue
            if entry.is_dir():
                if entry.name not in IGNORED:
                    descend(entry.path, root)
            elif entry.is_file():
                out.append(entry.path)

    for t in targets:
        if os.path.isdir(t):
            descend(t, t)
        elif os.path.isfile(t) and not os.path.islink(t):
            out.append(t)
    return out


def language_col(path: Column) -> Column:
    """Language of an extension, case and all; 'unknown' otherwise."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(table[F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)], F.lit("unknown"))


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, length, content) of files; any file system Spark knows.  Files over the limit are listed, not read."""
    if not files:
        return spark.createDataFrame([], "path string, length long, content binary")
    wanted = spark.createDataFrame([(os.path.abspath(f), f) for f in files], "absolute string, shown string")
    rows = spark.read.format("binaryFile").load([Path(f).absolute().as_uri() for f in files])
    small = rows.filter(F.col("length") <= MAX_BYTES).select("path", "length", "content")  # the source sees the filter first
    large = rows.filter(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"))
    local = F.expr("url_decode(replace(regexp_replace(path, '^file:/+', '/'), '+', '%2B'))")
    return small.unionByName(large).withColumn("absolute", local).join(wanted, "absolute").select(F.col("shown").alias("path"), "length", "content")


def prepare(files: DataFrame) -> DataFrame:
    """(file_id, path, language, length, source_hash, text, status, message) of files (path, length, content).

    ``status``: analysed, skipped (unsupported language), or read (an issue: too large, or not UTF-8).
    """
    small = F.col("length") <= MAX_BYTES
    gone = small & F.col("content").isNull()
    valid = small & F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    known = F.col("language") != "unknown"
    status = F.when(~small, "read").when(~known, "skipped").when(~valid, "read").otherwise("analysed")
    message = F.when(~small, F.concat(F.lit("file exceeds "), F.lit(str(MAX_BYTES)), F.lit(" byte(s) limit"))).when(known & gone, "file could not be read").when(known & ~valid, "stream did not contain valid UTF-8")
    return files.withColumn("language", language_col(F.col("path"))).select(
        F.xxhash64("path").alias("file_id"),
        "path",
        "language",
        "length",
        F.sha2("content", 256).alias("source_hash"),
        F.when(status == "analysed", F.decode("content", "UTF-8")).alias("text"),
        status.alias("status"),
        message.alias("message"),
    )


#: Leaves of the tree of hashes over a set of files.
LEAVES = 4096


def scope_id(prepared: DataFrame) -> str:
    """Identity of a whole set of files: a tree of hashes over paths and contents in the order of paths.

    Files are dealt to leaves by a hash of their path, a leaf hashes its files in order, and the root hashes the leaves in
    order; so nothing large is gathered, and the partitioning of the table doesn't matter.
    """
    rows = prepared.select("path", "source_hash", F.pmod(F.xxhash64("path"), F.lit(LEAVES)).alias("leaf"))
    file = F.struct("path", F.sha2(F.concat_ws("\0", "path", "source_hash"), 256).alias("hash"))
    leaves = rows.groupBy("leaf").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(file)), lambda f: f["hash"]), ""), 256).alias("hash"))
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "hash"))), lambda x: F.concat_ws(":", x["leaf"], x["hash"])), ","), 256)
    return leaves.agg(root).first()[0]


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args, "-z"], capture_output=True, check=False)
    if done.returncode:
        raise ScopeError(f"git failed: {done.stderr.decode('utf-8', 'replace').strip()}")
    return [p for p in done.stdout.decode("utf-8", "surrogateescape").split("\0") if p]


def changed_files(root: str = ".") -> list[str]:
    """Files that differ from the index, and untracked ones, that exist; sorted."""
    names = {*_git(root, "diff", "--name-only", "--relative"), *_git(root, "ls-files", "--others", "--exclude-standard")}
    return sorted(os.path.join(root, n) for n in names if os.path.isfile(os.path.join(root, n)))


def staged_files(root: str = ".") -> list[str]:
    names = _git(root, "diff", "--cached", "--name-only", "--relative")
    return sorted(os.path.join(root, n) for n in set(names) if os.path.isfile(os.path.join(root, n)))


def under(files: list[str], roots: list[str]) -> list[str]:
    """Files below any of the roots, by whole components; all of them if there are no roots."""
    if not roots:
        return files
    whole = [Path(r).absolute().parts for r in roots]
    return [f for f in files if any(Path(f).absolute().parts[: len(r)] == r for r in whole)]

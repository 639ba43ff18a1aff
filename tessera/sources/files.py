"""Directories as tables: discovery, ignore rules, hashes, texts and line ranges."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import LANGUAGES, language_of
from tessera.operators.chunking import lines_of, normalized

# The largest file, names without an extension that are read, and patterns that are never read.
MOST_BYTES, MOST_LINES = 2 * 1024 * 1024, 400
PLAIN_NAMES = ("Dockerfile", "Makefile", "Jenkinsfile")
EXTENSIONS = tuple(LANGUAGES)
IGNORED = (
    ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", "node_modules", "dist", "build", ".venv", "venv",
    "env", ".tox", ".eggs", "*.egg-info", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.dll", "*.a", "*.lib", "*.o", "*.obj",
    "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".DS_Store", "Thumbs.db", "*.min.js", "*.min.css", "*.map",
    ".tessera", ".env*", "*.pem", "*.key", "*.pkcs12", "*.pfx", "id_rsa*", "id_ed25519*",
    "*credential*", "*secret*", ".aws*", ".ssh*", "vendor", "third_party", "deps", "redis-stable*", "*.tar.gz",
)


def ignore_patterns(root: str) -> list[str]:
    """The fixed patterns and those of the root's .gitignore and .ignore; no negation, no anchors."""
    out = list(IGNORED)
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                out += [x for x in map(str.strip, f) if x and not x.startswith("#")]
        except OSError:
            pass
    return [p.rstrip("/") for p in out]


def as_regex(patterns: list[str]) -> str:
    """One anchored expression for all patterns."""
    parts = [fnmatch.translate(p).replace("(?s:", "(?:").replace("\\z", "$").replace("\\Z", "$") for p in patterns]
    return "(?s)^(?:" + "|".join(parts) + ")$"


def is_ignored(path: Column, size: Column, patterns: list[str]) -> Column:
    """Whether a relative path is left out: by a pattern on the path or a part, a hidden part, extension or size."""
    regex = as_regex(patterns)
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    kind = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1)).isin(*EXTENSIONS) | name.isin(*PLAIN_NAMES)
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", ".."))
    return F.rlike(path, F.lit(regex)) | F.exists(parts, lambda p: F.rlike(p, F.lit(regex))) | hidden | ~kind | (size > MOST_BYTES)


def read_files(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """file_path (relative), absolute_path, language, file_hash (of the bytes), text, total_lines, total_bytes.

    The listing and the filter run on paths and sizes before any content is decoded.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(os.path.abspath(base) if "://" not in base else base) + "/", "")
    kept = raw.withColumn("file_path", relative).where(~is_ignored(F.col("file_path"), F.col("length"), patterns or ignore_patterns(base)))
    text = normalized(F.decode(F.col("content"), "UTF-8"))
    d = kept.select("file_path", F.col("path").alias("absolute_path"), language_of(F.col("file_path")).alias("language"), F.sha2("content", 256).alias("file_hash"), text.alias("text"))
    return d.select("*", F.size(lines_of(F.col("text"))).alias("total_lines"), F.octet_length("text").cast("long").alias("total_bytes"))


def _quoted(path: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in path)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """The paths that are read, sorted."""
    return read_files(spark, root).select("file_path").orderBy("file_path")


def line_range(files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """file_path, content: lines start to end (at most MOST_LINES) of one file."""
    end = end if end is not None else start + MOST_LINES - 1
    if start < 1 or end < start or end - start + 1 > MOST_LINES:
        raise ValueError(f"lines {start} to {end}: at most {MOST_LINES}, from 1 on, in order")
    if os.path.isabs(path) or ".." in path.split("/"):
        raise ValueError(f"{path} is outside the repository")
    return files.where(F.col("file_path") == path).select("file_path", F.array_join(F.slice(lines_of(F.col("text")), start, end - start + 1), "\n").alias("content"))

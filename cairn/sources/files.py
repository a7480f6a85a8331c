"""File sources: repository scans, language map, ignore rules, JSON sets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import extension

# Languages by extension, admitted extensions and directories left out of a scan, the size limit.
LANGUAGES = {".cs": "CSharp", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".xaml": "Xaml", ".sql": "Sql", ".md": "Markdown", ".txt": "PlainText", ".json": "PlainText", ".xml": "PlainText", ".csproj": "PlainText"}
SKIPPED_DIRS = ["bin", "obj", "node_modules", ".git", ".vs", "__pycache__", ".idea", "packages", "migrations"]
MAX_BYTES = 524_288


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(table, extension(path)), F.lit("Unknown"))


def in_skipped_dir(path: Column, names: list[str] = SKIPPED_DIRS) -> Column:
    parts = F.transform(F.split(path, "/"), F.lower)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(n.lower()) for n in names)))


def glob_to_regex(glob: str, anchored: bool) -> str:
    """A path pattern as a regular expression: * and ? stay within a segment, ** crosses."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + ("" if anchored else "(?:.*/)?") + "".join(known.get(p) or re.sub(r"([^\w/ ])", r"\\\1", p) for p in parts if p) + "$"


def parse_rules(lines: Iterable[str]) -> list[tuple[int, str, bool, bool]]:
    """(order, pattern, negated, directories only) of an ignore file's lines."""
    out = []
    for raw in lines:
        line = raw.rstrip()
        if not line or line[0] == "#":
            continue
        negated = line[0] == "!"
        line = line[negated:]
        only = line.endswith("/")
        line = line[: len(line) - only]
        anchored = line.startswith("/") or "/" in line.rstrip("/")
        line = line.lstrip("/")
        if line:
            out.append((len(out), glob_to_regex(line, anchored), negated, only))
    return out


def ignored(path: Column, rules: list[tuple[int, str, bool, bool]], directory: bool = False) -> Column:
    """Whether the last rule that matches a path, or a directory above it, excludes it. Leading dots and slashes are not part of the path."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", ""), r"/+$", "")
    parts = F.split(clean, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    out = F.lit(False)
    for _, pattern, negated, only in rules:
        own = F.lit(False) if only and not directory else clean.rlike(pattern)
        out = F.when(own | _any(above, pattern), not negated).otherwise(out)
    return F.when(clean == "", False).otherwise(out)


def _any(paths: Column, pattern: str) -> Column:
    return F.exists(paths, lambda p: p.rlike(pattern))


def scan(spark: SparkSession, root: str, rules: Iterable[str] = (), languages: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, relative_path, language, modified, size, text, failed): files under root that the extension map, size, directories and ignore rules admit.

    Listing and reading are Spark's, the filter on length is pushed to the listing. A file that is no UTF-8 gives a row without
    text, its reason in `failed`; scan_summary() counts them. Files that vanish while they are read are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root).where(F.col("length") <= max_bytes)
    relative = F.regexp_replace("path", "^.*?" + re.escape("/" + root.rstrip("/").split("/")[-1] + "/"), "")
    named = files.withColumn("relative_path", relative).withColumn("language", language(F.col("path")))
    kept = named.where((F.col("language") != "Unknown") & ~in_skipped_dir(F.col("relative_path")) & ~ignored(F.col("relative_path"), parse_rules(rules)))
    if languages is not None:
        kept = kept.where(F.col("language").isin(languages))
    sound = F.is_valid_utf8(F.col("content").cast("string"))
    return kept.select("path", "relative_path", "language", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.when(sound, F.col("content").cast("string")).alias("text"), F.when(~sound, "not UTF-8").alias("failed"))


def scan_summary(files: DataFrame) -> DataFrame:
    """(state, files, bytes) of scanned files: Processed, Failed."""
    state = F.when(F.col("failed").isNull(), "Processed").otherwise("Failed")
    return files.groupBy(state.alias("state")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def json_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects in one (possibly gzipped) JSON file or many."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def to_json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object with snake-case names as they stand."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def to_markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a Markdown table line."""
    cells = reduce(lambda a, b: F.concat(a, F.lit(" | "), b), (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))

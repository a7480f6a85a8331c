"""Chunkers: sliding windows, Markdown sections with a paragraph budget, brace blocks, routing and assembly."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.identity import chunk_id, content_hash, identity_key
from cairn.functions.text import lines, token_estimate
from cairn.sources.tables import slices, text_batches

#: Part of provenance: raise it with any change of what chunkers give.
CHUNK_CONTRACT = 1
# Window geometry (lines are taken as 80 characters, tokens as 4) and budgets.
MAX_TOKENS, OVERLAP_TOKENS, MIN_LINES, LINE_CHARS, TOKEN_CHARS = 512, 64, 5, 80, 4
MIN_CHARS = 60
PREAMBLE = "Documento Principal"


def window_geometry(max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, min_lines: int = MIN_LINES) -> tuple[int, int, int]:
    """(lines of a window, overlap, step)."""
    size = max(min_lines, max_tokens * TOKEN_CHARS // LINE_CHARS)
    shared = overlap * TOKEN_CHARS // LINE_CHARS
    return size, shared, max(1, size - shared)


def window_chunks(files: DataFrame, size: int | None = None, step: int | None = None, min_chars: int = 0) -> DataFrame:
    """(id, fragment, start_line, end_line, content) of files(id, text): overlapping line windows, trimmed, blank ones skipped; fragments count what is given."""
    own_size, _, own_step = window_geometry()
    size, step = size or own_size, step or own_step
    cut = files.select("id", lines(F.coalesce(F.col("text"), F.lit(""))).alias("lines"))
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: (i == 0) | (i - step + size < n))
    each = cut.select("id", "lines", F.explode(starts).alias("i"))
    content = F.regexp_replace(F.array_join(F.slice("lines", F.col("i") + 1, size), "\n"), r"^[\s]+|[\s]+$", "")
    made = each.select("id", (F.col("i") + 1).cast("long").alias("start_line"), F.least(F.col("i") + size, n).cast("long").alias("end_line"), content.alias("content")).where(F.length("content") > min_chars)
    return made.withColumn("fragment", F.row_number().over(Window.partitionBy("id").orderBy("start_line")).cast("long"))


def budget_groups(lengths: Column, header: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Group number of each paragraph, from 0: greedy packing of texts (by length) joined by blank lines under a header, at most max_tokens estimated; one that is too long stays whole."""
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("group"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        size = F.when(acc["held"] == 0, header + 2 + n).otherwise(acc["size"] + 2 + n)
        over = (F.ceil(size / 4.0) > max_tokens) & (acc["held"] > 0)
        group = F.when(over, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.when(over, header + 2 + n).otherwise(size).cast("long").alias("size"), group.alias("group"), F.when(over, 1).otherwise(acc["held"] + 1).alias("held"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def markdown_paragraphs(files: DataFrame) -> DataFrame:
    """(id, section, header, section_start, paragraph, start_line, end_line, text): paragraphs of sections.

    A section begins at a header line; what comes before is the preamble. As the contract has it, a paragraph's lines count from one
    past the section's first line, in the preamble too. Texts are windowed by file only, in line order.
    """
    each = files.select("id", F.posexplode(lines(F.coalesce(F.col("text"), F.lit("")))).alias("i", "line"))
    order = Window.partitionBy("id").orderBy("i")
    head = each.withColumn("is_header", F.col("line").rlike(r"^(#{1,6})\s+(.*)")).withColumn("section", F.sum(F.col("is_header").cast("int")).over(order))
    first = Window.partitionBy("id", "section")
    title = F.first(F.when(F.col("is_header"), F.col("line")), ignorenulls=True).over(first.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    body = head.withColumn("header", F.coalesce(F.trim(F.regexp_replace(title, r"^#+", "")), F.lit(PREAMBLE))).withColumn("section_start", F.min("i").over(first) + 1)
    body = body.where(~F.col("is_header")).withColumn("blank", F.trim(F.regexp_replace("line", r"\s+", " ")) == "")
    inside = Window.partitionBy("id", "section").orderBy("i")
    body = body.withColumn("para", F.sum(F.col("blank").cast("int")).over(inside)).withColumn("n", F.row_number().over(inside))
    made = body.where(~F.col("blank")).groupBy("id", "section", "header", "section_start", "para").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return made.withColumn("paragraph", F.row_number().over(Window.partitionBy("id", "section").orderBy("para"))).select("id", F.col("section").cast("long").alias("section"), "header", F.col("section_start").cast("long").alias("section_start"), F.col("paragraph").cast("long").alias("paragraph"), (F.col("section_start") + F.col("low")).cast("long").alias("start_line"), (F.col("section_start") + F.col("high")).cast("long").alias("end_line"), "text")


def markdown_chunks(files: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, section, chunk, header, start_line, end_line, content): paragraphs of a section packed to the budget; the first chunk starts at the section's line."""
    packed = markdown_paragraphs(files).groupBy("id", "section", "header", "section_start").agg(F.sort_array(F.collect_list(F.struct("paragraph", "start_line", "end_line", "text"))).alias("paras"))
    label = F.concat(F.lit("[Sección: "), F.col("header"), F.lit("]"))
    groups = packed.withColumn("groups", budget_groups(F.transform("paras", lambda p: F.length(p["text"])), F.length(label), max_tokens))
    each = groups.select("id", "section", "header", "section_start", F.explode(F.arrays_zip("paras", "groups")).alias("x")).select("id", "section", "header", "section_start", F.col("x.groups").cast("long").alias("chunk"), F.col("x.paras").alias("p"))
    made = each.groupBy("id", "section", "header", "section_start", "chunk").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    start = F.when(F.col("chunk") == 0, F.col("section_start")).otherwise(F.element_at("ps", 1)["start_line"])
    content = F.concat(label, F.lit("\n\n"), F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n"))
    return made.select("id", "section", "chunk", "header", start.alias("start_line"), F.element_at("ps", -1)["end_line"].alias("end_line"), content.alias("content"))


def indexable(content: Column, kind: Column, class_name: Column, defined: Column, keep_short_types: Column | bool = False, least: int = MIN_CHARS) -> Column:
    """Long enough once trimmed; or, if asked, a short class or interface that defines its own name."""
    short = kind.isin("Class", "Interface") & F.coalesce(F.array_contains(defined, class_name), F.lit(False))
    return (F.length(F.trim(content)) >= least) | (F.lit(keep_short_types) if isinstance(keep_short_types, bool) else keep_short_types) & short


# Identifiers that are no symbols in the brace languages.
TS_NOISE = """var let const function class interface type enum extends implements return if else for while do
switch case break continue try catch finally throw new this super true false null undefined void
typeof instanceof in of async await export import default public private protected static readonly
abstract override as from number string boolean any""".split()
CS_NOISE = """var int string bool double float decimal long short byte char object void true false null this base
new return if else for foreach while do switch case break continue try catch finally throw using
namespace class struct interface enum public private protected internal static readonly const async await
get set value nameof typeof default out ref in is as yield params""".split()
#: Comments, quoted text of three kinds, identifiers.
TS_LEXER = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\z)|'(?:\\(?s:.)|[^'\\])*(?:'|\\?\z)|`(?:\\(?s:.)|[^`\\])*(?:`|\\?\z)|[\p{L}_$][\p{L}\p{Nd}_$]*"""


def symbols(text: Column, noise: list[str] = TS_NOISE) -> Column:
    """Identifiers outside comments and quotes, distinct and in order."""
    found = F.filter(F.regexp_extract_all(text, F.lit(TS_LEXER), F.lit(0)), lambda w: w.rlike(r"^[\p{L}_$]"))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, noise))))


def symbol_roles(text: Column, noise: list[str] = CS_NOISE) -> tuple[Column, Column]:
    """(defined, consumed) identifiers: names of types and of members that open a body, and all others that the text uses."""
    types = F.regexp_extract_all(text, F.lit(r"\b(?:class|interface|struct|enum|record)\s+([\p{L}_]\w*)"), F.lit(1))
    members = F.regexp_extract_all(text, F.lit(r"([\p{L}_]\w*)\s*\([^(){};]*\)\s*\{"), F.lit(1))
    found = symbols(text, noise)
    defined = F.array_intersect(found, F.concat(types, members))
    return defined, F.array_except(found, defined)


#: Words that may stand before what a line declares, and what a line that opens a block looks like without them, white space collapsed.
MODIFIERS = frozenset("export default declare abstract async public private protected static override readonly".split())
OPENINGS = [
    ("Class", re.compile(r"class (\w+)")),
    ("Function", re.compile(r"function ?\*? ?(\w+) ?[<(]")),
    ("Function", re.compile(r"(?:const|let|var) (\w+) ?= ?(?:async ?)?\(")),
    ("Method", re.compile(r"(\w+) ?[<(][^=]*\) ?(?::[^={}]+)?\{?$")),
]
DECORATOR = re.compile(r"\s*@(\w+)")
_MARKS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|[{}\n]""", re.S)


def signature(line: str) -> tuple[str, str] | None:
    """(kind, name) of the block that a line opens."""
    said = line.split()
    while said and said[0] in MODIFIERS:
        del said[0]
    rest = " ".join(said)
    for kind, pattern in OPENINGS:
        if (m := pattern.match(rest)) and m[1] not in TS_NOISE:
            return kind, m[1]
    return None


def brace_blocks(text: str) -> list[tuple[int, int, str, str | None, str | None]]:
    """(first line, last line, kind, name, decorator) of the blocks of a brace language, and of the loose lines between them.

    Braces in comments and quoted text do not count. A block that is never closed reaches the end. A decorator's line is loose;
    the block that comes next bears the name of the last one.
    """
    rows = re.sub("\r\n?", "\n", text).split("\n")
    # Depth of braces after each line, all quoting resolved in one pass over the text.
    depth, opened, now, line = [0] * len(rows), [0] * len(rows), 0, 0
    for m in _MARKS.finditer("\n".join(rows)):
        s = m[0]
        if s in "{}":
            now += 1 if s == "{" else -1
            opened[line] += s == "{"
        for _ in range(s.count("\n")):
            depth[line] = now
            line += 1
    depth[line:] = [now] * (len(rows) - line)
    out, loose, i, decorator = [], 0, 0, None
    while i < len(rows):
        if m := DECORATOR.match(rows[i]):
            decorator, i = m[1], i + 1
            continue
        sig = signature(rows[i])
        if sig is None:
            i += 1
            continue
        if any(r.strip() for r in rows[loose:i]):
            out.append((loose + 1, i, "PlainTextWindow", None, None))
        base = depth[i - 1] if i else 0
        j, seen = i, False
        while j < len(rows):
            seen = seen or opened[j] > 0
            if seen and depth[j] <= base:
                break
            j += 1
        j = min(j, len(rows) - 1)
        out.append((i + 1, j + 1, *sig, decorator))
        i = loose = j + 1
        decorator = None
    if any(r.strip() for r in rows[loose:]):
        out.append((loose + 1, len(rows), "PlainTextWindow", None, None))
    return out


def packed_paragraphs(rows: list[str], first: int, header: int, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, str]]:
    """(first line, last line, content) of a block: whole within the budget, else its paragraphs, packed greedily; one that is too long stays whole."""
    body = "\n".join(rows)
    if -(-(header + len(body)) // TOKEN_CHARS) <= max_tokens:
        return [(first, first + len(rows) - 1, body)]
    paras, start = [], None
    for i, r in enumerate([*rows, ""]):
        if r.strip():
            start = i if start is None else start
        elif start is not None:
            paras.append((start, i - 1, "\n".join(rows[start:i])))
            start = None
    out: list[list] = []
    size = 0
    for a, b, text in paras:
        more = len(text) + 2
        if out and -(-(size + more) // TOKEN_CHARS) <= max_tokens:
            out[-1][1], size = b, size + more
            out[-1][2] += "\n\n" + text
        else:
            out.append([a, b, text])
            size = header + more
    return [(first + a, first + b, text) for a, b, text in out]


def brace_chunks(files: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, kind, name, decorator, start_line, end_line, content) of files(id, text) in brace languages: one Arrow pass, one file at a time.

    A worker holds about 2 MB of texts and what they give at a time. Blocks over the budget are split by paragraphs, so that several rows may bear one name. C# goes this way too, as an approximation without a syntax tree.
    """
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, cols = [], [[] for _ in kinds]
            for i, text in enumerate(b.column("text").to_pylist()):
                rows = re.sub("\r\n?", "\n", text or "").split("\n")
                for first, last, kind, name, decorator in brace_blocks(text or ""):
                    for a, z, content in packed_paragraphs(rows[first - 1 : last], first, len(name or "") + len(decorator or ""), max_tokens):
                        at.append(i)
                        for c, x in zip(cols, (kind, name, decorator, a, z, content)):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "kind", "name", "decorator", "start_line", "end_line", "content"])

    text_batches(files.sparkSession)
    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", "text").mapInArrow(run, f"id {kind}, kind string, name string, decorator string, start_line long, end_line long, content string")


#: Extension point: language to chunker; what is not listed falls back to windows.
CHUNKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Markdown": lambda f: markdown_chunks(f).select("id", F.lit("MarkdownSection").alias("kind"), F.col("header").alias("name"), "start_line", "end_line", "content"),
    "TypeScript": brace_chunks,
    "CSharp": brace_chunks,
}


def route(files: DataFrame, chunkers: dict[str, Callable[[DataFrame], DataFrame]] = CHUNKERS) -> DataFrame:
    """(id, kind, name, start_line, end_line, content) of files(id, language, text), each by its language's chunker."""
    out = window_chunks(files.where(~F.coalesce(F.col("language"), F.lit("")).isin(*chunkers))).select("id", F.lit("PlainTextWindow").alias("kind"), F.lit(None).cast("string").alias("name"), "start_line", "end_line", "content")
    for language, chunker in chunkers.items():
        out = out.unionByName(chunker(files.where(F.col("language") == language)).select("id", "kind", "name", "start_line", "end_line", "content"))
    return out


def assemble(chunks: DataFrame, repo: Column, path: Column) -> DataFrame:
    """Chunks with content_hash, chunk_id and token_count."""
    hashed = chunks.withColumn("content_hash", content_hash(F.col("content")))
    return hashed.withColumn("chunk_id", chunk_id(identity_key(repo, path), F.col("start_line"), F.col("content_hash"))).withColumn("token_count", token_estimate(F.col("content")))

"""Text functions as Column expressions: the sparse lexer, stemming, weights, token estimates, sanitising and counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that the lexer drops before folding, whatever their case.
STOP_WORDS = """que qué es un una el la los las de del para por con como cómo en a al su sus
what is a an the of for by with how in to on and""".split()
DROPPED_WORDS = """var let const new this base return await async public private protected internal static
void class interface struct enum record sealed abstract override virtual readonly partial using
namespace get set init null true false if else for foreach while do switch case break
continue throw try catch finally in out ref params typeof is as where from select yield
value default object string int bool float double long byte char uint
the and for with that this are was has have not but from its into then than
also any can will all when used use""".split()
# Terms whose weight is multiplied by 0.30 or 0.65; compared after folding and stemming.
HEAVY_WORDS = """task list array type name value data item items result results response request context
config options service services model models exception error message logger log info
cancellation token index count size length add get set create build run start stop
init load save read write send receive""".split()
MODERATE_WORDS = """async await handler factory builder manager provider repository controller middleware pipeline
client server host register resolve inject scope singleton transient event callback action""".split()
# Accents and what they fold to.
ACCENTS, PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc"
# Limits of terms and the size of the hashed index.
MIN_TERM, MAX_TERM, MAX_COUNT, INDEX_SIZE = 2, 128, 10, 1 << 20
HEAVY, MODERATE = 0.30, 0.65

#: One alternation that skips comments, quoted text and numbers, and stops at words.
LEXER = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\z)|'(?:\\(?s:.)|[^'\\])*(?:'|\\?\z)|\p{Nd}[\p{L}\p{Nd}._]*|\p{L}[\p{L}\p{Nd}]*"""
#: The same for Java: a part of a word up to its next camel-case border, with the gap behind it, or whatever else is skipped. Possessive, so that long quotes need no stack.
_GAP = r"""[^/"'\p{L}\p{Nd}]"""
PARTS = (
    r"(\p{L}(?:[a-z\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}]++|(?<!\p{Ll})(?!(?<=\p{Lu})\p{Lu}\p{Ll})\p{Lu})*+)" + f"{_GAP}*+|{_GAP}++|"
    r"""\p{Nd}[\p{L}\p{Nd}._]*+|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\\?\z)|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|/"""
)


def words(text: Column) -> Column:
    """Words outside comments, quotes and numbers, parted at camel-case borders."""
    return F.array_remove(F.split(F.regexp_replace(text, PARTS, "$1 "), " "), "")


def fold(word: Column) -> Column:
    return F.translate(F.lower(word), ACCENTS, PLAIN)


def stem(word: Column) -> Column:
    """Drop a final s (not ss), then a final a, o or e, from words of five letters or more."""
    n, ends = F.length(word), lambda *tails: reduce(lambda a, b: a | b, (word.endswith(t) for t in tails))
    less = lambda k: F.left(word, n - k)
    plural = F.when(ends("as", "os", "es") & (n > 5), less(2)).otherwise(less(1))
    return F.when((n < 5) | word.endswith("ss"), word).when(word.endswith("s"), plural).when(ends("a", "o", "e"), less(1)).otherwise(word)


def stemmed(words_: list[str]) -> list[str]:
    """The same in Python, for word lists."""
    out = set()
    for w in words_:
        w = w.lower().translate(str.maketrans(ACCENTS, PLAIN))
        if len(w) >= 5 and w[-1] == "s" and w[-2] != "s":
            w = w[:-1]
        out.add(w[:-1] if len(w) >= 5 and w[-1] in "aoe" else w)
    return sorted(out)


_HEAVY, _MODERATE = frozenset(stemmed(HEAVY_WORDS)), frozenset(stemmed(MODERATE_WORDS))


def terms(text: Column) -> Column:
    """Index terms of a text, repeats included."""
    kept = F.filter(words(text), lambda w: F.length(w).between(MIN_TERM, MAX_TERM) & ~F.lower(w).isin(sorted({*STOP_WORDS, *DROPPED_WORDS})))
    return F.transform(F.transform(kept, fold), stem)


def idf(term: Column) -> Column:
    """A static multiplier; a term of both lists counts as heavy."""
    return F.when(term.isin(stemmed(HEAVY_WORDS)), HEAVY).when(term.isin(stemmed(MODERATE_WORDS)), MODERATE).otherwise(1.0)


def idf_of(term: str) -> float:
    """The same in Python."""
    return HEAVY if term in _HEAVY else MODERATE if term in _MODERATE else 1.0


def weight(count: Column, term: Column) -> Column:
    tf = F.least(count, F.lit(MAX_COUNT)).cast("double")
    return tf / (tf + 1) * idf(term)


def murmur3(term: Column) -> Column:
    """32-bit Murmur3 over UTF-16 units in pairs, seed 0xDEADC0DE, as a long; characters of the basic plane."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, c: int) -> Column:
        high = F.shiftleft(F.shiftrightunsigned(a, 16) * c % 65536, 16)
        return (a % 65536 * c + high).bitwiseAND(mask)

    def rotated(a: Column, r: int) -> Column:
        return F.shiftleft(a, r).bitwiseOR(F.shiftrightunsigned(a, 32 - r)).bitwiseAND(mask)

    def unit(i: Column) -> Column:
        return F.ascii(F.substring(term, i, F.lit(1))).cast("long")

    def mixed(k: Column) -> Column:
        return times(rotated(times(k, 0xCC9E2D51), 15), 0x1B873593)

    def block(h: Column, i: Column) -> Column:
        k = unit(2 * i - 1) + unit(2 * i) * 65536
        return (rotated(h.bitwiseXOR(mixed(k)), 13) * 5 + 0xE6546B64).bitwiseAND(mask)

    n = F.length(term)
    pairs = F.when(n >= 2, F.sequence(F.lit(1), (n / 2).cast("int"))).otherwise(F.array().cast("array<int>"))

    def final(h: Column) -> Column:
        h = F.when(n % 2 == 1, h.bitwiseXOR(mixed(unit(n)))).otherwise(h)
        return h.bitwiseXOR(n.cast("long"))

    h = F.aggregate(pairs, F.lit(0xDEADC0DE).cast("long"), block, final)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def bucket(term: Column) -> Column:
    return murmur3(term) % INDEX_SIZE


def bucket_of(term: str) -> int:
    """The same in Python."""
    mask, u, h = 0xFFFFFFFF, [ord(c) for c in term], 0xDEADC0DE

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return (k << 15 | k >> 17) * 0x1B873593 & mask

    for a, b in zip(u[::2], u[1::2]):
        h ^= mixed(a + b * 65536)
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(u) % 2:
        h ^= mixed(u[-1])
    h ^= len(u)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return (h ^ h >> 16) % INDEX_SIZE


def with_bucket(postings: DataFrame, remembered: int = 1 << 18) -> DataFrame:
    """(id, term_index, weight) of postings(id, term, weight): a worker hashes a term once, so that nothing is joined or lexed again for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            coded = b.column("term").dictionary_encode()
            if len(known) > remembered:
                known.clear()
            index = []
            for t in coded.dictionary.to_pylist():
                if (at := known.get(t)) is None:
                    at = known[t] = bucket_of(t)
                index.append(at)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(index, pa.int64()).take(coded.indices), b.column("weight")], names=["id", "term_index", "weight"])

    return postings.select("id", "term", "weight").mapInArrow(run, "id long, term_index long, weight double")


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded up; none for empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0).cast("long")


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """Cut to a budget at white space, with an ellipsis; a hard cut where there is none."""
    cut = F.substring(text, 1, tokens * 4)
    head = F.rtrim(F.regexp_extract(cut, r"(?s)^(.*)\s", 1))
    return F.when(F.length(text) <= tokens * 4, text).otherwise(F.concat(F.when(head == "", cut).otherwise(head), F.lit("...")))


def lines(text: Column) -> Column:
    """Lines, whatever the line ends; empty ones stay."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


ENTITY_PREFIX = r"^\s*[^\n:]{1,80}:\s*"


def strip_entity_prefix(text: Column) -> Column:
    return F.regexp_replace(text, ENTITY_PREFIX, "")


# Forms that count as technical in an answer.
TECHNICAL = {
    "fenced": r"```",
    "code_span": r"`[^`\n]+`",
    "attribute": r"\[[A-Z][A-Za-z0-9]*(?:\(|\])",
    "dotted": r"\b[A-Z][A-Za-z0-9]*(?:\.[A-Z][A-Za-z0-9]*){1,}\b",
    "snake": r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+){1,}\b",
    "compound": r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*){1,}\b",
}
# Marks of an answer that refuses, and of one that warns of a weak match.
REFUSALS = ["no tengo la capacidad", "no tengo acceso", "no dispongo", "no puedo responder", "no tengo información", "no tengo informacion", "fuera del alcance", "no forma parte del corpus", "solo puedo responder", "no tiene contenido relevante", "no hay contenido relevante", "no hay nada relevante", "no tiene información relevante", "no tiene informacion relevante"]
HEDGES = ["no encontré una coincidencia clara", "no encontre una coincidencia clara", "el fragmento más cercano", "el fragmento mas cercano", "no encontré una coincidencia exacta", "no encontre una coincidencia exacta"]
# Words of too much certainty, and vague ones.
CERTAIN = ["sin duda", "siempre", "nunca", "garantiza", "asegura que", "definitivamente", "por supuesto", "obviamente"]
VAGUE = ["depende", "en general", "podría", "podria", "posiblemente", "probablemente", "suele", "normalmente", "algunos casos", "puede variar", "entre otros"]


def stance(text: Column, refusals: list[str] = REFUSALS, hedges: list[str] = HEDGES) -> Column:
    low = F.lower(text)
    has = lambda marks: reduce(lambda a, b: a | b, (low.contains(m) for m in marks))
    return F.when(has(refusals), "rechazo_pleno").when(has(hedges), "banda_baja").otherwise("directo")


def lexicon_count(text: Column, lexicon: list[str]) -> Column:
    """Occurrences of all entries, each counted without overlap."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in lexicon))


# What a plain answer may not show, and how identifiers are parted (tests hold both to golden cases).
FENCE, SPAN, IDENTIFIER, ATTRIBUTE = r"```[^\n]*\n?([\s\S]*?)```", r"`([^`\n]+)`", r"^[A-Za-z0-9_.]+$", r"\[[A-Z][A-Za-z0-9]*\([^\]\n]*\)\]"
JOINTS, HUMP = r"[._]", r"(?<=[a-z0-9])(?=[A-Z])"


def humanize(token: Column) -> Column:
    """An identifier as lower-case words."""
    return F.lower(F.regexp_replace(F.regexp_replace(token, JOINTS, " "), HUMP, " "))


def _each(text: Column, pattern: str, change, group: int = 0) -> Column:
    """Replace every match by change(its group): the parts between matches and the changed matches, woven together."""
    gaps = F.split(text, pattern, -1)
    made = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), change)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), made.alias("m")), lambda x: F.array(x["g"], F.coalesce(x["m"], F.lit(""))))), "")


def sanitize(answer: Column, code_notice: str, identifier_notice: str) -> Column:
    """An answer without code: fences and attributes give notices, identifiers become words."""
    out = _each(answer, FENCE, lambda body: F.when(F.trim(body) == "", "").otherwise(code_notice), 1)
    out = _each(out, SPAN, lambda inner: F.when(inner.rlike(IDENTIFIER), humanize(inner)).otherwise(identifier_notice), 1)
    out = F.regexp_replace(out, ATTRIBUTE, identifier_notice)
    for name in ("dotted", "snake", "compound"):
        out = _each(out, TECHNICAL[name], humanize)
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def normalised(text: Column) -> Column:
    """Lower case without accents, runs of white space as one space."""
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def locate_once(haystack: Column, needle: Column) -> Column:
    """Place (from 0, white space not counted) of the needle; null if it is absent or there more than once."""
    h, n = F.regexp_replace(haystack, r"\s+", ""), F.regexp_replace(needle, r"\s+", "")
    first = F.instr(h, n)
    again = F.instr(F.substring(h, first + 1, F.length(h)), n)
    return F.when((n != "") & (first > 0) & (again == 0), (first - 1).cast("long"))


def chunk_header(repo: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("// Repository: "), repo, F.lit("\n// File: "), path, F.lit("\n// Lines: "), start.cast("string"), F.lit("-"), end.cast("string"))


def contract_fingerprint(parts: dict[str, Column], extensions: Column) -> Column:
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()), F.concat(F.lit("ext="), F.array_join(F.array_sort(extensions), ",")))


def score_text(score: Column, percent: bool = False) -> Column:
    return F.format_string("%.1f%%", score * 100) if percent else F.format_string("%.2f", score)

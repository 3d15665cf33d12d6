"""Column expressions on text, identifiers and paths; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to language.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "jsx", "py": "python", "pyi": "python", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala",
    "php": "php", "swift": "swift",
}

#: What marks a definition, and the path classes with their factors.
DEFINITION_WORDS = ("def ", "class ", "function ", "func ", "fn ", "type ")
PATH_CLASSES = (
    (("/test/", "/tests/", "/__tests__/", "_test.", ".test.", ".spec."), 0.5),
    (("/legacy/", "/compat/", "/deprecated/"), 0.6),
    (("/examples/", "/samples/", "/demo/", "/demos/"), 0.7),
)
DECLARATION_FACTOR = 0.6

#: Words that never serve as search keywords.
STOP_WORDS = tuple(
    "a an and are as at be by do does for from how i if in is it of on or the this that to we what where with you all any can get has have into"
    " like made make many such than their them then there these they those want when which who why but not would could should use used using across"
    " against back between during more most other out over own same so some still up very was were will just now via two one single multiple actually".split()
)

#: Words that make a question one about code.
CODE_WORDS = (
    "function|class|method|component|hook|api|endpoint|route|handler|interface|type|enum|module|test|spec|config|error|exception|import|export|"
    "package|service|controller|repository|entity|schema|migration|middleware"
)


#: The edges of ASCII words; backslash-b of the JVM goes by Unicode letters.
_EDGE0, _EDGE1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


#: A part of a name: upper-case letters up to one that begins a word, else upper-case letters with what follows them.
_PART = r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}*[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{N}]+|\p{Lu}+"


def words(text: Column) -> Column:
    """Lower-case parts of identifiers and words in order, repeats kept.

    Parts end at anything but letters and digits, before an upper-case letter
    that follows another letter or digit, and before the last letter of a run
    of upper-case letters that a lower-case letter follows.
    """
    return F.transform(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), F.lower)


def dotted(text: Column) -> Column:
    """Lower-case dotted names (a.b.c), each as a whole."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]++(?:\.[A-Za-z0-9_]++)+"), F.lit(0)), F.lower)


def tokens(text: Column, keep_dotted: bool = True) -> Column:
    """Search terms of a text: dotted names first, then all parts."""
    return F.concat(dotted(text), words(text)) if keep_dotted else words(text)


def language(path: Column) -> Column:
    """Language by the last extension; null for unknown ones and for dotfiles."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.element_at(_map(LANGUAGES), F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1)))


#: What in a word or two marks an identifier.
SYMBOL_MARK = r"_|-|[a-z0-9][A-Z]|[A-Z]+[A-Z][a-z]"


def symbol_like(query: Column) -> Column:
    """Whether a query looks like an identifier."""
    text = F.trim(F.regexp_replace(query, r"\s+", " "))
    parts = F.split(text, " ")
    return (text != "") & ((F.size(parts) == 1) | (F.size(parts) < 3) & text.rlike(SYMBOL_MARK))


#: Names of types, of variables, dotted names, and words about code.
ENTITY_MARKS = (r"[A-Z][a-z]+[A-Z][a-z]", rf"{_EDGE0}[a-z]+_[a-z_]+{_EDGE1}", rf"{_EDGE0}[A-Za-z][A-Za-z0-9]*\.[A-Za-z][A-Za-z0-9]+", rf"(?i){_EDGE0}({CODE_WORDS}){_EDGE1}")


def entity_shaped(query: Column) -> Column:
    """Whether a question is likely to be about code."""
    hit = F.lit(False)
    for mark in ENTITY_MARKS:
        hit = hit | query.rlike(mark)
    return hit


def keywords(query: Column, most: int = 3) -> Column:
    """The up to ``most`` words of a query that are best to search for, best first.

    Longer words win; mixed case counts 5 more, an underscore or dot 4 more, a
    short lower-case word 2 less.  Equal scores keep their order; of spellings
    that differ by case the first in that order stays.
    """
    found = F.filter(F.split(query, r"[^A-Za-z0-9_.]+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*STOP_WORDS))
    bonus = lambda w, p, n: F.when(w.rlike(p), n).otherwise(0)
    score = lambda w: F.length(w) + F.when(w.rlike("[A-Z]") & w.rlike("[a-z]"), 5).otherwise(0) + bonus(w, "_", 4) + bonus(w, r"\.", 4) - bonus(w, "^[a-z]{1,4}$", 2)
    scored = F.transform(found, lambda w, i: F.struct((-score(w)).alias("s"), i.alias("i"), w.alias("w")))
    ranked = F.transform(F.array_sort(scored), lambda x: x["w"])
    lower = F.transform(ranked, F.lower)
    first = F.filter(ranked, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)
    return F.slice(first, 1, most)


#: Extensions of files that count as text in an evaluation, and folders never entered there.
TEXT_EXTENSIONS = tuple("ts tsx js jsx mjs cjs py pyi java kt scala go rs rb php c h cpp hpp cc cs swift md rst txt json toml yaml yml".split())
SKIPPED_FOLDERS = ("node_modules", ".git")


def is_text_file(path: Column) -> Column:
    """Whether a path has one of TEXT_EXTENSIONS and lies in none of SKIPPED_FOLDERS."""
    parts = F.split(path, "/")
    outside = ~F.exists(parts, lambda x: x.isin(*SKIPPED_FOLDERS))
    return F.coalesce(outside & F.lower(F.regexp_extract(F.element_at(parts, -1), r"^.+\.([^.]*)$", 1)).isin(*TEXT_EXTENSIONS), F.lit(False))


def path_factor(path: Column) -> Column:
    """Product of the factors of the classes that a path belongs to."""
    low = F.lower(path)
    out = F.when(low.endswith(".d.ts"), DECLARATION_FACTOR).otherwise(1.0)
    for marks, factor in PATH_CLASSES:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = out * F.when(hit, factor).otherwise(1.0)
    return out


def has_definition(content: Column) -> Column:
    low, hit = F.lower(content), F.lit(False)
    for w in DEFINITION_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def first_sentence(text: Column, least: int = 6, most: int = 200) -> Column:
    """The first sentence of a message as a query; null for markers and too short ones."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = F.regexp_extract(flat, rf"^[^.?!]{{1,{most}}}[.?!]?", 0)
    cut = F.trim(F.substring(F.when(found == "", flat).otherwise(found), 1, most))
    return F.when((flat != "") & ~flat.startswith("[") & (F.length(cut) >= least), cut)


def lines(text: Column) -> Column:
    """Lines without the empty one behind a last line feed."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def windows(text: Column, size: int = 50, overlap: int = 5) -> Column:
    """array<struct<start_line, end_line, content>> of overlapping line windows; none for blank texts."""
    if not (size >= 1 and 0 <= overlap < size):
        raise ValueError("0 <= overlap < size is needed")
    all_ = lines(text)
    n = F.size(all_)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    made = F.transform(
        starts,
        lambda s: F.struct((s + 1).alias("start_line"), F.least(s + size, n).alias("end_line"), F.array_join(F.slice(all_, s + 1, F.lit(size)), "\n").alias("content")),
    )
    return F.when(text.rlike(r"\S"), made)


def snippet(text: Column, most: int = 80) -> Column:
    """One line of at most ``most`` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def preview(text: Column, count: int = 5) -> Column:
    """The first lines of a text, indented."""
    return F.array_join(F.transform(F.slice(F.split(text, "\n", -1), 1, count), lambda x: F.concat(F.lit("    "), x)), "\n")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def wire_snippet(text: Column, most: int = 120) -> Column:
    """Line feeds as arrows, cut to ``most`` characters."""
    flat = F.regexp_replace(text, "\r?\n", "↵")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def _half_up(n: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(n + 0.5)


def _fixed(n: Column, digits: int) -> Column:
    return F.when(n.isNotNull(), F.format_string(f"%.{digits}f", n.cast("double")))


def human_count(n: Column) -> Column:
    """847, 12.4k, 1.23M; of either sign."""
    size = F.abs(n)
    return (
        F.when(size < 1000, _half_up(n).cast("bigint").cast("string"))
        .when(size < 1_000_000, F.concat(_fixed(n / 1000.0, 1), F.lit("k")))
        .otherwise(F.concat(_fixed(n / 1000000.0, 2), F.lit("M")))
    )


def token_badge(n: Column) -> Column:
    """847, 1.2k, 12k."""
    t = _half_up(n).cast("bigint")
    return F.when(t >= 10_000, F.concat(_fixed(t / 1000.0, 0), F.lit("k"))).when(t >= 1000, F.concat(_fixed(t / 1000.0, 1), F.lit("k"))).otherwise(t.cast("string"))


def duration(ms: Column) -> Column:
    """840ms, 47s, 2m 18s; empty for none and for negative ones."""
    s = _half_up(ms / 1000.0).cast("bigint")
    text = F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s")))
    text = text.otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.pmod(s, F.lit(60)).cast("string"), F.lit("s")))
    return F.when(ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0), "").otherwise(text)


def percent(share: Column) -> Column:
    """57.7%; 0% for what is no number."""
    return F.when(share.isNull() | F.isnan(share) | (F.abs(share) == float("inf")), "0%").otherwise(F.concat(_fixed(share * 100, 1), F.lit("%")))


def short_id(name: Column) -> Column:
    """The first eight characters."""
    return F.substring(name, 1, 8)


def basename(path: Column) -> Column:
    """The last segment of a path of either slash; the path itself if it has none."""
    last = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.when(last == "", path).otherwise(last)


def instruction_prefixes(model: Column) -> Column:
    """struct<query, doc>: what an embedding model wants in front of queries and documents."""
    low = F.lower(model)
    of = lambda q, d: F.struct(F.lit(q).alias("query"), F.lit(d).alias("doc"))
    return (
        F.when(low.rlike("nomic"), of("search_query: ", "search_document: "))
        .when(low.rlike("bge-(small|base|large)-en"), of("Represent this sentence for searching relevant passages: ", ""))
        .when(low.rlike("(^|[/-])e5-"), of("query: ", "passage: "))
        .otherwise(of("", ""))
    )

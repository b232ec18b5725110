"""Text and path functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages that they name.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".go": "go", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".java": "java", ".swift": "swift",
    ".sql": "sql", ".ddl": "sql",
}


def squash(s: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def truncate(s: Column, most: int) -> Column:
    """At most ``most`` characters; a cut text ends in dots if there is room for them."""
    cut = F.substring(s, 1, most) if most <= 3 else F.concat(F.substring(s, 1, most - 3), F.lit("..."))
    return F.when(F.length(s) <= most, s).otherwise(cut)


def pad(s: Column, width: int) -> Column:
    """Blanks on the right up to ``width``; a longer text stays whole."""
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, " "))


def plural(n: Column, noun: Column) -> Column:
    """The noun, in the plural unless n is 1."""
    many = (
        F.when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es")))
        .when(noun.rlike("[^aeiou]y$"), F.concat(F.expr("''"), F.regexp_replace(noun, "y$", "ies")))
        .otherwise(F.concat(noun, F.lit("s")))
    )
    return F.when(n == 1, noun).otherwise(many)


def duration(ms: Column) -> Column:
    seconds = F.floor(F.round(ms / 1000)).cast("bigint")
    return (
        F.when(ms < 1000, F.concat(F.round(ms).cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.format_string("%.1fs", ms / 1000))
        .otherwise(F.format_string("%dm %ds", F.floor(seconds / 60).cast("bigint"), seconds % 60))
    )


def count(n: Column) -> Column:
    """A number with commas between thousands."""
    return F.format_number(n, 0)


def count_phrase(n: Column, noun: str | Column) -> Column:
    """``3 files``: a number and its noun."""
    return F.concat(count(n), F.lit(" "), plural(n, F.lit(noun) if isinstance(noun, str) else noun))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def unquote(literal: Column) -> Column:
    """What a string literal holds: without a prefix of up to two letters and the quotes around it."""
    bare = F.regexp_replace(F.trim(literal), "^[rRuUbBfFlL]{0,2}(?=[\"'`])", "")
    return F.when(
        bare.rlike("(?s)^(\"\"\"|'''|`|\"|').*\\1$") & (F.length(bare) > 1), F.regexp_extract(bare, "(?s)^(\"\"\"|'''|`|\"|')(.*)\\1$", 2)
    ).otherwise(bare)


def join_route(*parts: Column) -> Column:
    """Segments of a route put together, with one slash before each."""
    segments = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def dirname(path: Column) -> Column:
    """What is before the last slash; of a path without one, nothing."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """The language that a path's extension names, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def suffixes(s: Column, separator: str) -> Column:
    """Every proper suffix at a separator, the longest first."""
    parts = F.split(s, "[" + separator + "]")
    n = F.size(parts)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), separator))
    )


def content_hash(text: Column) -> Column:
    """32 hex digits of the SHA-256 of a text without its byte order mark."""
    return F.substring(F.sha2(F.regexp_replace(text, "^﻿", ""), 256), 1, 32)


def looks_constant(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Z0-9_]*$") & (F.length(name) > 1)


def clean_doc(comment: Column) -> Column:
    """A comment's lines without the marks that make it one."""
    lines = F.transform(F.split(comment, r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:/\*+|\*+/|\*|///?!?|#+|--)\s?", ""), r"\s*\*+/\s*$", ""))
    return F.array_join(lines, "\n")


def first_paragraph(doc: Column, most: int = 200) -> Column:
    """The lines up to the first blank one or tag, squashed and cut; nothing if they hold no letter or digit."""
    para = squash(F.element_at(F.split(F.regexp_replace(doc, r"^\s+", ""), r"\n[ \t]*\n|(?:^|\n)[ \t]*[@\\\\][A-Za-z]"), 1))
    return F.when(para.rlike("[\\p{L}\\p{N}]"), truncate(para, most))


def split_qualified(name: Column) -> Column:
    """(qualifier, name) at the last dot or double colon."""
    return F.struct(
        F.regexp_extract(name, r"^(.*)(?:\.|::)[^.:]*$", 1).alias("qualifier"), F.regexp_extract(name, r"([^.:]*)$", 1).alias("name")
    )


# Fixed value: what an embedded statement that names tables has.
_STATEMENT = r"(?i)\b(select|insert\s+into|update|delete\s+from|create\s+table|join)\b"


def looks_like_sql(text: Column) -> Column:
    return (F.length(text) > 12) & text.rlike(_STATEMENT)


def bare_identifier(name: Column) -> Column:
    """A SQL name without quotes and schema, in lower case."""
    return F.lower(F.trim(F.translate(F.element_at(F.split(name, "[.]"), -1), "\"`[]", "")))


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character after ``offset`` others."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and with ``..`` resolved."""
    def fold(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(up, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array(F.lit("")).cast("array<string>"), lambda a, p: fold(F.filter(a, lambda x: x != ""), p)), "/")


def fuzzy_millis(query: str | Column, candidate: Column) -> Column:
    """How badly a lower-case candidate fits a query, in thousandths; null if it doesn't.  A column must be in lower case.

    0 if equal; then prefixes (1 and a thousandth for each character), infixes (10, the place and the
    same) and subsequences (100, the characters skipped and the same).
    """
    q, n = F.lit(query.lower()) if isinstance(query, str) else query, F.length(candidate).cast("bigint")
    at = F.call_function("locate", q, candidate)

    def step(acc: Column, c: Column) -> Column:
        place = F.when(acc["ok"], F.expr("0") + F.coalesce(_locate_from(c, candidate, acc["at"] + 1), F.lit(0))).otherwise(0)
        return F.struct(
            F.when(place > 0, place).otherwise(acc["at"]).cast("int").alias("at"),
            F.when(place > 0, acc["gaps"] + place - acc["at"] - 1).otherwise(acc["gaps"]).cast("int").alias("gaps"),
            (acc["ok"] & (place > 0)).alias("ok"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))
    letters = F.array(*[F.lit(c) for c in query.lower()]) if isinstance(query, str) else F.filter(F.split(q, ""), lambda c: c != "")
    walked = F.aggregate(letters, start, step)
    return (
        F.when(candidate == q, F.lit(0).cast("bigint"))
        .when(at == 1, 1000 + n)
        .when(at > 1, 10_000 + 1000 * (at - 1).cast("bigint") + n)
        .when(walked["ok"], 100_000 + 1000 * walked["gaps"].cast("bigint") + n)
    )


def _locate_from(needle: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", needle, text, start)


# Fixed value: the place of a table's name in an embedded statement.
_TABLE = r"(?i)\b(?:from|join|insert\s+into|update|delete\s+from)\s+([`\"\[]?[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?[`\"\]]?)"
# Words in the place of a table that aren't one.
_NO_TABLE = ("select", "where", "dual", "values", "set", "lateral", "unnest", "only", "table", "generate_series")


def tables_in_text(text: Column) -> Column:
    """Tables that an embedded statement names, each once, without schema and in lower case; of other texts none."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(_TABLE), F.lit(1)), bare_identifier)
    found = F.array_except(F.filter(F.array_distinct(bare), lambda t: F.length(t) >= 2), F.array(*[F.lit(w) for w in _NO_TABLE]))
    return F.when(looks_like_sql(text), found).otherwise(F.array().cast("array<string>"))

"""What is code in a file, where its blocks begin and end, and which definition a line is in.

Texts are cut into comments, literals and code by one alternation for each language, and everything that isn't
code becomes blanks, so that lines and columns stay where they are.  Depths are running sums over a file's
lines.  A definition ends where its block does: at the first line that closes its level, which is a brace
depth or, in Python, an indent.  Levels are keys, so a definition meets its end in a window over (path, level),
and a line its innermost definition in windows over a file: no file is folded row by row, and no two lines of
a file are compared with each other.  Files are bounded, and so are windows over one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import unquote
from ..tables import kept

_BLOCK, _SLASHES = r"/\*(?s:.*?)(?:\*/|\z)", r"//[^\n]*+"
_DOUBLE, _SINGLE, _TICKS = r'"[^"\n]*+"', r"'[^'\n]*+'", r"`[^`]*+(?:`|\z)"
_TRIPLE, _TRIPLE_SINGLE = r'"""(?s:.*?)(?:"""|\z)', r"'''(?s:.*?)(?:'''|\z)"
#: For each language, comments and literals, and the characters that may begin one.
NOISE = {
    "python": ("|".join([_TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE, r"#[^\n]*+"]), "\"'#"),
    "go": ("|".join([_TICKS, _DOUBLE, r"'[^'\n]{1,8}'", _SLASHES, _BLOCK]), "\"'`/"),
    "typescript": ("|".join([_TICKS, _DOUBLE, _SINGLE, _SLASHES, _BLOCK]), "\"'`/"),
    "java": ("|".join([_TRIPLE, _DOUBLE, r"'[^'\n]{1,8}'", _SLASHES, _BLOCK]), "\"'/"),
    "swift": ("|".join([_TRIPLE, _DOUBLE, _SLASHES, _BLOCK]), '"/'),
    "sql": ("|".join([r"'[^']*+(?:'|\z)", r"--[^\n]*+", _BLOCK, r"\$(\w*)\$(?s:.*?)(?:\$\1\$|\z)", _DOUBLE, r"`[^`\n]*+`"]), "'-/$\"`"),
}
#: Kinds whose members are methods.
TYPES = ("class", "struct", "interface", "extension")


def _pieces(text: Column, lang: Column) -> Column:
    """A text in pieces: comments, literals, runs of code, and single characters that might have begun one."""
    plain = F.regexp_replace(text, r"\\[^\n]", "__")  # an escaped quote ends nothing
    found = None
    for name, (noise, first) in NOISE.items():
        cut = F.regexp_extract_all(plain, F.lit(f"{noise}|[^{first}]++|(?s:.)"), F.lit(0))
        found = F.when(lang == name, cut) if found is None else found.when(lang == name, cut)
    return found.otherwise(F.array(plain))


def _is_comment(piece: Column, lang: Column) -> Column:
    mark = F.when(lang == "python", piece.startswith("#")).when(lang == "sql", piece.rlike(r"^(--|/\*)")).otherwise(piece.rlike(r"^(//|/\*)"))
    return (F.length(piece) > 1) & mark


def _is_literal(piece: Column, lang: Column) -> Column:
    # delimited names of SQL are code
    mark = F.when(lang == "sql", piece.rlike(r"^['$]")).otherwise(piece.rlike("^[\"'`]"))
    return (F.length(piece) > 1) & mark


def _blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", " ")


def masked(files: DataFrame) -> DataFrame:
    """path, lang, text, code (without comments and literals), said (without comments and texts of several lines) and notes (comments).

    Files that ``cut`` has been through have them already.
    """
    names = ["path", "lang", "text", "code", "said", "notes"]
    return (files if "notes" in files.columns else cut(files)).select(*names)


def cut(files: DataFrame) -> DataFrame:
    """What ``masked`` gives, and the pieces that it is made of."""
    rows = files.select("path", "lang", "text", _pieces(F.col("text"), F.col("lang")).alias("pieces"))
    lang = F.col("lang")
    code = F.transform("pieces", lambda p: F.when(_is_comment(p, lang) | _is_literal(p, lang), _blank(p)).otherwise(p))
    said = F.transform("pieces", lambda p: F.when(_is_comment(p, lang) | (_is_literal(p, lang) & F.contains(p, F.lit("\n"))), _blank(p)).otherwise(p))
    notes = F.transform("pieces", lambda p: F.when(_is_comment(p, lang), p).otherwise(_blank(p)))
    return rows.select("path", "lang", "text", "pieces", F.array_join(code, "").alias("code"), F.array_join(said, "").alias("said"), F.array_join(notes, "").alias("notes"))


def literals(files: DataFrame) -> DataFrame:
    """path, lang, line and text of each literal, unquoted; neighbours, also with a plus between them, are one."""
    lang = F.col("lang")
    pieces = F.col("pieces") if "pieces" in files.columns else _pieces(F.col("text"), lang)
    cut = files.select("path", "lang", "text", F.posexplode(pieces).alias("k", "piece"))
    size = cut.withColumns({"chars": F.length("piece"), "breaks": F.length(F.regexp_replace("piece", r"[^\n]", ""))})
    order = Window.partitionBy("path").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_text, glue = _is_literal(F.col("piece"), lang), F.col("piece").rlike(r"^\s*[+\\]?\s*[rRuUbBfF]{0,2}$")
    placed = size.select(
        "path", "lang", "k", "piece",
        (F.coalesce(F.sum("breaks").over(before), F.lit(0)) + 1).alias("line"),
        F.substring("text", F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("int") + 1, F.col("chars")).alias("raw"),
        is_text.alias("is_text"),
        F.sum(F.when(is_text | glue | _is_comment(F.col("piece"), lang), 0).otherwise(1)).over(order).alias("island"),
    )
    said = placed.filter("is_text").groupBy("path", "lang", "island").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("k", unquote(F.col("raw")).alias("t")))).alias("parts"))
    return said.select("path", "lang", "line", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def measured(files: DataFrame) -> DataFrame:
    """The lines that have code: path, lang, line, code, said, level, closes and what follows them.

    ``level`` is the depth of braces before the line, in Python its indent; ``closes`` are the levels that the
    line closes; ``inside`` is whether it goes on with an open parenthesis.
    """
    split = lambda c: F.split(c, r"\r?\n")
    rows = masked(files).select("path", "lang", F.posexplode(F.arrays_zip(split("code").alias("code"), split("said").alias("said"))).alias("k", "l"))
    rows = rows.select("path", "lang", (F.col("k") + 1).alias("line"), F.col("l.code").alias("code"), F.col("l.said").alias("said")).filter("trim(said) <> ''")
    braces = F.split(F.regexp_replace("code", "[^{}]", ""), "")
    moves = F.transform(F.filter(braces, lambda b: b != ""), lambda b: F.when(b == "{", 1).otherwise(-1))
    walk = F.aggregate(moves, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, m: F.struct((a["at"] + m).alias("at"), F.least(a["low"], a["at"] + m).alias("low")))
    rows = rows.withColumn("walk", F.when(F.col("code").rlike("[{}]"), walk).otherwise(F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))))
    python = F.col("lang") == "python"
    round_ = _count(F.col("code"), r"(\[") - _count(F.col("code"), r")\]") + F.when(python, F.col("walk.at")).otherwise(0)
    order = Window.partitionBy("path").orderBy("line")
    # what is ahead is what was passed from the other end: a frame that only grows, so a file costs its lines once
    before, ahead = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({"round": round_, "indent": F.length(F.regexp_replace(F.regexp_extract("code", r"^([ \t]*)", 1), "\t", " " * 8))})
    sums = sums.withColumns(
        {
            "depth": F.coalesce(F.sum("walk.at").over(before), F.lit(0)).cast("int"),
            "inside": F.coalesce(F.sum("round").over(before), F.lit(0)) > 0,
            "flat": F.sum("round").over(order) <= 0,
            "next": F.lead("code").over(order),
            "last_line": F.lag("line").over(order),
        }
    )
    # where the statement that begins in a line has its last line, and the depth after that
    head = F.last(F.when(F.col("flat"), F.struct("line", "code", "next", (F.col("depth") + F.col("walk.at")).alias("after"))), True).over(ahead)
    outer = Window.partitionBy("path", "inside").orderBy("line")
    sums = sums.withColumns({"head": head, "level": F.when(python, F.col("indent")).otherwise(F.col("depth")), "above": F.lag("indent").over(outer)})
    dedent = F.when(~F.col("inside") & (F.col("indent") <= F.col("above")), F.sequence("indent", "above"))
    shut = F.when(F.col("walk.low") < 0, F.sequence(F.greatest(F.lit(0), F.col("depth") + F.col("walk.low")), F.col("depth") - 1))
    return sums.select("path", "lang", "line", "code", "said", "level", "inside", "head", "last_line", F.when(python, dedent).otherwise(shut).alias("closes"))


_BODY = r"^\s*(\{|throws\b|extends\b|implements\b|where\b)"


def spans(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """Definitions (path, line and more, of ``lines``) with ``line_end``, the last line of their block."""
    ends = lines.filter("closes IS NOT NULL").select("path", F.explode("closes").alias("level"), F.col("line").alias("at"), F.when(F.col("lang") == "python", F.col("last_line")).otherwise(F.col("line")).alias("end"))
    last = lines.groupBy("path").agg(F.max("line").alias("last"))
    python = F.col("lang") == "python"
    braced = F.contains("code", F.lit("{")) | F.contains("head.code", F.lit("{"))
    has_body = python | braced | F.coalesce(F.col("head.next").rlike(_BODY), F.lit(False))
    closed = ~python & braced & (F.col("head.after") <= F.col("level"))
    known = defs.withColumns({"at": F.coalesce(F.when(~python, F.col("head.line")), F.col("line")), "open": has_body & ~closed, "is_def": F.lit(True)})
    both = known.unionByName(ends.withColumn("is_def", F.lit(False)), allowMissingColumns=True)
    # of a line, what closes there comes before what begins; from the file's end each row passes once
    order = Window.partitionBy("path", "level").orderBy(F.desc("at"), F.desc("is_def")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("shut", F.last("end", True).over(order)).filter("is_def")
    end = F.when(F.col("open"), F.coalesce("shut", "last", "at")).otherwise(F.col("at"))
    return met.join(last, "path", "left").withColumn("line_end", F.greatest("line", end)).drop("at", "end", "open", "is_def", "shut", "last")


MAX_NEST = 64


def within(rows: DataFrame, spans_: DataFrame, carry: list[str]) -> DataFrame:
    """Rows (path, line, ...) with ``around``: the definitions that hold their line, outermost first, as structs of ``carry``.

    Spans that begin on a row's line hold it; rows may be definitions themselves, if they have ``starts``, and are
    then not held by what begins on their line.  How many spans are open is a running sum, and the innermost is the
    last one that began at that depth.
    """
    one = F.struct(*carry)
    spans_ = spans_.select("path", F.col("line"), "line_end", one.alias("one"))
    begin = spans_.select("path", "line", F.lit(1).alias("turn"), F.lit(1).alias("step"), "one")
    end = spans_.select("path", F.col("line_end").alias("line"), F.lit(3).alias("turn"), F.lit(-1).alias("step"))
    names = rows.columns
    starts = F.col("starts") if "starts" in names else F.lit(False)
    asks = rows.select("path", "line", F.when(starts, 0).otherwise(2).alias("turn"), F.lit(0).alias("step"), F.struct(*names).alias("row"))
    events = begin.unionByName(end, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    order = Window.partitionBy("path").orderBy("line", "turn")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = kept(events.withColumn("nest", F.sum("step").over(running).cast("int")), "nesting")
    deepest = min(MAX_NEST, events.agg(F.coalesce(F.max("nest"), F.lit(0))).first()[0])
    last = [F.last(F.when((F.col("turn") == 1) & (F.col("nest") == k), F.col("one")), True).over(running) for k in range(1, deepest + 1)]
    around = F.slice(F.array(*last), F.lit(1), F.greatest("nest", F.lit(0))) if last else F.array().cast(f"array<{spans_.schema['one'].dataType.simpleString()}>")
    return events.withColumn("around", around).filter("row IS NOT NULL").select("row.*", "around")

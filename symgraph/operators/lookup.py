"""Symbol lookup: a ladder of ever looser matches, for many names at once; and fuzzy search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_millis
from ..schemas import KIND_ORDER, rank_in
from ..tables import kept
from .rank import first_per_group

#: Keys that are broadcast at most.
FEW = 100_000
RUNGS = ("id", "in_file", "qualified", "name", "dotted", "last_segment", "any_case")
#: A file's name with its extension, a colon and a symbol.
_PAIR = r"^(.+\.[a-zA-Z]+):([A-Za-z_][\w.]*)$"


def _if_few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def ladder(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, rung, id): the symbols of the first rung that has any, for each q of ``names``.

    Rungs: an id, which has three colons at least; a symbol of a file, as file:name; a qualified name; a
    name; a name behind a module, with as few leading parts peeled off as fit, whose file's module has them
    (``module`` of ``nodes``, the path where there is none); the last segment; a name in any case.  All are
    equality joins on a key that is worked out from q.  Which rung has any is found among the different keys of
    the nodes, so a name that many nodes share and many of ``names`` end in meets the nodes of its first rung only.
    """
    q = names.select(F.trim("q").alias("q")).filter("q <> ''").distinct()
    parts = F.split("q", "[.]")
    n = F.size(parts)
    rung = lambda k, key, pos=None, head=None: F.struct(
        F.lit(k).alias("rung"), (F.lit(0) if pos is None else pos).alias("pos"), (F.lit("") if head is None else head).alias("head"), key.alias("key")
    )
    peeled = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: rung(4, F.array_join(F.slice(parts, i + 1, n), "."), i, F.array_join(F.slice(parts, F.lit(1), i), ".")),
    )
    plain = F.array_compact(
        F.array(
            F.when(F.size(F.split("q", ":")) >= 4, rung(0, F.col("q"))),
            F.when(F.col("q").rlike(_PAIR), rung(1, F.concat(F.regexp_extract("q", _PAIR, 1), F.lit("\n"), F.regexp_extract("q", _PAIR, 2)))),
            rung(2, F.col("q")),
            rung(3, F.col("q")),
            F.when(n > 1, rung(5, F.element_at(parts, -1))),
            rung(6, F.lower("q")),
        )
    )
    keys = F.when(n > 1, F.concat(plain, peeled)).otherwise(plain)
    tried = kept(q.select("q", F.explode(keys).alias("k")).select("q", "k.*"), "lookup-keys")
    used = sorted(r["rung"] for r in tried.select("rung").distinct().collect())  # seven at most
    if "module" not in nodes.columns:
        nodes = nodes.withColumn("module", F.col("path"))
    fact = lambda k, key: F.struct(F.lit(k).alias("rung"), key.alias("key"))
    in_file = lambda name: F.concat("path", F.lit("\n"), name)
    facts = F.array_distinct(
        F.array(
            fact(0, F.col("id")), fact(1, in_file("name")), fact(1, in_file("qualified")), fact(2, F.col("qualified")), fact(3, F.col("name")),
            fact(4, F.col("qualified")), fact(4, F.col("name")), fact(5, F.col("name")), fact(6, F.lower("name")),
        )
    )
    known = nodes.select("id", "module", F.explode(F.filter(facts, lambda f: f["rung"].isin(used))).alias("f")).select("id", "module", "f.rung", "f.key")
    fits = (F.col("rung") != 4) | F.contains("module", "head")
    # few keys go to the nodes; else the nodes' facts are shuffled with them
    wanted = _if_few(tried.select("rung", "key").distinct())
    keys = known.select("rung", "key", F.when(F.col("rung") == 4, F.col("module")).alias("module")).join(wanted, ["rung", "key"], "left_semi").distinct()
    least = keys.join(_if_few(tried), ["rung", "key"]).filter(fits).groupBy("q").agg(F.min(F.struct("rung", "pos")).alias("first"))
    first = tried.join(least, "q").filter((F.col("rung") == F.col("first.rung")) & (F.col("pos") == F.col("first.pos")))
    first = kept(first.select("q", "rung", "head", "key"), "lookup-first")
    found = known.join(_if_few(first), ["rung", "key"]).filter(fits)
    return found.select("q", F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.col("rung") + 1).alias("rung"), "id").distinct()


def fuzzy(nodes: DataFrame, query: str, limit: int = 12, kind: str | None = None, lang: str | None = None) -> DataFrame:
    """The best fuzzy hits of one name (a top-k report)."""
    return search(nodes, query, kind, lang).orderBy("score_milli", "path", "line_start", "id").limit(limit)


def _pairs(names: DataFrame) -> DataFrame:
    """(low, pair): each pair of characters that stand in this order in a name, each once, and each character by itself."""
    place = lambda c, start: F.call_function("locate", F.col(c), F.col("low"), start)
    # the first place of a character, and the first places of others behind it
    heads = names.select("low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i")).withColumn("c", F.substring("low", F.col("i"), F.lit(1))).filter(place("c", F.lit(1)) == F.col("i"))
    after = heads.select("low", "i", "c", F.explode(F.sequence(F.col("i"), F.length("low"))).alias("j")).withColumn("d", F.substring("low", F.col("j"), F.lit(1)))
    after = after.filter((F.col("j") == F.col("i")) | (place("d", F.col("i") + 1) == F.col("j")))
    return after.select("low", F.when(F.col("j") == F.col("i"), F.col("c")).otherwise(F.concat("c", "d")).alias("pair"))


#: Characters of a name that are indexed; a longer one is looked at for every query whose letters it has.
INDEXED = 64
#: Names with a pair of characters that a query is compared with one by one; of more, its best ones are sought.
DIRECT = 100


def fuzzy_batch(names: DataFrame, nodes: DataFrame, limit: int = 12, direct: int = DIRECT) -> DataFrame:
    """(q, rank, id, score_milli): the best ``limit`` fuzzy hits of each q of ``names``, in the order of ``fuzzy``.

    A name that fits has each two neighbouring characters of q in this order.  So names are indexed by their
    ordered pairs of characters, the pairs are counted, and a q meets the names of its rarest pair only; these are
    scored, and the best nodes of each name then stand for it.  If more than ``direct`` names have that pair, the
    names that hold q are found by their parts, and others by their beginnings (``_nearest``).  No q meets all names.
    """
    low = F.lower("name")
    weight = 10 * rank_in(KIND_ORDER, "kind") + F.when(F.col("exported"), 0).otherwise(500)
    own = nodes.withColumn("low", low).withColumn("weight", weight.cast("bigint")).select("low", "weight", "path", "line_start", "id")
    best = kept(first_per_group(own, ["low"], ["weight", "path", "line_start", "id"], limit).drop("rank", "in_group"), "fuzzy-nodes")
    each = kept(best.groupBy("low").agg(F.count("*").alias("n")), "fuzzy-names")

    asked = names.select(F.trim("q").alias("q")).filter("q <> ''").distinct().withColumn("want", F.lower("q"))
    letters = F.filter(F.split("want", ""), lambda c: c != "")
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters) - 1, F.lit(1))), lambda i: F.concat(F.element_at(letters, i), F.coalesce(F.try_element_at(letters, i + 1), F.lit(""))))
    wanted = kept(asked.select("q", "want", F.explode(F.array_distinct(two)).alias("pair")), "fuzzy-asked")
    useful = wanted.select("pair").union(wanted.select(F.lit(""))).distinct()
    # names are short and their pairs many, so names are dealt to as many tasks as shuffles have
    dealt = each.repartition(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), "low")
    listed = _pairs(dealt.filter(F.length("low").between(1, INDEXED))).unionByName(dealt.filter(F.length("low") > INDEXED).select("low", F.lit("").alias("pair")))
    index = kept(listed.join(_if_few(useful), "pair", "left_semi"), "fuzzy-index")
    counts = index.groupBy("pair").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "pair", "left").groupBy("q", "want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair")).alias("least"))
    rarest = kept(rarest.select("q", "want", "least.pair", "least.n"), "fuzzy-pairs")
    long_ = rarest.select("q", "want", F.lit("").alias("pair"))  # names that are too long for the index
    chosen = rarest.filter(F.col("n") <= direct).select("q", "want", "pair").unionByName(long_)
    met = kept(chosen.join(index.join(_if_few(chosen.select("pair").distinct()), "pair", "left_semi"), "pair").select("q", "want", "low"), "fuzzy-met", "q", "low")
    hits = met.withColumn("base", fuzzy_millis(F.col("want"), F.col("low"))).filter("base IS NOT NULL").join(best, "low")
    hits = hits.select("q", "base", "weight", "path", "line_start", "id")
    common = rarest.filter(F.col("n") > direct).select("q", "want")
    if not common.isEmpty():
        short = each.filter(F.length("low").between(1, INDEXED))
        hits = hits.unionByName(_holding(common, short, best)).unionByName(_nearest(common, short, best, limit))
    ranked = first_per_group(hits.withColumn("score_milli", F.col("base") + F.col("weight")), ["q"], ["score_milli", "path", "line_start", "id"], limit)
    return ranked.select("q", "rank", "id", "score_milli")


def _holding(common: DataFrame, each: DataFrame, best: DataFrame) -> DataFrame:
    """The nodes whose name holds a query as it is: parts of names that begin as a query does, of the lengths that those have."""
    heads = common.select(F.left("want", F.lit(2)).alias("head"), F.length("want").alias("m")).distinct()
    places = each.select("low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("at"))
    tried = places.select("low", "at", F.explode(F.array(F.substring("low", F.col("at"), F.lit(1)), F.substring("low", F.col("at"), F.lit(2)))).alias("head"))
    parts = tried.join(_if_few(heads), "head").select("low", F.substring("low", F.col("at"), F.col("m")).alias("want"))
    found = parts.join(common, "want").select("q", "want", "low").distinct()
    scored = found.withColumn("base", fuzzy_millis(F.col("want"), F.col("low")))
    return scored.join(best, "low").select("q", "base", "weight", "path", "line_start", "id")


def _nearest(common: DataFrame, each: DataFrame, best: DataFrame, limit: int) -> DataFrame:
    """The best nodes whose name has the letters of a query in order, but doesn't hold it, ``limit`` of each beginning that has them.

    Names are a tree of beginnings.  Round by round a query passes over one more character, follows its own letters
    from there as far as they go, and is at its end with all names that begin so; the names of a round
    fit worse than those of all rounds before, as no name's length and weight outweigh a character.  A query
    stops after the round that gives it ``limit`` nodes, and leaves beginnings whose names are too short for the
    rest of it.  Names that hold it, which fit better than these, count as nodes too.
    """
    length = F.length("want")
    starts = each.select("low", "n", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("k")).withColumn("node", F.substring("low", F.lit(1), F.col("k")))
    tree = starts.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.length("low")).alias("deep"))
    last = F.length("node")
    tree = kept(tree.select(F.col("node").alias("to"), F.substring("node", F.lit(1), last - 1).alias("node"), F.substring("node", last, F.lit(1)).alias("letter"), "n", "deep"), "fuzzy-tree")
    ends_at, steps = tree.select(F.col("to").alias("node"), "n"), tree.select("node", "to", "letter", "deep")

    front, got = kept(common.select("q", "want", F.lit("").alias("node"), F.lit(0).alias("at")), "fuzzy-front"), None
    for gap in range(INDEXED):
        run = front.select("q", "want", "node", "at", F.explode(F.sequence(F.lit(0), length - F.col("at"))).alias("r"))
        run = run.select("q", "want", F.concat("node", F.substring("want", F.col("at") + 1, F.col("r"))).alias("node"), (F.col("at") + F.col("r")).alias("at"))
        ended = kept(run.filter(F.col("at") == length).join(ends_at, "node").select("q", "want", "node", "n", F.lit(gap).alias("gap")), "fuzzy-ends")
        got = ended if got is None else got.unionByName(ended)
        done = got.groupBy("q").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).select("q")
        moved = run.filter(F.col("at") < length).join(done, "q", "left_anti").join(steps, "node")
        moved = moved.filter((F.col("letter") != F.substring("want", F.col("at") + 1, F.lit(1))) & (F.col("deep") - F.length("to") >= length - F.col("at")))
        front = kept(moved.select("q", "want", F.col("to").alias("node"), "at"), "fuzzy-front")
        if front.isEmpty():
            break
    got = kept(got, "fuzzy-got")
    under = starts.select("low", "node").join(got.select("node").distinct(), "node", "left_semi").join(best, "low").withColumn("order", F.length("low") + F.col("weight"))
    tops = first_per_group(under, ["node"], ["order", "path", "line_start", "id"], limit)
    found = got.select("q", "want", "node", "gap").join(tops, "node").filter(~F.contains("low", "want"))
    base = 100_000 + 1000 * F.col("gap").cast("bigint") + F.length("low")
    return found.select("q", base.alias("base"), "weight", "path", "line_start", "id")


def answers(names: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(q, rung, id): the symbols of the first rung that has any; of a q that no rung knows, those most like it."""
    found = kept(ladder(names, nodes), "lookup-found")
    unknown = names.select(F.trim("q").alias("q")).distinct().join(found, "q", "left_anti")
    return found.unionByName(fuzzy_batch(unknown, nodes, limit).select("q", F.lit("fuzzy").alias("rung"), "id"))


def suggestions(nodes: DataFrame, query: str) -> DataFrame:
    """Five names like the last segment of one that wasn't found."""
    last = re.split(r"[.:/]", query.rstrip(".:/"))[-1]
    return fuzzy(nodes, last, 5)


def search(nodes: DataFrame, query: str, kind: str | None = None, lang: str | None = None) -> DataFrame:
    """Symbols whose name fits, with their score in thousandths; filters come before any limit."""
    if kind:
        nodes = nodes.filter(F.col("kind") == kind)
    if lang:
        nodes = nodes.filter(F.col("lang") == lang)
    pattern = "%" + "%".join(c.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for c in query.lower()) + "%"
    near = nodes.filter(F.lower("name").like(pattern))
    score = fuzzy_millis(query, F.lower("name")) + 10 * rank_in(KIND_ORDER, "kind") + F.when(F.col("exported"), 0).otherwise(500)
    return near.withColumn("score_milli", score.cast("bigint"))

"""Keyed catalogs: conference index, prefix dictionary, four-source journal merge.

Entries have catalog ('ccf' or 'core'), ord (row order in the source), abbr, name and rank; an
entry is identified by (catalog, ord). Every precedence rule is an argmin over an explicit order
column, never the accident of row order, so the result is the same after any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored

MIN_INDEX_KEY, MIN_PREFIX, MIN_FUZZY_TOKENS = 4, 14, 4


@dataclass
class ConferenceIndex:
    """keys: catalog, key, ord. abbrs: catalog, abbr, ord. tokens: catalog, ord, tokens (sets of at least four words)."""

    entries: DataFrame
    keys: DataFrame
    abbrs: DataFrame
    tokens: DataFrame
    missing: DataFrame


def _targets(entries: DataFrame, aliases: DataFrame, kind: str) -> DataFrame:
    """Aliases of a kind for each catalog, with the entry each resolves to: alias_ord, src, catalog, ord (null if dangling).

    For the core catalog the target is first translated by the ccf_to_core aliases (exact case).
    Of several entries with one abbreviation the one whose name holds most of the alias's words
    wins, the earlier one on a tie; an acronym has no words to compare, so the first wins.
    """
    mine = aliases.where(F.col("kind") == kind)
    if kind == "core_names":
        wanted = mine.select("ord", "src", "target", F.lit("core").alias("catalog"), F.col("target").alias("abbr"))
    else:
        moved = aliases.where("kind = 'ccf_to_core'").select(F.col("src").alias("target"), F.col("target").alias("moved"))
        core = mine.join(moved, "target", "left").select("ord", "src", "target", F.lit("core").alias("catalog"), F.coalesce("moved", "target").alias("abbr"))
        wanted = mine.select("ord", "src", "target", F.lit("ccf").alias("catalog"), F.col("target").alias("abbr")).union(core)
    wanted = wanted.select(F.col("ord").alias("alias_ord"), "src", "target", "catalog", F.upper("abbr").alias("abbr"), F.expr(T.tokens_of("src")).alias("hint"))
    named = entries.where("coalesce(abbr, '') <> ''").select("catalog", F.upper("abbr").alias("abbr"), "ord", F.expr(T.tokens_of("name")).alias("own"))
    score = F.lit(0.0) if kind != "names" else F.coalesce(F.expr(T.containment("hint", "own")), F.lit(-1.0))
    return wanted.join(named, ["catalog", "abbr"], "left").groupBy("catalog", "alias_ord", "src", "target").agg(F.min_by("ord", F.struct((-score).alias("s"), "ord")).alias("ord"))


def conference_index(entries: DataFrame, aliases: DataFrame) -> ConferenceIndex:
    """Index of both catalogs. aliases: kind, ord, src, target."""
    bare = F.expr(T.drop_parenthesis("name"))
    spellings = F.array(F.col("name"), F.when(bare != F.col("name"), bare), F.col("abbr"))
    own = entries.select("catalog", "ord", F.posexplode(spellings).alias("step", "spelling")).select("catalog", "ord", "step", F.expr(T.normalize_name("spelling")).alias("key"))
    own = own.where(F.length("key") >= MIN_INDEX_KEY).select("catalog", "key", "ord", F.struct(F.lit(2).alias("prio"), F.col("ord").alias("a"), F.col("step").alias("b")).alias("rank"))
    found = {k: _targets(entries, aliases, k) for k in ("names", "acronyms", "core_names")}

    def alias_keys(kind: str, prio: int) -> DataFrame:
        # later aliases overwrite earlier ones and the catalog's own keys
        rank = F.struct(F.lit(prio).alias("prio"), (-F.col("alias_ord")).alias("a"), F.lit(0).alias("b")).alias("rank")
        return found[kind].where("ord is not null").select("catalog", F.expr(T.normalize_name("src")).alias("key"), "ord", rank).where("key <> ''")

    keys = own.union(alias_keys("names", 1)).union(alias_keys("core_names", 0)).groupBy("catalog", "key").agg(F.min_by("ord", "rank").alias("ord"))
    short = entries.where("coalesce(abbr, '') <> ''").groupBy("catalog", F.upper("abbr").alias("abbr")).agg(F.min("ord").alias("ord"))
    extra = found["acronyms"].where("ord is not null").groupBy("catalog", F.upper("src").alias("abbr")).agg(F.min_by("ord", "alias_ord").alias("ord"))
    abbrs = short.union(extra.join(short, ["catalog", "abbr"], "left_anti"))
    words = F.expr(T.tokens_of("name"))
    tokens = entries.select("catalog", "ord", words.alias("words")).where(F.size("words") >= MIN_FUZZY_TOKENS).select("catalog", "ord", F.array_distinct("words").alias("tokens"))
    shown = lambda k: found[k].where("ord is null" + (" and catalog = 'ccf'" if k != "core_names" else "")).select(F.lit(k).alias("kind"), "alias_ord", "src", "target")
    return ConferenceIndex(entries, keys, abbrs, tokens, shown("names").union(shown("acronyms")).union(shown("core_names")))


def stored_index(ix: ConferenceIndex) -> ConferenceIndex:
    """The same index, its tables built once."""
    return ConferenceIndex(stored(ix.entries, "entries"), stored(ix.keys, "keys"), stored(ix.abbrs, "abbrs"), stored(ix.tokens, "tokens"), ix.missing)


def prefix_dictionary(keys: DataFrame, least: int = MIN_PREFIX) -> DataFrame:
    """catalog, key, ord -> catalog, prefix, ord: strict prefixes of at least `least` characters that lead to one entry only.

    Turns the prefix search, a theta join, into an equi join; several keys of one entry are one.
    """
    long = keys.where(F.length("key") > least)
    pieces = long.select("catalog", "ord", F.expr(f"explode(transform(sequence({least}, length(key) - 1), n -> left(key, n)))").alias("prefix"))
    return pieces.groupBy("catalog", "prefix").agg(F.min("ord").alias("ord"), F.max("ord").alias("last")).where("ord = last").drop("last")


def merge_journals(cas: DataFrame, jcr: DataFrame, warn: DataFrame, ei: DataFrame) -> DataFrame:
    """Four sources to one row a key; one shuffle of the union in place of three full outer joins.

    cas: ord, name, issns, wos, cat, zone, top, sub, sub_zone. jcr: ord, name, impact, quartile,
    wos, issn, eissn. warn: ord, name, reason. ei: ord, name. cas fields: the last non-empty
    value; jcr: impact and quartile the last valid one, wos, issn and eissn only where cas has
    none, the first; warn the last; the name the last of cas, else the first creator's.
    """
    clean = lambda c: F.nullif(F.expr(T.clean_issn(c)), F.lit(""))
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    zone = lambda c: F.nullif(F.expr(T.zone_of(c)), F.lit(0))
    sub, sub_zone = F.nullif(F.expr(T.chinese_tail("sub")), F.lit("")), zone("sub_zone")
    both = sub.isNotNull() & sub_zone.isNotNull()
    a = cas.select(
        F.lit(0).alias("src"), "ord", "name", clean("get(split(coalesce(issns, ''), '/'), 0)").alias("issn"), clean("get(split(coalesce(issns, ''), '/'), 1)").alias("eissn"), filled("wos").alias("wos"),
        filled("cat").alias("cat"), zone("zone").alias("zone"), F.when(F.trim("top") == "是", F.lit(1)).alias("top"), F.when(both, sub).alias("sub"), F.when(both, sub_zone).alias("sub_zone"),
    )
    b = jcr.select(F.lit(1).alias("src"), "ord", "name", F.expr(T.leading_number("impact")).alias("impact"), F.when(F.trim("quartile").rlike(r"^Q[1-4]\z"), F.trim("quartile")).alias("quartile"), filled("wos").alias("wos"), clean("issn").alias("issn"), clean("eissn").alias("eissn"))
    c = warn.select(F.lit(2).alias("src"), "ord", "name", F.coalesce(filled("reason"), F.lit("预警")).alias("warn"))
    d = ei.select(F.lit(3).alias("src"), "ord", "name", F.lit(1).alias("ei"))
    rows = a
    for more in (b, c, d):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumn("key", F.expr(T.normalize_name("name"))).where("key <> ''").withColumn("at", F.struct("src", "ord"))
    last = lambda col, src: F.max_by(F.when(F.col("src") == src, F.col(col)), F.when((F.col("src") == src) & F.col(col).isNotNull(), F.col("at")))
    first = lambda col, src: F.min_by(F.when(F.col("src") == src, F.col(col)), F.when((F.col("src") == src) & F.col(col).isNotNull(), F.col("at")))
    sub_at = F.when(F.col("sub").isNotNull(), F.col("at"))
    return rows.groupBy("key").agg(
        F.coalesce(last("name", 0), F.min_by("name", "at")).alias("n"), F.coalesce(last("issn", 0), first("issn", 1)).alias("issn"), F.coalesce(last("eissn", 0), first("eissn", 1)).alias("eissn"),
        F.coalesce(last("wos", 0), first("wos", 1)).alias("wos"), last("cat", 0).alias("cat"), last("zone", 0).alias("zone"), F.max("top").alias("top"), F.max_by("sub", sub_at).alias("sub"),
        F.max_by("sub_zone", sub_at).alias("sub_zone"), last("impact", 1).alias("impact"), last("quartile", 1).alias("quartile"), last("warn", 2).alias("warn"), F.max("ei").alias("ei"),
    )


def source_counts(**sources: DataFrame) -> DataFrame:
    """source, n: rows of each source whose name has a key, duplicates counted."""
    out = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), F.expr(T.normalize_name("name")).alias("key")).where("key <> ''").select("source")
        out = one if out is None else out.union(one)
    return out.groupBy("source").agg(F.count("*").alias("n"))


def journal_counts(journals: DataFrame) -> DataFrame:
    """n, n_zone, n_impact, n_ei."""
    return journals.agg(F.count("*").alias("n"), F.count("zone").alias("n_zone"), F.count("impact").alias("n_impact"), F.count("ei").alias("n_ei"))


def rank_counts(entries: DataFrame, *by: str) -> DataFrame:
    """Entries by the given columns, the most frequent first (ties by value)."""
    return entries.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)

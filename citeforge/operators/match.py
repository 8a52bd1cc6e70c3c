"""Tiered matching of venue strings against the catalogs.

Tiers: exact key, acronym, unique prefix (truncated strings only), token containment. Within a
catalog the lowest tier wins, then the higher score, the earlier candidate, the earlier entry: one
argmin over a struct. The expensive tier only sees what the cheaper ones left. All joins are equi
joins; distinct strings are matched once and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import text as T
from ..sources.tables import stored
from .catalog import ConferenceIndex, prefix_dictionary, stored_index

#: How a tier is named in results.
VIA = {1: "全称精确匹配", 2: "简称 ", 3: "截断前缀匹配", 4: "全称模糊匹配"}


@dataclass
class Options:
    min_key: int = 5
    min_prefix: int = 14
    fuzzy: bool = True
    fuzzy_names: int = 6
    fuzzy_tokens: int = 4
    fuzzy_score: float = 0.85


@dataclass
class Catalogs:
    """index of the conferences, journals (key, n and their fields), tags (ord, id, label, descr, cls, ccf, core, names), prefixes (of all keys; built on demand if absent)."""

    index: ConferenceIndex
    journals: DataFrame
    tags: DataFrame
    options: Options = field(default_factory=Options)
    prefixes: DataFrame | None = None

    def all_keys(self) -> DataFrame:
        """catalog, key, ref of both kinds."""
        conf = self.index.keys.select("catalog", "key", F.col("ord").cast("string").alias("ref"))
        return conf.union(self.journals.select(F.lit("journal").alias("catalog"), "key", F.col("key").alias("ref")))

    def ready(self) -> Catalogs:
        """The same catalogs, every table of theirs built and stored once; for many lookups."""
        journals = stored(self.journals, "journals")
        whole = Catalogs(stored_index(self.index), journals, stored(self.tags, "tags"), self.options)
        whole.prefixes = stored(whole.prefix_table(), "prefixes")
        return whole

    def prefix_table(self) -> DataFrame:
        return prefix_dictionary(self.all_keys().select("catalog", "key", F.col("ref").alias("ord")), self.options.min_prefix)


def candidates(raws: DataFrame) -> DataFrame:
    """raw -> raw, kind, truncated, preprint_name, names, acronyms; distinct strings only."""
    return raws.select("raw").distinct().select("raw", F.expr(C.venue_candidates("raw")).alias("c")).select("raw", "c.*")


def candidate_keys(cand: DataFrame) -> DataFrame:
    """raw, truncated, pos, name, key of every name."""
    return cand.where("kind = 'normal'").select("raw", "truncated", F.posexplode("names").alias("pos", "name")).withColumn("key", F.expr(T.normalize_name("name")))


def containment_pairs(left: DataFrame, right: DataFrame, least: float, shared: int) -> DataFrame:
    """Pairs of token sets with containment of at least `least`, left sets of at least `shared` words.

    left: l, tokens. right: r, tokens. A pair shares `least` of its smaller set's words, so any but
    so few of them; of the smaller set only that many words and one more, its rarest, are filed, and meet all words
    of larger sets: words that every name has ('international', 'conference') hardly take part. The pairs that
    meet are verified on the whole sets. -> l, r, score
    """
    sides = {n: stored(df.select(n, F.array_distinct("tokens").alias("tokens")).withColumn("size", F.size("tokens")).where(F.col("size") >= (shared if n == "l" else 1)), f"sets-{n}") for n, df in (("l", left), ("r", right))}
    words = {n: df.select(n, "size", F.explode("tokens").alias("token")) for n, df in sides.items()}
    counts = stored(words["l"].select("token").union(words["r"].select("token")).groupBy("token").agg(F.count("*").alias("n")), "token-counts")

    def rarest(n: str) -> DataFrame:
        ranked = words[n].join(counts, "token").groupBy(n, "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ws"))
        filed = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
        return ranked.select(n, "size", F.explode(F.slice("ws", F.lit(1), filed)).alias("w")).select(n, F.col("size").alias("small"), F.col("w.token").alias("token"))

    first = rarest("l").join(words["r"], "token").where("small <= size").select("l", "r")
    met = first.union(rarest("r").join(words["l"], "token").where("small < size").select("l", "r")).distinct()
    whole = {n: df.select(n, F.col("tokens").alias(f"{n}t")) for n, df in sides.items()}
    both = met.join(whole["l"], "l").join(whole["r"], "r")
    return both.withColumn("score", F.expr(T.containment("lt", "rt"))).where(F.col("score") >= least).select("l", "r", "score")


def _hit(tier: int, score, pos, via) -> list:
    return [F.lit(tier).alias("tier"), score.alias("score"), pos.alias("pos"), via.alias("via")]


def match(cand: DataFrame, catalogs: Catalogs, names: DataFrame | None = None) -> DataFrame:
    """cand (see candidates; names: their candidate_keys, if stored) -> raw, catalog (ccf, core, journal), ord or key of the entry, via, matched candidate position, tier, score."""
    o, ix = catalogs.options, catalogs.index
    names = candidate_keys(cand) if names is None else names
    acronyms = cand.where("kind = 'normal'").select("raw", F.posexplode("acronyms").alias("pos", "abbr"))
    keys = catalogs.all_keys()
    one = F.lit(1.0)
    cols = ["raw", "catalog", "ref", "tier", "score", "pos", "via", "name"]
    t1 = names.where(F.length("key") >= o.min_key).join(keys, "key").select("raw", "catalog", "ref", *_hit(1, one, F.col("pos"), F.lit(VIA[1])), "name")
    t2 = acronyms.join(ix.abbrs, "abbr").select("raw", "catalog", F.col("ord").cast("string").alias("ref"), *_hit(2, one, F.col("pos"), F.concat(F.lit(VIA[2]), "abbr")), F.lit(None).cast("string").alias("name"))
    prefixes = catalogs.prefix_table() if catalogs.prefixes is None else catalogs.prefixes
    cut = names.where("truncated").where(F.length("key") >= o.min_prefix)
    t3 = cut.join(prefixes, cut["key"] == prefixes["prefix"]).select("raw", "catalog", F.col("ord").alias("ref"), *_hit(3, one, F.col("pos"), F.lit(VIA[3])), "name")
    hits = t1.select(cols).union(t2.select(cols)).union(t3.select(cols))
    if o.fuzzy:
        done = hits.where("catalog <> 'journal'").select("raw", "catalog").distinct()
        words = names.where(F.col("pos") < o.fuzzy_names).select("raw", "pos", "name", F.array_distinct(F.expr(T.tokens_of("name"))).alias("tokens")).where(F.size("tokens") >= o.fuzzy_tokens)
        open_ = words.withColumn("catalog", F.explode(F.array(F.lit("ccf"), F.lit("core")))).join(done, ["raw", "catalog"], "left_anti")
        left = open_.select(F.struct("catalog", "raw", "pos", "name").alias("l"), F.transform("tokens", lambda t: F.concat(F.col("catalog"), F.lit(":"), t)).alias("tokens"))
        right = ix.tokens.select(F.struct("catalog", "ord").alias("r"), F.transform("tokens", lambda t: F.concat(F.col("catalog"), F.lit(":"), t)).alias("tokens"))
        found = containment_pairs(left, right, o.fuzzy_score, o.fuzzy_tokens)
        t4 = found.select("l.raw", "l.catalog", F.col("r.ord").cast("string").alias("ref"), *_hit(4, F.col("score"), F.col("l.pos"), F.lit(VIA[4])), F.col("l.name").alias("name"))
        hits = hits.union(t4.select(cols))
    place = F.struct("tier", (-F.col("score")).alias("s"), "pos", F.when(F.col("catalog") != "journal", F.col("ref").cast("int")).alias("o"), "ref")
    best = F.min_by(F.struct("ref", "tier", "score", "pos", "via", "name"), place)
    return hits.groupBy("raw", "catalog").agg(best.alias("b")).select("raw", "catalog", "b.*")


def match_tags(cand: DataFrame, found: DataFrame, catalogs: Catalogs, names: DataFrame | None = None) -> DataFrame:
    """raw, tag_ord of every tag that holds the ccf entry, the core entry or a candidate key."""
    tags, entries = catalogs.tags, catalogs.index.entries
    member = lambda col, kind, key: tags.select(F.col("ord").alias("tag_ord"), F.lit(kind).alias("kind"), F.explode(col).alias("m")).select("tag_ord", "kind", F.expr(key).alias("value"))
    members = member("ccf", "ccf", "upper(m)").union(member("core", "core", "upper(m)")).union(member("names", "name", T.normalize_name("m"))).where("value <> ''").distinct()
    conf = found.where("catalog <> 'journal'").join(entries.select("catalog", F.col("ord").cast("string").alias("ref"), F.upper("abbr").alias("value")), ["catalog", "ref"]).select("raw", F.col("catalog").alias("kind"), "value")
    keys = (candidate_keys(cand) if names is None else names).where("key <> ''").select("raw", F.lit("name").alias("kind"), F.col("key").alias("value"))
    return conf.union(keys).join(members, ["kind", "value"]).select("raw", "tag_ord").distinct()


def lookup(raws: DataFrame, catalogs: Catalogs) -> DataFrame:
    """One row a distinct raw: kind, truncated, preprint_name, ccf, core, journal and tags (structs, null if none), via, core_via, matched_name."""
    raws = raws.select(F.expr(T.trim(T.text("raw"))).alias("raw"))
    # both feed several branches
    cand = stored(candidates(raws), "candidates")
    names = stored(candidate_keys(cand), "names")
    found = stored(match(cand, catalogs, names), "matches")
    entries = catalogs.index.entries

    def conf(c: str) -> DataFrame:
        rows = entries.where(F.col("catalog") == c).select(F.col("ord").cast("string").alias("ref"), F.struct(*[x for x in entries.columns if x != "catalog"]).alias(c))
        return found.where(F.col("catalog") == c).join(rows, "ref").select("raw", c, F.col("via").alias(f"{c}_via"))

    records = catalogs.journals.select("key", F.struct(*catalogs.journals.columns).alias("journal"))
    name = F.when(F.col("tier") == 3, F.coalesce("journal.n", "name")).otherwise(F.col("name"))
    journal = found.where("catalog = 'journal'").withColumnRenamed("ref", "key").join(records, "key").select("raw", "journal", F.col("via").alias("journal_via"), name.alias("journal_name"))
    tags = match_tags(cand, found, catalogs, names).join(catalogs.tags.withColumnRenamed("ord", "tag_ord"), "tag_ord")
    tags = tags.groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("tag_ord", "id", "label", "descr", "cls"))).alias("tags"))
    out = cand.select("raw", "kind", "truncated", "preprint_name").join(conf("ccf"), "raw", "left").join(conf("core"), "raw", "left").join(journal, "raw", "left").join(tags, "raw", "left")
    own = lambda c: F.coalesce(F.nullif(F.col(f"{c}.abbr"), F.lit("")), F.col(f"{c}.name"))
    return out.select(
        "raw", "kind", "truncated", "preprint_name", "ccf", "core", "journal", "tags", F.coalesce("ccf_via", "journal_via", "core_via").alias("via"),
        F.col("core_via"), F.coalesce("journal_name", F.when(F.col("ccf").isNotNull(), own("ccf")).otherwise(own("core"))).alias("matched_name"),
    )

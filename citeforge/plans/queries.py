"""Queries by operator, each over whole driver tables or the inline samples, with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import seed
from ..functions import candidates as C
from ..functions import text as T
from ..operators.annotate import annotate_pages, page_venues
from ..operators.catalog import conference_index, journal_counts, merge_journals, prefix_dictionary, rank_counts, source_counts
from ..operators.labels import explain, first_with_labels, labels
from ..operators.match import Catalogs, candidate_keys, candidates, containment_pairs, lookup, match, match_tags
from ..sources import files, pages
from ..sources.tables import dropped_at_end, shared_dir
from ..streaming.annotate import drain
from . import duck as D
from .samples import BYLINES, VENUES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VENUES], "raw string")


_seeds: dict[str, Catalogs] = {}


def _seed(spark: SparkSession) -> Catalogs:
    """The seed catalogs, built once an application, as catalogs are."""
    app = spark.sparkContext.applicationId
    if app not in _seeds:
        _seeds.clear()
        _seeds[app] = seed.catalogs(spark)
    return _seeds[app]


RAWS = "raws AS (SELECT * FROM " + D.values([(v,) for v in VENUES], "raw", "r") + ")"
LOOKUP = f"WITH {RAWS}, {D.candidates('raws')}, {D.index()}, {D.matching()}"


@query("sf2_normalize_key", f"SELECT p_partkey, {D.normalize_name('p_name')} AS name_key, {D.normalize_name('p_type')} AS type_key FROM part")
def sf2(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{T.normalize_name('p_name')} AS name_key", f"{T.normalize_name('p_type')} AS type_key")


@query("sf5_tokens_count", f"SELECT doc_id, CAST(len({D.tokens_of('text')}) AS INT) AS n_tokens, CAST(len(list_distinct({D.tokens_of('text')})) AS INT) AS n_distinct FROM documents")
def sf5(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{T.tokens_of('text')} AS ts")
    return docs.selectExpr("doc_id", "size(ts) AS n_tokens", "size(array_distinct(ts)) AS n_distinct")


@query("sf6_strip_wrappers", f"WITH {RAWS} SELECT raw, {D.strip_wrappers('raw')} AS unwrapped FROM raws")
def sf6(spark, d):
    return venues(spark).selectExpr("raw", f"{T.strip_wrappers('raw')} AS unwrapped")


@query("sf9_strip_numerics", f"WITH {RAWS} SELECT raw, {D.strip_trailing_numerics('raw')} AS bare, {D.drop_parenthesis('raw')} AS no_parenthesis, {D.strip_year('raw')} AS no_year FROM raws")
def sf9(spark, d):
    return venues(spark).selectExpr("raw", f"{T.strip_trailing_numerics('raw')} AS bare", f"{T.drop_parenthesis('raw')} AS no_parenthesis", f"{T.strip_year('raw')} AS no_year")


@query("fp1_classify", f"WITH {RAWS} SELECT raw, {D.classify('raw')} AS kind, CASE WHEN {D.classify('raw')} = 'preprint' THEN {D.preprint_source('raw')} END AS server, {D.truncated('raw')} AS truncated FROM raws UNION ALL SELECT 'conversations', {D.classify('text')}, CAST(count(*) AS VARCHAR), false FROM conversations GROUP BY 2")
def fp1(spark, d):
    inline = venues(spark).selectExpr("raw", f"{T.classify('raw')} AS kind", f"{T.truncated('raw')} AS truncated", f"{T.preprint_source('raw')} AS source")
    inline = inline.selectExpr("raw", "kind", "CASE WHEN kind = 'preprint' THEN source END AS server", "truncated")
    talk = table(spark, d, "conversations").groupBy(F.expr(T.classify("text")).alias("kind")).agg(F.count("*").cast("string").alias("server"))
    return inline.union(talk.select(F.lit("conversations"), "kind", "server", F.lit(False)))


_RANKS = ["A*", "a", " b ", "C", "Australasian  b", "National:China", "national: UK", "Regional", "unranked", "Journal Published", "Multiconference", "TBR", ""]
_RANK_SQL = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"


@query("sf20_rank_text", f"SELECT x AS raw, CASE WHEN regexp_matches({_RANK_SQL}, '(?i)^a\\*$') THEN 'A*' WHEN upper({_RANK_SQL}) IN ('A', 'B', 'C') THEN upper({_RANK_SQL}) WHEN regexp_matches({_RANK_SQL}, '(?i)^australasian *[abc]$') THEN 'Australasian ' || upper(right({_RANK_SQL}, 1)) WHEN lower({_RANK_SQL}) LIKE 'national%' THEN 'National' WHEN lower({_RANK_SQL}) LIKE 'regional%' THEN 'Regional' WHEN regexp_matches({_RANK_SQL}, '(?i)^(unranked|journal published|multiconference)') THEN 'Unranked' ELSE 'Other' END AS rank FROM " + D.values([(x,) for x in _RANKS], "x", "v"))
def sf20(spark, d):
    return spark.createDataFrame([(x,) for x in _RANKS], "raw string").selectExpr("raw", f"{T.rank_text('raw')} AS rank")


_CELLS = [("3 [168/495]", "12.3abc", "1234-567x"), ("12", "<0.1", "12345678"), ("5 x", ".5e1", " 0000-0000 "), ("", "-7.", ""), ("4", "1e3", "1234-56789")]


@query("sm1_numbers", "SELECT z AS zone_text, CASE WHEN regexp_matches(z, '^\\s*[1-4]\\b') THEN CAST(regexp_extract(z, '^\\s*([1-4])', 1) AS INT) ELSE 0 END AS zone, TRY_CAST(nullif(regexp_extract(n, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS number, CASE WHEN regexp_matches(upper(trim(i)), '^[0-9]{4}-[0-9]{3}[0-9X]$') THEN upper(trim(i)) ELSE '' END AS issn FROM " + D.values(_CELLS, "z, n, i", "v"))
def sm1(spark, d):
    return spark.createDataFrame(_CELLS, "z string, n string, i string").selectExpr("z AS zone_text", f"{T.zone_of('z')} AS zone", f"{T.leading_number('n')} AS number", f"{T.clean_issn('i')} AS issn")


@query("ag1_candidates", f"WITH {RAWS}, {D.candidates('raws')} SELECT raw, CAST(pos AS INT) AS pos, name, key FROM names")
def ag1(spark, d):
    return candidate_keys(candidates(venues(spark))).select("raw", "pos", "name", "key")


@query("ag5_acronyms", f"WITH {RAWS}, {D.candidates('raws')} SELECT raw, CAST(pos AS INT) AS pos, abbr FROM acronyms")
def ag5(spark, d):
    return candidates(venues(spark)).select("raw", F.posexplode("acronyms").alias("pos", "abbr"))


_LINES = "lines AS (SELECT * FROM " + D.values([(i, b) for i, (b, _) in enumerate(BYLINES)], "line_id, line", "b") + ")"
_BYLINE = f"""WITH {_LINES},
parts AS (SELECT line_id, list_filter(list_transform(regexp_split_to_array(replace(line, chr(160), ' '), '\\s+-\\s+'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM lines),
bodies AS (SELECT line_id, list_filter(ps[2:], lambda p: NOT regexp_matches(p, '(?i)^(https?://)?[\\w-]+(\\.[\\w-]+)+(/\\S*)?$')) AS b FROM parts WHERE len(ps) >= 2),
pushed AS (SELECT line_id, 0 AS o, array_to_string(b, ' - ') AS v FROM bodies WHERE len(b) > 0 UNION ALL SELECT line_id, unnest(range(1, len(b) + 1)), unnest(b) FROM bodies),
tidy AS (SELECT line_id, raw, min(o) AS o FROM (SELECT line_id, o, {D.strip_year('v')} AS raw FROM pushed) WHERE length(raw) >= 3 GROUP BY 1, 2)
SELECT CAST(line_id AS INT) AS line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY o) - 1 AS INT) AS pos, raw FROM tidy"""


@query("ag9_byline", _BYLINE)
def ag9(spark, d):
    return spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BYLINES)], "line_id int, line string").selectExpr("line_id", f"posexplode({C.venues_from_byline('line')}) AS (pos, raw)")


def _tier(spark, tier: int) -> DataFrame:
    found = match(candidates(venues(spark)), _seed(spark))
    return found.where(F.col("tier") == tier).select("raw", "catalog", "ref", "pos", "via", F.round("score", 6).alias("score"))


_TIER = LOOKUP + " SELECT raw, catalog, ref, CAST(pos AS INT) AS pos, via, round(score, 6) AS score FROM best WHERE tier = {tier}"


@query("jn1_exact_join", _TIER.replace("{tier}", "1"))
def jn1(spark, d):
    return _tier(spark, 1)


@query("jn3_acronym_join", _TIER.replace("{tier}", "2"))
def jn3(spark, d):
    return _tier(spark, 2)


@query("jn4_unique_prefix", _TIER.replace("{tier}", "3"))
def jn4(spark, d):
    return _tier(spark, 3)


@query("jn6_seed_containment", _TIER.replace("{tier}", "4"))
def jn6_seed(spark, d):
    return _tier(spark, 4)


@query("jn6_containment", f"""
WITH b AS (SELECT item_id, list_distinct({D.tokens_of('text')}) AS ts FROM benchmark), c AS (SELECT doc_id, list_distinct(ws) AS ts FROM (SELECT doc_id, {D.tokens_of('text')} AS ws FROM documents) WHERE len(ws) >= 4),
p AS (SELECT item_id, doc_id, len(list_intersect(b.ts, c.ts)) / CAST(least(len(b.ts), len(c.ts)) AS DOUBLE) AS s FROM b, c WHERE len(b.ts) >= 4)
SELECT item_id, doc_id, round(s, 6) AS score FROM p WHERE s >= 0.85""")
def jn6(spark, d):
    left = table(spark, d, "benchmark").select(F.col("item_id").alias("l"), F.expr(T.tokens_of("text")).alias("tokens"))
    right = table(spark, d, "documents").select(F.col("doc_id").alias("r"), F.expr(T.tokens_of("text")).alias("tokens")).where(F.size("tokens") >= 4)
    return containment_pairs(left, right, 0.85, 4).select(F.col("l").alias("item_id"), F.col("r").alias("doc_id"), F.round("score", 6).alias("score"))


@query("jn7_alias_targets", f"WITH {D.index()} SELECT catalog, key, CAST(ord AS INT) AS ord FROM keys")
def jn7(spark, d):
    return _seed(spark).index.keys.select("catalog", "key", "ord")


@query("jn9_alias_acronyms", f"WITH {D.index()} SELECT catalog, abbr, CAST(ord AS INT) AS ord FROM abbrs")
def jn9_index(spark, d):
    return _seed(spark).index.abbrs.select("catalog", "abbr", "ord")


@query("index_volume", f"""
WITH e AS (SELECT CAST(p_partkey AS INT) AS ord, p_brand AS abbr, p_name || ' ' || p_type || ' (v' || p_size || ')' AS name FROM part),
t AS (SELECT n_name AS src, n_nationkey AS alias_ord, min(ord) AS ord FROM nation JOIN e ON upper(e.abbr) = 'BRAND#' || n_nationkey GROUP BY 1, 2),
r AS (
  SELECT {D.normalize_name('name')} AS key, ord, 2 AS p, ord AS a, 0 AS b FROM e UNION ALL SELECT {D.normalize_name(D.drop_parenthesis('name'))}, ord, 2, ord, 1 FROM e UNION ALL SELECT {D.normalize_name('abbr')}, ord, 2, ord, 2 FROM e
  UNION ALL SELECT {D.normalize_name('src')}, ord, 1, -alias_ord, 0 FROM t)
SELECT key, ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, a, b) AS n FROM r WHERE key <> '' AND (p < 2 OR length(key) >= 4)) WHERE n = 1""")
def index_volume(spark, d):
    entries = table(spark, d, "part").selectExpr("'ccf' AS catalog", "cast(p_partkey AS int) AS ord", "p_brand AS abbr", "concat(p_name, ' ', p_type, ' (v', p_size, ')') AS name", "'A' AS rank")
    aliases = table(spark, d, "nation").selectExpr("'names' AS kind", "n_nationkey AS ord", "n_name AS src", "concat('Brand#', n_nationkey) AS target")
    return conference_index(entries, aliases).keys.select("key", "ord")


@query("jn11_missing_alias", f"WITH {D.index()} SELECT kind, src, target FROM targets WHERE ord IS NULL AND (catalog = 'ccf' OR kind = 'core_names')")
def jn11(spark, d):
    return _seed(spark).index.missing.select("kind", "src", "target")


@query("jn12_tags", LOOKUP + f", {D.tags()} SELECT raw, CAST(tag_ord AS INT) AS tag_ord FROM tagged")
def jn12(spark, d):
    cats = _seed(spark)
    cand = candidates(venues(spark))
    return match_tags(cand, match(cand, cats), cats).select("raw", "tag_ord")


@query("venue_prefixes", f"WITH {D.index()}, p AS (SELECT catalog, ref, key[1:n] AS prefix FROM (SELECT catalog, ref, key, unnest(range(14, length(key))) AS n FROM all_keys)) SELECT catalog, prefix, min(ref) AS ref FROM p GROUP BY 1, 2 HAVING count(DISTINCT ref) = 1")
def prefixes(spark, d):
    cats = _seed(spark)
    keys = cats.index.keys.select("catalog", "key", F.col("ord").cast("string").alias("ord")).union(cats.journals.select(F.lit("journal"), "key", "key"))
    return prefix_dictionary(keys).select("catalog", "prefix", F.col("ord").alias("ref"))


@query("venue_lookup", LOOKUP + """ SELECT c.raw, c.kind, c.truncated, f.ref AS ccf, o.ref AS core, j.ref AS journal, coalesce(f.via, j.via, o.via) AS via, o.via AS core_via
FROM cand c LEFT JOIN best f ON f.raw = c.raw AND f.catalog = 'ccf' LEFT JOIN best o ON o.raw = c.raw AND o.catalog = 'core' LEFT JOIN best j ON j.raw = c.raw AND j.catalog = 'journal'""")
def venue_lookup(spark, d):
    found = lookup(venues(spark), _seed(spark))
    return found.select("raw", "kind", "truncated", F.col("ccf.ord").cast("string").alias("ccf"), F.col("core.ord").cast("string").alias("core"), F.col("journal.key").alias("journal"), "via", "core_via")


@query("lookup_volume", f"""WITH raws AS (SELECT v.raw || ', ' || p_partkey AS raw FROM part JOIN {D.values(list(enumerate(VENUES)), "i, raw", "v")} ON p_partkey % {len(VENUES)} = v.i),
{D.candidates('raws')}, {D.index()}, {D.matching()} SELECT c.raw, c.kind, f.ref AS ccf, o.ref AS core, j.ref AS journal, coalesce(f.via, j.via, o.via) AS via
FROM cand c LEFT JOIN best f ON f.raw = c.raw AND f.catalog = 'ccf' LEFT JOIN best o ON o.raw = c.raw AND o.catalog = 'core' LEFT JOIN best j ON j.raw = c.raw AND j.catalog = 'journal'""")
def lookup_volume(spark, d):
    """A distinct string for each part: a sample venue with one more number."""
    names = F.element_at(F.array(*map(F.lit, VENUES)), (F.col("p_partkey") % len(VENUES) + 1).cast("int"))
    found = lookup(table(spark, d, "part").select(F.concat_ws(", ", names, F.col("p_partkey").cast("string")).alias("raw")), _seed(spark))
    return found.select("raw", "kind", F.col("ccf.ord").cast("string").alias("ccf"), F.col("core.ord").cast("string").alias("core"), F.col("journal.key").alias("journal"), "via")


_TAG_LABELS = D.values([(t[0], t[2]) for t in seed.TAGS], "tag_ord, label", "g")
_SLUG = "CASE e.rank WHEN 'Australasian A' THEN '澳新A' WHEN 'Australasian B' THEN '澳新B' WHEN 'Australasian C' THEN '澳新C' ELSE e.rank END"


@query("venue_badges", LOOKUP + f""", {D.tags()}, parts AS (
  SELECT raw, tag_ord AS o, label AS t FROM tagged JOIN {_TAG_LABELS} USING (tag_ord)
  UNION ALL SELECT b.raw, 10, 'CCF ' || e.rank FROM best b JOIN entries e ON b.catalog = 'ccf' AND e.catalog = 'ccf' AND CAST(e.ord AS VARCHAR) = b.ref
  UNION ALL SELECT b.raw, 11, 'CORE ' || {_SLUG} FROM best b JOIN entries e ON b.catalog = 'core' AND e.catalog = 'core' AND CAST(e.ord AS VARCHAR) = b.ref WHERE e.rank IN ('A*', 'A', 'B', 'C', 'Australasian A', 'Australasian B', 'Australasian C')
  UNION ALL SELECT b.raw, 12 + k, CASE k WHEN 0 THEN CASE WHEN top = 1 THEN cat || 'TOP' END WHEN 1 THEN CASE WHEN ei = 1 THEN 'EI检索' END WHEN 2 THEN 'SCI升级版 ' || cat || zone || '区' WHEN 3 THEN 'IF ' || regexp_replace(CAST(CAST(impact AS DOUBLE) AS VARCHAR), '\\.0$', '') ELSE '预警 ' || warn END
    FROM best b JOIN journals j ON b.catalog = 'journal' AND j.key = b.ref, (SELECT unnest(range(5)) AS k)
  UNION ALL SELECT raw, 0, {D.preprint_source('raw')} FROM cand WHERE kind = 'preprint')
SELECT c.raw, coalesce(string_agg(t, ' ' ORDER BY o), '') AS labels FROM cand c LEFT JOIN (SELECT * FROM parts WHERE t IS NOT NULL) p ON p.raw = c.raw GROUP BY c.raw""")
def venue_badges(spark, d):
    return explain(lookup(venues(spark), _seed(spark))).select("raw", "labels")


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Driver tables in the shape of the four journal sources; names repeat within and across them."""
    cas = table(spark, d, "part").selectExpr("cast(p_partkey AS int) AS ord", "p_name AS name", "'' AS issns", "p_brand AS wos", "p_type AS cat", "cast(p_size AS string) AS zone", "if(p_size > 25, '是', '否') AS top", "'' AS sub", "'' AS sub_zone")
    jcr = table(spark, d, "customer").selectExpr("cast(c_custkey AS int) AS ord", "concat(c_mktsegment, ' ', c_nationkey) AS name", "cast(c_acctbal AS string) AS impact", "concat('Q', c_custkey % 6) AS quartile", "'' AS wos", "'' AS issn", "'' AS eissn")
    warn = table(spark, d, "supplier").selectExpr("cast(s_suppkey AS int) AS ord", "concat('building ', s_nationkey) AS name", "if(s_suppkey % 3 = 0, '', s_name) AS reason")
    return {"cas": cas, "jcr": jcr, "warn": warn, "ei": table(spark, d, "part").where("p_size < 5").selectExpr("cast(p_partkey AS int) AS ord", "p_name AS name")}


_MERGED = f"""WITH a AS (SELECT {D.normalize_name('p_name')} AS key, * FROM part), b AS (SELECT {D.normalize_name("c_mktsegment || ' ' || c_nationkey")} AS key, c_mktsegment || ' ' || c_nationkey AS name, * FROM customer),
c AS (SELECT {D.normalize_name("'building ' || s_nationkey")} AS key, 'building ' || s_nationkey AS name, * FROM supplier),
ka AS (SELECT key, arg_max(p_name, p_partkey) AS n, arg_max(p_brand, p_partkey) AS wos, arg_max(p_type, p_partkey) AS cat, arg_max(p_size, p_partkey) FILTER (p_size BETWEEN 1 AND 4) AS zone, max(1) FILTER (p_size > 25) AS top, max(1) FILTER (p_size < 5) AS ei FROM a GROUP BY key),
kb AS (SELECT key, arg_min(name, c_custkey) AS n, arg_max(c_acctbal, c_custkey) AS impact, arg_max('Q' || (c_custkey % 6), c_custkey) FILTER (c_custkey % 6 BETWEEN 1 AND 4) AS quartile FROM b GROUP BY key),
kc AS (SELECT key, arg_min(name, s_suppkey) AS n, arg_max(CASE WHEN s_suppkey % 3 = 0 THEN '预警' ELSE s_name END, s_suppkey) AS warn FROM c GROUP BY key),
merged AS (SELECT key, coalesce(ka.n, kb.n, kc.n) AS n, wos, cat, CAST(zone AS INT) AS zone, top, impact, quartile, warn, ei FROM ka FULL JOIN kb USING (key) FULL JOIN kc USING (key) WHERE key <> '')"""


@query("agg1_journal_merge", _MERGED + " SELECT * FROM merged")
def agg1(spark, d):
    return merge_journals(**_sources(spark, d)).select("key", "n", "wos", "cat", "zone", "top", "impact", "quartile", "warn", "ei")


@query("agg4_journal_counts", _MERGED + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(zone) AS BIGINT) AS n_zone, CAST(count(impact) AS BIGINT) AS n_impact, CAST(count(ei) AS BIGINT) AS n_ei FROM merged")
def agg4(spark, d):
    return journal_counts(merge_journals(**_sources(spark, d)))


@query("agg5_source_counts", _MERGED + " SELECT 'cas' AS source, CAST(count(*) AS BIGINT) AS n FROM a WHERE key <> '' UNION ALL SELECT 'jcr', count(*) FROM b WHERE key <> '' UNION ALL SELECT 'warn', count(*) FROM c WHERE key <> '' UNION ALL SELECT 'ei', count(*) FROM a WHERE key <> '' AND p_size < 5")
def agg5(spark, d):
    return source_counts(**_sources(spark, d))


@query("agg2_type_rank", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def agg2(spark, d):
    return rank_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("agg3_rank_sorted", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1")
def agg3(spark, d):
    return rank_counts(table(spark, d, "documents"), "source")


@query("wn4_first_labelled", "SELECT user_id AS line_id, arg_min(event_type, event_id) AS label, min(event_id) AS pos FROM events WHERE value > 50 GROUP BY 1")
def wn4(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id AS line_id", "event_id AS pos", "if(value > 50, array(event_type), cast(array() AS array<string>)) AS labels")
    return first_with_labels(rows).selectExpr("line_id", "labels[0] AS label", "pos")


@query("agg7_intersection", f"SELECT p_partkey, CAST(len(list_intersect(list_distinct({D.tokens_of('p_name')}), list_distinct({D.tokens_of('p_type')}))) AS INT) AS shared FROM part")
def agg7(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"size(array_intersect({T.tokens_of('p_name')}, {T.tokens_of('p_type')})) AS shared")


_TITLE = "regexp_extract(html, '(?is)<title>\\s*(.*?)\\s*</title>', 1)"
_TITLE_TEXT = _TITLE
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _TITLE_TEXT = f"replace({_TITLE_TEXT}, '{_a}', '{_b}')"


@query("sc8_html_rows", f"""SELECT page_id, trim(regexp_replace(regexp_replace({_TITLE_TEXT}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<a[^>]*?href="([^"]*)"', 1) AS link,
CAST(len(regexp_extract_all(html, '(?s)<body[^>]*>(.*?)</body>', 1)) AS INT) AS n_rows, CAST(len(cells) AS INT) AS n_cells, cells[1] AS first_cell
FROM (SELECT *, regexp_extract_all(regexp_extract(html, '(?s)<body[^>]*>(.*?)</body>', 1), '(?s)<p[^>]*>(.*?)</p>', 1) AS cells FROM pages)""")
def sc8(spark, d):
    p = table(spark, d, "pages").select("page_id", files.page_title(F.col("html"), "").alias("t"), files.link_of(F.col("html")).alias("link"), files.html_rows(F.col("html"), r"<body[^>]*>(.*?)</body>", r"<p[^>]*>(.*?)</p>").alias("rows"))
    return p.selectExpr("page_id", f"{T.decode_entities('t')} AS title", "link", "size(rows) AS n_rows", "coalesce(size(get(rows, 0)), 0) AS n_cells", "get(get(rows, 0), 0) AS first_cell")


_CSV = 'a,"b, ""c""",d\r\n1,"x\ny",\r\n"",2,3\n'


@query("sc5_csv_cells", "SELECT * FROM " + D.values([(0, 0, "a"), (0, 1, 'b, "c"'), (0, 2, "d"), (1, 0, "1"), (1, 1, "x\ny"), (1, 2, ""), (2, 0, ""), (2, 1, "2"), (2, 2, "3")], "row_no, col_no, cell", "v"))
def sc5(spark, d):
    rows = spark.createDataFrame([(_CSV.replace("\r\n", "\n"),)], "t string").select(F.posexplode(files.csv_cells(F.col("t"))).alias("row_no", "cells"))
    return rows.select("row_no", F.posexplode("cells").alias("col_no", "cell"))


@query("sm7_host_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https://(?:[^/?#]*\\.)?example\\.(?:com|org)(?:[/?#:]|$)')")
def sm7(spark, d):
    return pages.allowed_pages(table(spark, d, "pages"), ("*.example.com", "*.example.org")).select("page_id", "url")


_URLS = [("https://scholar.google.com/scholar?q=a", True), ("https://scholar.google.co.uk/citations", True), ("https://xueshu.lanfanshu.cn/x", True), ("https://SC.panda985.com/", True), ("http://scholar.google.com/", False), ("https://scholar.google.zz/", False), ("https://scholar.google.com.evil.org/", False), ("not a url", False), (None, False)]


@query("sm7_known_hosts", "SELECT url FROM " + D.values([(u,) for u, ok in _URLS if ok], "url", "v"))
def sm7_known(spark, d):
    return pages.allowed_pages(spark.createDataFrame([(u,) for u, _ in _URLS], "url string"))


_PAGES = [
    (1, '<table><tr class="gsc_a_tr"><td class="gsc_a_t"><a>T</a><div class="gs_gray">A B</div><div class="gs_gray">Multimedia Systems 30 (6), 351<span class="gs_oph">, 2024</span></div></td></tr><tr class="gsc_a_tr"><td class="gsc_a_t"><div class="gs_gray">arXiv preprint arXiv:1</div></td></tr></table>'),
    (2, '<div class="gs_a">J <a href="x">Doe</a>&nbsp;- Multimedia Systems, 2015&nbsp;- springer.com</div><div class="gs_a">K Roe&nbsp;- Unknown Gazette, 2011&nbsp;- example.org</div>'),
    (3, '<div id="gsc_vcd_table"><div class="gs_scl"><div class="gsc_vcd_field">Journal</div><div class="gsc_vcd_value">Multimedia Systems</div></div><div class="gs_scl"><div class="gsc_vcd_field">Pages</div><div class="gsc_vcd_value">1-9</div></div></div>'),
]


def _inline_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PAGES, "page_id long, html string")


@query("sc14_page_scans", "SELECT * FROM " + D.values([(1, "profile", 0, 0, "Multimedia Systems 30 (6), 351"), (1, "profile", 1, 0, "arXiv preprint arXiv:1"), (2, "search", 0, 0, "Multimedia Systems"), (2, "search", 1, 0, "Unknown Gazette"), (3, "detail", 0, 0, "Multimedia Systems")], "page_id, place, row_ord, pos, raw", "v"))
def page_scans(spark, d):
    return page_venues(_inline_pages(spark)).select("page_id", "place", "row_ord", "pos", "raw")


_LINE_LABELS = "CCF C SCI升级版 计算机科学4区 JCR Q2 IF 3.1"


@query("annotate_pages", "SELECT * FROM " + D.values([(1, "profile", 0, _LINE_LABELS), (1, "profile", 1, "arXiv"), (3, "detail", 0, _LINE_LABELS)], "page_id, place, row_ord, labels", "v"))
def annotated(spark, d):
    """With two switches turned, and the search place off."""
    rows = annotate_pages(_inline_pages(spark), _seed(spark), {"showOnSearch": False, "showEi": "false", "showJcr": "true"})
    return rows.select("page_id", "place", "row_ord", F.array_join(F.transform("labels", lambda x: x["text"]), " ").alias("labels"))


_CORE = '1,"Conf, of X",CX,ICORE,a*,Yes,4611,CSE,zz\n2,Short,row\n3,Y,,S,national: China,No,,\n4,,N,S,A,No\n'


@query("sc7_core_rows", "SELECT * FROM " + D.values([("CX", "Conf, of X", "A*", "机器学习/计算机科学与工程（旧分类）/zz", "a*"), ("", "Y", "National", "", "national: China")], "abbr, name, rank, field, rank_raw", "v"))
def core_rows(spark, d):
    path = f"{shared_dir(spark)}/core-{uuid.uuid4().hex}"
    spark.createDataFrame([(_CORE,)], "value string").coalesce(1).write.text(path)
    dropped_at_end(spark, path)
    return files.read_core(spark, path).select("abbr", "name", "rank", "field", "rank_raw")


@query("sf14_page_text", "SELECT page_id, trim(regexp_replace(" + "replace(" * 6 + "regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS body FROM pages")
def sf14(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{T.decode_entities('html')} AS body")


@query("sm5_presentation", "SELECT CAST(i AS INT) AS i, CASE WHEN i NOT IN (0, 100) THEN printf('%.1f', 11 * i / 100.0) || 'px' END AS size, CASE WHEN i = 50 THEN 'sr-theme-mono' ELSE 'sr-theme-soft' END AS theme FROM range(0, 200, 50) t(i)")
def sm5(spark, d):
    return spark.range(0, 200, 50).selectExpr("cast(id as int) AS i", f"{T.font_size('id')} AS size", f"{T.theme_class('''if(id = 50, 'mono', 'other')''')} AS theme")


@query("ss_microbatch", "SELECT event_id, user_id, event_type FROM events")
def ss(spark, d):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return drain(spark, f"{d}/events.parquet", schema, ["event_id"]).select("event_id", "user_id", "event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sample venues, and the title of every page as if it were one, with their labels."""
    titles = table(spark, sf_dir, "pages").select(files.page_title(F.col("html"), "").alias("t")).selectExpr(f"{T.decode_entities('t')} AS raw")
    found = lookup(venues(spark).union(titles), _seed(spark))
    return found.select("raw", "kind", "matched_name", "via", F.array_join(F.transform(labels(), lambda x: x["text"]), " ").alias("labels"))

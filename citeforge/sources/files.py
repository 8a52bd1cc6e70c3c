"""File scans and the catalog sink. Each reader returns rows with ord, the order in the source.

Order within a file comes from the position in the parsed text of that file, which is read whole
(catalog sources are a few megabytes); Spark parallelises over files, not within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T

#: Field-of-research code -> label.
FIELDS = {"4601": "应用计算", "4602": "人工智能", "4603": "计算机视觉与多媒体计算", "4604": "网络空间安全", "4605": "数据管理与数据科学", "4606": "分布式计算与系统软件", "4607": "图形学、增强现实与游戏", "4608": "人机交互", "4609": "信息系统", "4610": "图书情报学", "4611": "机器学习", "4612": "软件工程", "4613": "计算理论", "CSE": "计算机科学与工程（旧分类）"}


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file, byte order mark dropped, line ends made plain."""
    rows = spark.read.text(path, wholetext=True)
    clean = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    return rows.select(F.input_file_name().alias("path"), clean.alias("text"))


#: Stand in for a comma and a line end within quotes (private-use characters).
_COMMA, _LINE = "\ue000", "\ue001"


def csv_cells(text: Column) -> Column:
    """array<array<string>> of a CSV text: quoted cells may hold commas, line ends and doubled quotes.

    The text is cut at quotes: pieces with an odd index are quoted, and an empty piece between two
    quoted ones is a doubled quote.
    """
    pieces = F.split(text, '"')
    marked = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    ends = F.size(pieces) - 1
    joined = F.array_join(F.transform(F.arrays_zip(marked.alias("m"), F.array_repeat(ends, F.size(pieces)).alias("e")), lambda x: F.when(x["m"]["i"] % 2 == 1, F.translate(x["m"]["p"], ",\n", _COMMA + _LINE)).when((x["m"]["p"] == "") & (x["m"]["i"] > 0) & (x["m"]["i"] < x["e"]), F.lit('"')).otherwise(x["m"]["p"])), "")
    lines = F.split(F.regexp_replace(joined, "\n\\z", ""), "\n")
    return F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda c: F.translate(c, _COMMA + _LINE, ",\n")))


def read_csv_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, cells (map of trimmed header to trimmed value; the last of equal headers counts).

    Rows of one cell or of blanks only are dropped; missing cells are ''.
    """
    rows = whole_texts(spark, path).select("path", csv_cells(F.col("text")).alias("rows")).select("path", F.get("rows", F.lit(0)).alias("head"), F.posexplode("rows").alias("ord", "cells"))
    rows = rows.where((F.col("ord") > 0) & (F.size("cells") > 1) & F.exists("cells", lambda c: F.trim(c) != ""))
    keep = F.expr("filter(transform(head, (h, i) -> struct(trim(h) as k, trim(coalesce(get(cells, i), '')) as v, i as i)), x -> not exists(slice(head, x.i + 2, size(head)), y -> trim(y) = x.k))")
    return rows.select("path", "ord", F.map_from_entries(F.transform(keep, lambda x: F.struct(x["k"], x["v"]))).alias("cells"), F.trim(F.coalesce(F.get("cells", F.lit(1)), F.lit(""))).alias("second"))


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """Spark's own CSV reader with the same quoting; for large inputs whose order does not matter."""
    reader = spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def fields_text(codes: Column) -> Column:
    """Labels of codes, an unknown code as it is, joined by /."""
    names = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    plain = F.filter(F.transform(codes, lambda c: F.trim(c)), lambda c: c != "")
    return F.array_join(F.transform(plain, lambda c: F.coalesce(F.try_element_at(names, c), F.try_element_at(names, F.regexp_replace(c, r"^0+|\.0*$", "")), c)), "/")


def read_core(spark: SparkSession, path: str) -> DataFrame:
    """Headerless id, title, acronym, source, rank, dblp, fields... -> catalog entries. No row at all is an error."""
    rows = whole_texts(spark, path).select(F.posexplode(csv_cells(F.col("text"))).alias("ord", "c")).where(F.size("c") >= 5)
    cell = lambda i: F.trim(F.get("c", F.lit(i)))
    rows = rows.select("ord", cell(1).alias("name"), cell(2).alias("abbr"), cell(3).alias("source"), cell(4).alias("raw"), F.slice("c", F.lit(7), F.greatest(F.size("c") - 6, F.lit(0))).alias("codes")).where("name <> '' and raw <> ''")
    if rows.isEmpty():
        raise ValueError(f"no entry in {path}")
    rank = F.expr(T.rank_text("raw"))
    return rows.select(F.lit("core").alias("catalog"), "ord", "abbr", "name", rank.alias("rank"), F.lit("conference").alias("type"), "source", fields_text(F.col("codes")).alias("field"), F.lit("").alias("url"), F.when(rank != F.col("raw"), F.col("raw")).alias("rank_raw"))


def html_rows(html: Column, row: str = r'<tr class="item"[^>]*>(.*?)</tr>', cell: str = r"<t[dh][^>]*>(.*?)</t[dh]>") -> Column:
    """array<array<string>>: raw cells of each table row."""
    found = F.regexp_extract_all(html, F.lit(f"(?s){row}"), F.lit(1))
    return F.transform(found, lambda r: F.regexp_extract_all(r, F.lit(f"(?s){cell}"), F.lit(1)))


def page_title(html: Column, default: str = "CCF") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<title>\s*(.*?)\s*</title>", 1), F.lit("")), F.lit(default))


def link_of(cell: Column) -> Column:
    """The first link's target, '' if none."""
    return F.regexp_extract(cell, r'<a[^>]*?href="([^"]*)"', 1)


def read_ccf(spark: SparkSession, path: str) -> DataFrame:
    """Table rows of six cells or more -> catalog entries with ranks A, B, C. No row at all is an error."""
    rows = whole_texts(spark, path).select(F.posexplode(html_rows(F.col("text"))).alias("ord", "c")).where(F.size("c") >= 6)
    if rows.isEmpty():
        raise ValueError(f"no row in {path}")
    plain = lambda i: F.expr(T.decode_entities(f"get(c, {i})"))
    rows = rows.select("ord", plain(1).alias("abbr"), plain(2).alias("name"), plain(3).alias("rank"), plain(4).alias("kind"), plain(5).alias("field"), F.coalesce(F.nullif(link_of(F.get("c", F.lit(2))), F.lit("")), link_of(F.get("c", F.lit(1)))).alias("url"))
    rows = rows.where(F.col("rank").rlike("^[ABC]$") & ((F.col("abbr") != "") | (F.col("name") != "")))
    return rows.select(F.lit("ccf").alias("catalog"), "ord", "abbr", "name", "rank", F.when(F.col("kind").contains("期刊"), "journal").otherwise("conference").alias("type"), F.lit("CCF").alias("source"), "field", "url")


def read_title_list(spark: SparkSession, path: str) -> DataFrame:
    """ord, name: lines of the first fenced block of a Markdown file (of the whole file if there is none)."""
    block = F.regexp_extract("text", r"(?s)```(.*?)```", 1)
    body = F.when(F.col("text").rlike(r"(?s)```.*?```"), block).otherwise(F.col("text"))
    lines = whole_texts(spark, path).select(F.posexplode(F.split(body, "\n")).alias("ord", "line"))
    lines = lines.select("ord", F.expr(T.trim(T.sub("line", "\t+", " "))).alias("name"))
    return lines.where((F.length("name") >= 3) & ~F.col("name").rlike("^(#|http)"))


ALIASES = ST.StructType([ST.StructField(n, ST.MapType(ST.StringType(), ST.StringType())) for n in ("names", "acronyms", "coreNames", "ccfToCore")])


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """kind, ord, src, target of a JSON document of four maps, in document order."""
    doc = spark.read.schema(ALIASES).option("multiLine", True).json(path)
    parts = [doc.select(F.lit(kind).alias("kind"), F.posexplode(F.map_entries(F.coalesce(F.col(col), F.create_map().cast("map<string,string>")))).alias("ord", "e")) for col, kind in (("names", "names"), ("acronyms", "acronyms"), ("coreNames", "core_names"), ("ccfToCore", "ccf_to_core"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("kind", "ord", F.col("e.key").alias("src"), F.col("e.value").alias("target"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tag groups of a JSON document in order, with defaults for description and style."""
    group = "struct<id:string,label:string,desc:string,cls:string,ccf:array<string>,core:array<string>,names:array<string>>"
    doc = spark.read.schema(f"groups array<{group}>").option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    g = doc.select(F.posexplode("groups").alias("ord", "g"))
    return g.select("ord", "g.id", "g.label", F.coalesce("g.desc", F.lit("")).alias("descr"), F.coalesce("g.cls", F.lit("sr-tag-rose")).alias("cls"), *[F.coalesce(f"g.{c}", none).alias(c) for c in ("ccf", "core", "names")])


def write_catalog(df: DataFrame, path: str, catalog: str, source: str, version: str) -> None:
    """Overwrites a catalog as Parquet, and beside it one row of metadata: catalog, source, version, generated_at, row_count."""
    df.write.mode("overwrite").parquet(f"{path}/{catalog}")
    spark = df.sparkSession
    n = spark.read.parquet(f"{path}/{catalog}").count()
    meta = spark.range(1).select(F.lit(catalog).alias("catalog"), F.lit(source).alias("source"), F.lit(version).alias("version"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("generated_at"), F.lit(n).cast("long").alias("row_count"))
    meta.write.mode("overwrite").parquet(f"{path}/{catalog}_meta")


def catalog_info(spark: SparkSession, path: str, *catalogs: str) -> DataFrame:
    """Metadata of the written catalogs."""
    return spark.read.parquet(*[f"{path}/{c}_meta" for c in catalogs])

"""Catalogs from files: the four journal sources by their headers, the JSON envelopes, and what write_catalog wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.catalog import conference_index, merge_journals
from ..operators.match import Catalogs, Options
from . import files

#: Column -> header of the partition table, and of the impact table.
CAS_HEADERS = {"name": "Journal", "issns": "ISSN/EISSN", "wos": "Web of Science", "cat": "大类", "zone": "大类分区", "top": "Top", "sub": "小类1", "sub_zone": "小类1分区"}
JCR_HEADERS = {"name": "Journal", "impact": "IF(2025)", "quartile": "IF Quartile(2025)_1", "wos": "Web of Science", "issn": "ISSN", "eissn": "EISSN"}
ENTRY = "struct<abbr:string,name:string,rank:string,type:string,source:string,field:string,url:string,rankRaw:string>"
JOURNAL = "struct<n:string,issn:string,eissn:string,wos:string,cat:string,zone:int,top:int,sub:array<string>,`if`:double,q:string,warn:string,ei:int>"
JOURNAL_COLUMNS = ("key", "n", "issn", "eissn", "wos", "cat", "zone", "top", "sub", "sub_zone", "impact", "quartile", "warn", "ei")


def _by_header(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    cell = lambda h: F.coalesce(F.try_element_at("cells", F.lit(h)), F.lit(""))
    return rows.select("ord", *[cell(h).alias(c) for c, h in headers.items()]).where("name <> ''")


def read_cas(spark: SparkSession, path: str) -> DataFrame:
    """Partition table: ord, name, issns, wos, cat, zone, top, sub, sub_zone."""
    return _by_header(files.read_csv_objects(spark, path), CAS_HEADERS)


def read_jcr(spark: SparkSession, path: str) -> DataFrame:
    """Impact table: ord, name, impact, quartile, wos, issn, eissn."""
    return _by_header(files.read_csv_objects(spark, path), JCR_HEADERS)


def read_warn(spark: SparkSession, path: str) -> DataFrame:
    """Warning list: ord, name, reason (the second column, whatever its header)."""
    rows = files.read_csv_objects(spark, path)
    return rows.select("ord", F.coalesce(F.try_element_at("cells", F.lit("Journal")), F.lit("")).alias("name"), F.col("second").alias("reason")).where("name <> ''")


def build_journals(spark: SparkSession, cas: str, jcr: str, warn: str, ei: str) -> DataFrame:
    """Four files to one row a journal key."""
    return merge_journals(read_cas(spark, cas), read_jcr(spark, jcr), read_warn(spark, warn), files.read_title_list(spark, ei))


def read_entries(spark: SparkSession, path: str, catalog: str) -> DataFrame:
    """Entries of a JSON envelope {source, version, generatedAt, count, entries}, in document order."""
    doc = spark.read.schema(f"entries array<{ENTRY}>").option("multiLine", True).json(path)
    e = doc.select(F.posexplode("entries").alias("ord", "e")).select(F.lit(catalog).alias("catalog"), "ord", "e.*").withColumnRenamed("rankRaw", "rank_raw")
    kind = F.coalesce("type", F.lit("conference"))
    return e.select("catalog", "ord", "abbr", "name", "rank", kind.alias("type"), F.coalesce("source", F.lit(catalog.upper())).alias("source"), F.coalesce("field", F.lit("")).alias("field"), F.coalesce("url", F.lit("")).alias("url"), "rank_raw")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """Journals of a JSON envelope {generatedAt, sources, count, journals by key}."""
    doc = spark.read.schema(f"journals map<string,{JOURNAL}>").option("multiLine", True).json(path)
    j = doc.select(F.explode("journals").alias("key", "j")).select("key", "j.*")
    sub = F.get("sub", F.lit(0))
    return j.select("key", "n", "issn", "eissn", "wos", "cat", "zone", "top", sub.alias("sub"), F.get("sub", F.lit(1)).cast("int").alias("sub_zone"), F.col("if").alias("impact"), F.col("q").alias("quartile"), "warn", "ei")


def envelope_info(spark: SparkSession, path: str) -> DataFrame:
    """source, version, generated_at and row_count that an envelope states."""
    doc = spark.read.schema("source string, version string, generatedAt string, count long").option("multiLine", True).json(path)
    return doc.select("source", "version", F.col("generatedAt").alias("generated_at"), F.col("count").alias("row_count"))


def assemble(entries: DataFrame, journals: DataFrame, aliases: DataFrame, tags: DataFrame, options: Options | None = None) -> Catalogs:
    """Catalogs ready for lookup(), every table stored once."""
    return Catalogs(conference_index(entries, aliases), journals.select(*JOURNAL_COLUMNS), tags, options or Options()).ready()


def load_json(spark: SparkSession, ccf: str, core: str, journals: str, aliases: str, tags: str, options: Options | None = None) -> Catalogs:
    """Catalogs of five JSON documents."""
    entries = read_entries(spark, ccf, "ccf").unionByName(read_entries(spark, core, "core"))
    return assemble(entries, read_journals(spark, journals), files.read_aliases(spark, aliases), files.read_tags(spark, tags), options)


def load_catalogs(spark: SparkSession, folder: str, options: Options | None = None) -> Catalogs:
    """Catalogs of the Parquet tables ccf, core, journals, aliases and tags that write_catalog put into a folder."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return assemble(read("ccf").unionByName(read("core"), allowMissingColumns=True), read("journals"), read("aliases"), read("tags"), options)

"""Venue strings out of result pages: profile rows, search bylines, detail panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import text as T

#: Field names of a detail panel that hold a venue.
DETAIL_FIELDS = ("期刊", "会议", "来源", "图书", "刊物", "journal", "conference", "source", "book", "publication")
#: Classes of the cells of a detail panel; the second prefix is that of the full page.
DETAIL_CELL = "gsc_(?:vcd|oci)_{}"
_DIV = r"<div[^>]*class=\"[^\"]*\b{0}\b[^\"]*\"[^>]*>(.*?)</div>"


def node_text(html: Column) -> Column:
    """Text of a node: year suffixes and labels put in earlier are dropped, tags and white space reduced."""
    bare = F.regexp_replace(html, r'(?s)<span[^>]*class="[^"]*(?:gs_oph|sr-row)[^"]*"[^>]*>.*?</span>', "")
    return F.call_function("trim", F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]+>", ""), "&nbsp;", " "), f"{T.S}+", " "))


def _blocks(html: Column, cls: str) -> Column:
    return F.regexp_extract_all(html, F.lit("(?s)" + _DIV.format(cls)), F.lit(1))


def profile_rows(pages: DataFrame) -> DataFrame:
    """page_id, row_ord, raw: the second grey line of each row, or the first if it is alone."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<tr[^>]*class="[^"]*gsc_a_tr[^"]*"[^>]*>(.*?)</tr>'), F.lit(1))).alias("row_ord", "row"))
    grey = _blocks(F.col("row"), "gs_gray")
    venue = F.when(F.size("grey") >= 2, F.get("grey", F.lit(1))).otherwise(F.get("grey", F.lit(0)))
    return rows.select("page_id", "row_ord", grey.alias("grey")).select("page_id", "row_ord", node_text(venue).alias("raw")).where("raw is not null")


def search_rows(pages: DataFrame) -> DataFrame:
    """page_id, row_ord, pos, raw: candidate venues of each byline."""
    lines = pages.select("page_id", F.posexplode(_blocks(F.col("html"), "gs_a")).alias("row_ord", "line")).select("page_id", "row_ord", node_text(F.col("line")).alias("line"))
    return lines.select("page_id", "row_ord", F.expr(f"posexplode({C.venues_from_byline('line')})").alias("pos", "raw"))


def detail_rows(pages: DataFrame) -> DataFrame:
    """page_id, row_ord, field, raw: values whose field names a venue."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<div[^>]*class="[^"]*gs_scl[^"]*"[^>]*>(.*?</div>.*?</div>)'), F.lit(1))).alias("row_ord", "row"))
    cell = lambda c: node_text(F.get(_blocks(F.col("row"), c), F.lit(0)))
    return rows.select("page_id", "row_ord", F.lower(cell(DETAIL_CELL.format("field"))).alias("field"), cell(DETAIL_CELL.format("value")).alias("raw")).where(F.col("field").isin(list(DETAIL_FIELDS)))


def allowed_pages(pages: DataFrame, hosts: tuple[str, ...] = T.HOSTS) -> DataFrame:
    """Pages whose url is on an allowed host."""
    return pages.where(T.host_allowed("url", hosts))


def clear_labels(html: Column) -> Column:
    """The html without lines of labels put in earlier, so that it can be annotated again."""
    return F.regexp_replace(html, r'(?s)<span[^>]*class="[^"]*\bsr-row\b[^"]*"[^>]*>(?:<span[^>]*>[^<]*</span>)*</span>', "")


def label_html(labels: Column) -> Column:
    """The labels as one line of spans, to be put beside a node."""
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit('<span class="sr-badge '), x["cls"], F.lit('">'), x["text"], F.lit("</span>"))), "")

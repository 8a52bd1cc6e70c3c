"""Pages to labels in one call: scan the places that are switched on, look the venues up, keep the first that has labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import pages as P
from ..sources.tables import stored
from .labels import labels
from .match import Catalogs, lookup
from .settings import PLACES, label_switches, settings


def page_venues(pages: DataFrame, overrides: dict | None = None) -> DataFrame:
    """page_id, place, row_ord, pos, raw of every venue string in the places that the settings switch on."""
    on = settings(overrides)
    scans = {"profile": P.profile_rows(pages).withColumn("pos", F.lit(0)), "search": P.search_rows(pages), "detail": P.detail_rows(pages).withColumn("pos", F.lit(0))}
    kept = [scans[p].select("page_id", F.lit(p).alias("place"), "row_ord", "pos", "raw") for p, switch in PLACES.items() if on["enabled"] and on[switch]]
    out = scans["profile"].where("false").select("page_id", F.lit("").alias("place"), "row_ord", "pos", "raw")
    for df in kept:
        out = out.unionByName(df)
    return out.where(F.expr(f"{T.trim(T.text('raw'))} <> ''"))


def annotate_pages(pages: DataFrame, catalogs: Catalogs, overrides: dict | None = None) -> DataFrame:
    """page_id, html -> page_id, place, row_ord, raw, labels: one row a line that has any label, by its first candidate that has."""
    venues = stored(page_venues(pages, overrides).withColumn("key", F.expr(T.trim(T.text("raw")))), "page-venues")
    found = lookup(venues.select(F.col("key").alias("raw")), catalogs).select(F.col("raw").alias("key"), labels(label_switches(settings(overrides))).alias("labels"))
    rows = venues.join(found, "key").where(F.size("labels") > 0)
    return rows.groupBy("page_id", "place", "row_ord").agg(F.min_by(F.struct("raw", "labels"), "pos").alias("b")).select("page_id", "place", "row_ord", "b.*")

"""SQL functions: the same text as the DataFrame code, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import candidates as C
from . import text as T

FUNCTIONS = {
    "normalize_name": (T.normalize_name, "STRING"),
    "classify_venue": (T.classify, "STRING"),
    "preprint_source": (T.preprint_source, "STRING"),
    "strip_wrappers": (T.strip_wrappers, "STRING"),
    "strip_trailing_numerics": (T.strip_trailing_numerics, "STRING"),
    "venues_from_byline": (C.venues_from_byline, "ARRAY<STRING>"),
    "venue_candidates": (C.venue_candidates, "STRUCT<kind: STRING, truncated: BOOLEAN, preprint_name: STRING, names: ARRAY<STRING>, acronyms: ARRAY<STRING>>"),
    "name_tokens": (T.tokens_of, "ARRAY<STRING>"),
    "rank_text": (T.rank_text, "STRING"),
    "zone_of": (T.zone_of, "INT"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the temporary SQL functions and a table function of candidate names; returns their names."""
    for name, (body, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body('s')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION candidate_names(s STRING) RETURNS TABLE(pos INT, name STRING) RETURN SELECT pos, name FROM (SELECT posexplode({C.candidate_names('s')}) AS (pos, name))")
    return [*FUNCTIONS, "candidate_names"]

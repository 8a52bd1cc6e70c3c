"""The driver contract, and the SQL functions."""

import importlib
import sys

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
CHEAP = ["sf2_normalize_key", "sf6_strip_wrappers", "sf9_strip_numerics", "fp1_classify", "sf20_rank_text", "sm1_numbers", "ag1_candidates", "ag5_acronyms", "ag9_byline", "jn6_containment", "jn7_alias_targets", "jn9_alias_acronyms", "index_volume", "jn11_missing_alias", "venue_prefixes", "lookup_volume", "agg1_journal_merge", "agg4_journal_counts", "agg5_source_counts", "wn4_first_labelled", "agg7_intersection", "sc5_csv_cells", "sc7_core_rows", "sc8_html_rows", "sc14_page_scans", "annotate_pages", "sm7_host_filter", "sm7_known_hosts", "sf14_page_text", "sm5_presentation", "ss_microbatch"]


def rows(table):
    cols = sorted(table.column_names)
    return sorted(repr([r[c] for c in cols]) for r in table.select(cols).to_pylist())


@pytest.mark.parametrize("name", CHEAP)
def test_oracle(spark, name):
    from citeforge.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "nation", "events", "documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DIR).toArrow()) == rows(con.execute(ORACLES[name]).to_arrow_table())


def test_entry_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("citeforge.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "citeforge.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import citeforge

    if hasattr(citeforge, "llm"):
        monkeypatch.delattr(citeforge, "llm")
    entry = importlib.import_module("__spark_entry__")
    assert "venue_lookup" in entry.queries() and "pipeline" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_sql_functions(spark):
    from citeforge.functions.register import register_functions

    assert "normalize_name" in register_functions(spark)
    assert spark.sql("SELECT normalize_name('J. of the ＡＢ Syst. & ﬁeld')").first()[0] == "journalabsystemsfield"
    assert [r.name for r in spark.sql("SELECT * FROM candidate_names('A B C, 2020') ORDER BY pos").collect()] == ["A B C", "A B C, 2020"]

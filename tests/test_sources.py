"""Scans, the journal merge, the sink and the stream on small files."""

import pytest
from pyspark.sql import functions as F

from citeforge.operators.catalog import journal_counts, merge_journals, rank_counts, source_counts
from citeforge.sources import files, pages

CAS = '﻿Journal,ISSN/EISSN,Web of Science,大类,大类分区,Top,小类1,小类1分区\r\n"Alpha, the ""Journal""",1234-5678/8765-432x,SCIE,工程,3 [1/9],是,ENG 工程：综合,2\r\nBeta\r\n"Gamma\nLetters",bad,,,,否,,\r\n,,,\r\nALPHA the Journal,,SSCI,,1,,,\r\n'


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_csv(spark, tmp_path):
    got = [r.cells for r in files.read_csv_objects(spark, put(tmp_path, "cas.csv", CAS)).orderBy("ord").collect()]
    assert [g["Journal"] for g in got] == ['Alpha, the "Journal"', "Gamma\nLetters", "ALPHA the Journal"]
    assert got[0]["小类1"] == "ENG 工程：综合" and got[2]["小类1分区"] == ""
    twice = files.read_csv_objects(spark, put(tmp_path, "twice.csv", "a,b,a\n1,2,3\n")).first()
    assert twice.cells == {"b": "2", "a": "3"} and twice.second == "2"


def test_core(spark, tmp_path):
    rows = files.read_core(spark, put(tmp_path, "core.csv", '1,"Conf, of X",CX,ICORE,a*,Yes,4611,CSE,zz\n2,Short,row\n3,Y,,S,national: China,No,,\n4,,N,S,A,No\n')).orderBy("ord").collect()
    assert [(r.abbr, r.name, r["rank"], r.field, r.rank_raw) for r in rows] == [("CX", "Conf, of X", "A*", "机器学习/计算机科学与工程（旧分类）/zz", "a*"), ("", "Y", "National", "", "national: China")]
    with pytest.raises(ValueError):
        files.read_core(spark, put(tmp_path, "none.csv", "a,b\n"))


def test_ccf(spark, tmp_path):
    html = '<title>List </title><table><tr class="item"><td>1</td><td>AB</td><td><a href="http://x/y">Name &amp; Co</a></td><td>A</td><td>会议</td><td>f</td></tr><tr class="item"><td>2</td><td>J</td><td>Jour</td><td>B</td><td>期刊</td><td>g</td></tr><tr class="item"><td>3</td><td>Z</td><td>z</td><td>D</td><td>x</td><td>y</td></tr><tr class="item"><td>4</td></tr></table>'
    path = put(tmp_path, "ccf.html", html)
    rows = files.read_ccf(spark, path).orderBy("ord").collect()
    assert [(r.abbr, r.name, r["rank"], r.type, r.url) for r in rows] == [("AB", "Name & Co", "A", "conference", "http://x/y"), ("J", "Jour", "B", "journal", "")]
    assert files.whole_texts(spark, path).select(files.page_title(F.col("text"))).first()[0] == "List"
    assert [(r.type, r["rank"], r.n) for r in rank_counts(files.read_ccf(spark, path), "type", "rank").collect()] == [("conference", "A", 1), ("journal", "B", 1)]


def test_list_json_and_sink(spark, tmp_path):
    md = "# head\n```\nFirst Title\t\t\nab\n# no\nhttp://x\nSecond\n```\nOut\n"
    assert [r.name for r in files.read_title_list(spark, put(tmp_path, "ei.md", md)).orderBy("ord").collect()] == ["First Title", "Second"]
    al = files.read_aliases(spark, put(tmp_path, "a.json", '{"names": {"B": "x", "A": "y"}, "ccfToCore": {"S&P": "SP"}}')).collect()
    assert [(r.kind, r.ord, r.src, r.target) for r in al] == [("names", 0, "B", "x"), ("names", 1, "A", "y"), ("ccf_to_core", 0, "S&P", "SP")]
    tag = files.read_tags(spark, put(tmp_path, "t.json", '{"groups": [{"id": "i", "label": "l", "ccf": ["A"]}]}')).first()
    assert (tag.descr, tag.cls, tag.ccf, tag.names) == ("", "sr-tag-rose", ["A"], [])
    files.write_catalog(spark.createDataFrame(al), str(tmp_path / "out"), "alias", "s", "v1")
    info = files.catalog_info(spark, str(tmp_path / "out"), "alias").first()
    assert (info.catalog, info.version, info.row_count) == ("alias", "v1", 3)


def test_merge(spark):
    cas = spark.createDataFrame([(1, "Alpha", "1234-5678/x", "SCIE", "工程", "3 [1]", "是", "ENG 工程", "2"), (2, "ALPHA", "", "", "", "9", "", "", ""), (3, "  ", "", "", "", "", "", "", "")], "ord int, name string, issns string, wos string, cat string, zone string, top string, sub string, sub_zone string")
    jcr = spark.createDataFrame([(1, "alpha", "10.0", "Q1", "ESCI", "1111-1111", "2222-222x"), (2, "Alpha", "<0.1", "Q9", "", "", ""), (3, "Beta", "0", "Q4", "AHCI", "", "")], "ord int, name string, impact string, quartile string, wos string, issn string, eissn string")
    warn = spark.createDataFrame([(1, "beta", ""), (2, "Delta", "why")], "ord int, name string, reason string")
    ei = spark.createDataFrame([(1, "Alpha"), (2, "Eps")], "ord int, name string")
    got = {r.key: r for r in merge_journals(cas, jcr, warn, ei).collect()}
    a = got["alpha"]
    assert (a.n, a.issn, a.eissn, a.wos, a.cat, a.zone, a.top, a["sub"], a.sub_zone, a.impact, a.quartile, a.ei) == ("ALPHA", "1234-5678", "2222-222X", "SCIE", "工程", 3, 1, "工程", 2, 10.0, "Q1", 1)
    assert (got["beta"].impact, got["beta"].warn, got["delta"].warn, got["eps"].n) == (0.0, "预警", "why", "Eps")
    assert journal_counts(merge_journals(cas, jcr, warn, ei)).first().asDict() == {"n": 4, "n_zone": 1, "n_impact": 2, "n_ei": 2}
    assert {r.source: r.n for r in source_counts(cas=cas, ei=ei).collect()} == {"cas": 2, "ei": 2}


def test_pages(spark):
    profile = '<table><tr class="gsc_a_tr"><td class="gsc_a_t"><a>T</a><div class="gs_gray">A B</div><div class="gs_gray">Nature &nbsp;615<span class="gs_oph">, 2020</span></div></td></tr><tr class="gsc_a_tr"><div class="gs_gray">Only</div></tr></table>'
    search = '<div class="gs_a">J <a href="x">Doe</a>&nbsp;- Nature, 2015&nbsp;- nature.com</div>'
    detail = '<div id="gsc_vcd_table"><div class="gs_scl"><div class="gsc_vcd_field">Journal</div><div class="gsc_vcd_value">Nature</div></div><div class="gs_scl"><div class="gsc_oci_field">Pages</div><div class="gsc_oci_value">1</div></div></div>'
    df = spark.createDataFrame([(1, profile), (2, search), (3, detail)], "page_id long, html string")
    assert [(r.row_ord, r.raw) for r in pages.profile_rows(df).orderBy("row_ord").collect()] == [(0, "Nature 615"), (1, "Only")]
    assert [(r.pos, r.raw) for r in pages.search_rows(df).collect()] == [(0, "Nature")]
    assert [(r.field, r.raw) for r in pages.detail_rows(df).collect()] == [("journal", "Nature")]


def test_catalogs_from_files(spark, tmp_path):
    """The four journal sources, the JSON envelopes and the written Parquet lead to the same lookups."""
    import json

    from citeforge.operators.annotate import annotate_pages
    from citeforge.operators.labels import explain
    from citeforge.operators.match import lookup
    from citeforge.sources import catalogs

    cas = put(tmp_path, "cas.csv", CAS)
    jcr = put(tmp_path, "jcr.csv", "Journal,IF(2025),IF Quartile(2025)_1,Web of Science,ISSN,EISSN\nAlpha the Journal,10.0,Q1,SCIE,,\nOther Letters,0.5,Q9,ESCI,1111-1111,\n")
    warn = put(tmp_path, "warn.csv", "Journal,why\nOther Letters,高风险\n")
    ei = put(tmp_path, "ei.md", "```\nAlpha, the Journal\t\n```\n")
    built = catalogs.build_journals(spark, cas, jcr, warn, ei)
    got = {r.key: r for r in built.collect()}
    assert (got["alphajournal"].zone, got["alphajournal"].impact, got["alphajournal"].ei, got["alphajournal"]["sub"]) == (1, 10.0, 1, "工程：综合")
    assert (got["otherletters"].warn, got["otherletters"].quartile, got["otherletters"].issn) == ("高风险", None, "1111-1111")

    def envelope(name, entries):
        return put(tmp_path, name, json.dumps({"source": "s", "version": "v7", "generatedAt": "2025-01-02", "count": len(entries), "entries": entries}))

    ccf = envelope("ccf.json", [{"abbr": "ABC", "name": "Conference on Alpha Beta Computing", "rank": "A", "type": "conference", "field": "f", "url": ""}])
    core = envelope("core.json", [{"abbr": "ABC", "name": "Conference on Alpha Beta Computing", "rank": "A*", "source": "C1", "field": "", "rankRaw": "a*"}])
    journals = put(tmp_path, "journals.json", json.dumps({"count": 1, "journals": {"alphajournal": {"n": "Alpha, the Journal", "cat": "工程", "zone": 1, "top": 1, "sub": ["综合", 2], "if": 10.0, "q": "Q1", "ei": 1}}}))
    aliases = put(tmp_path, "aliases.json", json.dumps({"names": {"Alpha Beta Meeting": "ABC"}, "acronyms": {}, "coreNames": {}, "ccfToCore": {}}))
    tags = put(tmp_path, "tags.json", json.dumps({"groups": [{"id": "t", "label": "Top Four", "ccf": ["ABC"]}]}))
    assert catalogs.envelope_info(spark, ccf).first().asDict() == {"source": "s", "version": "v7", "generated_at": "2025-01-02", "row_count": 1}
    out = str(tmp_path / "written")
    for name, df in {"ccf": catalogs.read_entries(spark, ccf, "ccf"), "core": catalogs.read_entries(spark, core, "core"), "journals": catalogs.read_journals(spark, journals), "aliases": files.read_aliases(spark, aliases), "tags": files.read_tags(spark, tags)}.items():
        files.write_catalog(df, out, name, "s", "v7")
    raws = spark.createDataFrame([("Alpha Beta Meeting, 2020, 1-5",), ("Alpha, the Journal 3 (2), 1",), ("2019 Conference on Alpha Beta Computing (ABC)",)], "raw string")
    told = []
    for c in (catalogs.load_json(spark, ccf, core, journals, aliases, tags), catalogs.load_catalogs(spark, out)):
        told.append(sorted((r.raw, r.labels) for r in explain(lookup(raws, c)).collect()))
        assert c.prefixes is not None
    assert told[0] == told[1] and told[0] == [("2019 Conference on Alpha Beta Computing (ABC)", "Top Four CCF A CORE A*"), ("Alpha Beta Meeting, 2020, 1-5", "Top Four CCF A CORE A*"), ("Alpha, the Journal 3 (2), 1", "工程TOP EI检索 SCI升级版 工程1区 IF 10")]
    page = spark.createDataFrame([(1, '<div class="gs_a">A&nbsp;- Alpha Beta Meeting, 2020&nbsp;- x.org</div><div class="gs_a"> </div>'), (2, None)], "page_id long, html string")
    assert [(r.place, r.raw, [x.text for x in r.labels]) for r in annotate_pages(page, c).collect()] == [("search", "Alpha Beta Meeting", ["Top Four", "CCF A", "CORE A*"])]
    assert annotate_pages(page, c, {"enabled": False}).count() == annotate_pages(page, c, {"showOnSearch": "off"}).count() == 0


def test_settings():
    from citeforge.operators import settings as S

    assert len(S.DEFAULTS) == 18 and S.settings() == S.DEFAULTS
    got = S.settings({"showJcr": "true", "badgeScale": "120", "theme": "none", "boldBadges": 1, "showEi": None})
    assert (got["showJcr"], got["badgeScale"], got["theme"], got["boldBadges"], got["showEi"]) == (True, 120, "soft", True, True)
    assert S.style(got) == {"class": "sr-row sr-theme-soft sr-bold", "style": "font-size:13.2px"} and S.style(S.DEFAULTS)["style"] == ""
    assert S.from_query("?theme=mono&showIf=0&other=1") == S.DEFAULTS | {"theme": "mono", "showIf": False}
    assert S.changed({}, {"theme": "mono"}) == ["theme"] and S.label_switches(S.DEFAULTS)["jcr"] is False
    with pytest.raises(ValueError):
        S.settings({"nothing": 1})
    with pytest.raises(ValueError):
        S.settings({"showIf": "perhaps"})


def test_text_to_the_end(spark):
    from citeforge.functions import text as T

    many = "Journal of X, " + ", ".join(map(str, range(1, 40)))
    rows = spark.createDataFrame([(many,), ("Foo (12 abc 5)",), ("Bar 30 (6), vol. 3 no. 4, 351-360",), ("",), (None,), ("2020",)], "x string")
    assert [r[0] for r in rows.selectExpr(T.strip_trailing_numerics("x")).collect()] == ["Journal of X", "Foo (12 abc", "Bar", "", "", "2020"]
    forms = spark.createDataFrame([("ⓐ𝐁㏂½ﬁ№ＡＢ é x",)], "x string")
    assert forms.selectExpr(T.deburr("x")).first()[0] == "aBa.m.1⁄2fiNoAB e x"
    hosts = spark.createDataFrame([("https://scholar.google.de/a",), ("https://scholar.google.xx/a",), ("https://a.b.example.org/",), ("http://scholar.google.de/",), (None,)], "u string")
    assert [r[0] for r in hosts.selectExpr(T.host_allowed("u")).collect()] == [True, False, False, False, False]
    assert [r[0] for r in hosts.selectExpr(T.host_allowed("u", ("*.example.org",))).collect()] == [False, False, True, False, False]
    assert spark.range(1).selectExpr(T.megabytes("cast(1572864 as long)")).first()[0] == "1.50 MB"
    page = '<b>x</b><span class="sr-row sr-theme-soft"><span class="sr-badge sr-if">IF 1</span></span><i>y</i>'
    assert spark.createDataFrame([(page,)], "h string").select(pages.clear_labels(F.col("h"))).first()[0] == "<b>x</b><i>y</i>"
    labels = spark.sql("SELECT array(named_struct('cls', 'sr-if', 'text', 'IF 1')) AS l").select(pages.label_html(F.col("l"))).first()[0]
    assert labels == '<span class="sr-badge sr-if">IF 1</span>'


def test_unmatched_marker_and_switches(spark):
    from citeforge.operators.labels import labels
    from citeforge.operators.match import lookup
    from citeforge.seed import catalogs

    found = lookup(spark.createDataFrame([("Unknown Gazette",), ("Nature 615 (7951), 234-240",), ("PhD thesis, X",)], "raw string"), catalogs(spark))
    told = lambda s: {r.raw: [(x.key, x.text) for x in r.l] for r in found.select("raw", labels(s).alias("l")).collect()}
    assert told({})["Unknown Gazette"] == [] and told({"unmatched": True})["Unknown Gazette"] == [("unmatched", "未收录")]
    assert [k for k, _ in told({"top": False, "cas": False, "jcr": True})["Nature 615 (7951), 234-240"]] == ["jcr", "if"] and told({"unmatched": True})["PhD thesis, X"] == []


def test_stream_errors_and_lateness(spark, tmp_path):
    from citeforge.seed import catalogs
    from citeforge.streaming.annotate import annotate, drain

    src, schema = str(tmp_path / "in"), "page_id long, node_id int, raw string"
    spark.createDataFrame([(1, 1, "Nature")], schema).write.parquet(src)
    told = []
    broken = catalogs(spark)
    broken.journals = broken.journals.drop("n")
    annotate(spark.readStream.schema(schema).parquet(src), broken, str(tmp_path / "out"), str(tmp_path / "cp"), on_error=lambda i, e: told.append((i, type(e).__name__)), trigger={"availableNow": True}).awaitTermination()
    assert len(told) == 1 and told[0][0] == 0
    timed = "id long, ts timestamp"
    spark.sql("SELECT id, timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(5) UNION ALL SELECT id, timestamp'2025-01-01' FROM range(5)").write.parquet(str(tmp_path / "t"))
    assert drain(spark, str(tmp_path / "t"), timed, ["id"], "ts").count() == 5


def test_stream(spark, tmp_path):
    from citeforge.seed import catalogs
    from citeforge.streaming.annotate import annotate, drain

    src = str(tmp_path / "in")
    schema = "page_id long, node_id int, raw string"
    rows = [(1, 1, "Nature 615 (7951), 234-240"), (1, 1, "Nature 615 (7951), 234-240"), (1, 2, "arXiv preprint arXiv:1")]
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    annotate(stream, catalogs(spark), str(tmp_path / "out"), str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
    got = {r.node_id: [x.text for x in r.labels] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2] == ["arXiv"] and "综合性期刊TOP" in got[1] and len(got) == 2
    assert drain(spark, src, schema, ["page_id", "node_id"]).count() == 2

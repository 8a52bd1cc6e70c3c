"""Golden venue strings on the synthetic seed."""

import pytest

from citeforge.functions import candidates as C
from citeforge.operators.labels import first_with_labels, labels
from citeforge.operators.match import lookup
from citeforge.plans.samples import BYLINES, CASES, FORBIDDEN, FUZZY, NEGATIVE, VENUES
from citeforge.seed import catalogs


@pytest.fixture(scope="module")
def seed(spark):
    return catalogs(spark)


@pytest.fixture(scope="module")
def found(spark, seed):
    rows = lookup(spark.createDataFrame([(v,) for v in VENUES], "raw string"), seed)
    return {r.raw: r for r in rows.withColumn("labels", labels()).collect()}


def texts(row):
    return [x.text for x in row.labels]


@pytest.mark.parametrize("raw,expected", CASES + FUZZY)
def test_labels(found, raw, expected):
    got = texts(found[raw])
    assert [e for e in expected if not any(t.startswith(e) for t in got)] == [], got


@pytest.mark.parametrize("raw", NEGATIVE)
def test_no_label(found, raw):
    assert texts(found[raw]) == []


@pytest.mark.parametrize("raw,banned", FORBIDDEN)
def test_forbidden(found, raw, banned):
    assert [t for t in texts(found[raw]) if any(t.startswith(b) for b in banned)] == []


def test_bylines(spark, seed):
    lines = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BYLINES)], "line_id int, line string")
    venues = lines.selectExpr("line_id", f"posexplode({C.venues_from_byline('line')}) as (pos, raw)")
    found = lookup(venues.select("raw"), seed).withColumn("labels", labels()).select("raw", "labels")
    got = {r.line_id: texts(r) for r in first_with_labels(venues.join(found, "raw")).collect()}
    for i, (_, expected) in enumerate(BYLINES):
        assert all(any(t.startswith(e) for t in got.get(i, [])) for e in expected), (i, got.get(i))
        assert expected or i not in got


def test_order_and_number(found):
    got = texts(found["Multimedia Systems 30 (6), 351"])
    assert got == ["CCF C", "EI检索", "SCI升级版 计算机科学4区", "IF 3.1"]
    assert "IF 10" in texts(found["IEEE Internet of Things Journal 11 (3), 4000-4012"])


def test_missing_aliases(seed):
    assert sorted((r.kind, r.src) for r in seed.index.missing.collect()) == [("acronyms", "NIL"), ("core_names", "Workshop on Nothing"), ("names", "Conference on Nothing at All")]


def test_collision_goes_to_the_closest_name(seed):
    r = seed.index.keys.where("catalog = 'ccf' and key like 'acmsigsoft%foundations%'").collect()
    name = seed.index.entries.where(f"catalog = 'ccf' and ord = {r[0].ord}").first().name
    assert name == "ACM International Conference on the Foundations of Software Engineering"


def test_containment_of_names_with_doubled_words(spark):
    from citeforge.operators.match import containment_pairs

    left = spark.createDataFrame([("a", ["web", "and", "services", "workshop"]), ("b", ["web", "of", "things", "today"]), ("c", ["web", "services"])], "l string, tokens array<string>")
    right = spark.createDataFrame([("doubled", ["web", "services"]), ("whole", ["web", "of", "things", "today", "again"])], "r string, tokens array<string>")
    got = sorted((x.l, x.r, x.score) for x in containment_pairs(left, right, 0.85, 4).collect())
    assert got == [("a", "doubled", 1.0), ("b", "whole", 1.0)]

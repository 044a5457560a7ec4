"""Facet index, label automaton and given filters against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import automaton, facets, filters

DOCS = "doc_id long, policy_areas array<string>, country_region string, source_organisation string, language string, keywords array<string>, year int"
FILTERS = "query_id long, policy_areas array<string>, country_regions array<string>, source_organisations array<string>, languages array<string>, tags array<string>, year_from int, year_to int, freshness boolean"


def plain_matches(d, f):
    low = lambda values: {v.lower() for v in values or [] if v is not None}
    _, areas, region, org, lang, keywords, year = d
    _, fa, fr, fo, fl, ft, y0, y1, _ = f
    if not (fa or fr or fo or fl or ft or y0 is not None or y1 is not None):
        return False
    for want, have in ((fa, areas), (fr, [region]), (fo, [org]), (fl, [lang])):
        if want and not low(want) & low(have):
            return False
    return low(ft) <= low(keywords) and not (y0 is not None and (year is None or year < y0)) and not (y1 is not None and (year is None or year > y1))


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_hits_equal_plain_code(spark):
    rng = random.Random(1)
    some = lambda n, values: rng.sample(values, rng.randrange(n))
    docs = [(i, rng.choice([None, some(3, ["A", "b", "C"]), ["a", "A", None]]), rng.choice(["X", "y", None, ""]), rng.choice(["O", None]), rng.choice(["en", "EN", "fr"]), rng.choice([None, some(4, ["t", "U", "v"])]), rng.choice([None, 1990, 2000, 2010, 2011])) for i in range(300)]
    asked = [(i, some(3, ["a", "B", "z"]), some(2, ["x", "Y"]), some(2, ["o"]), some(2, ["EN", "de"]), some(3, ["T", "u", "w"]), rng.choice([None, None, 1980, 2005]), rng.choice([None, None, 2005, 3000, 1900]), False) for i in range(250)]
    asked += [(1000, [], [], [], [], [], 2_000_000_000, None, True), (1001, [], [], [], [], [], None, -5, True), (1002, [], [], [], [], [], 2011, 1990, True)]
    index = facets.FacetIndex(spark.createDataFrame(docs, DOCS))
    assert pairs(facets.hits(spark.createDataFrame(asked, FILTERS), index)) == {(f[0], d[0]) for d in docs for f in asked if plain_matches(d, f)}
    plan = facets.hits(spark.createDataFrame(asked, FILTERS), index)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hits_fetch_the_rarest_part_only(spark):
    docs = [(i, ["common"], "rare" if i < 3 else "X", "o", "en", ["t"], 2000) for i in range(500)]
    index = facets.FacetIndex(spark.createDataFrame(docs, DOCS))
    asked = spark.createDataFrame([(0, ["common"], ["rare"], [], ["en"], ["t"], None, None, False)], FILTERS)
    parts = facets.wanted(asked, index).join(index.counts, ["dimension", "value"]).collect()
    assert {(p.part, p.n) for p in parts} == {("policy_areas", 500), ("country_regions", 3), ("languages", 500), ("tags:t", 500)}
    assert pairs(facets.hits(asked, index)) == {(0, 0), (0, 1), (0, 2)}


def test_no_documents_and_no_years(spark):
    asked = spark.createDataFrame([(0, [], [], [], [], [], 1990, 2000, False), (1, ["a"], [], [], [], [], None, None, False)], FILTERS)
    assert pairs(facets.hits(asked, facets.FacetIndex(spark.createDataFrame([], DOCS)))) == set()
    assert pairs(facets.hits(asked, facets.FacetIndex(spark.createDataFrame([(1, ["A"], None, None, None, None, None)], DOCS)))) == {(1, 1)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_automaton_finds_all_overlapping_labels(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abé法", k=rng.randrange(1, n)))
    labels = [(f"l{i % 40}", word(5)) for i in range(60)] + [("none", ""), (None, "a")]
    rows = [(i, str(i % 3), word(40) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, other string, body string").withColumn("label", F.lit("clash"))
    got = pairs(automaton.contained(df, ["id", "other"], F.col("body"), spark.createDataFrame(labels, "label string, pattern string")))
    assert got == {(i, o, name) for i, o, b in rows if b for name, p in labels if p and name and p in b}


def test_automaton_checks_its_bound(spark):
    labels = spark.createDataFrame([("a", "abcde")], "label string, pattern string")
    rows = spark.createDataFrame([(1, "xabcdex")], "id long, body string")
    assert pairs(automaton.contained(rows, ["id"], F.col("body"), labels, 5)) == {(1, "a")}
    with pytest.raises(ValueError):
        automaton.contained(rows, ["id"], F.col("body"), labels, 4)
    assert automaton.contained(rows, ["id"], F.col("body"), labels.limit(0)).collect() == []


def test_given_filters_come_first_and_switch_years_off(spark):
    labels = spark.createDataFrame([("policy_areas", "Climate Adaptation"), ("country_regions", "Australia"), ("country_regions", "China"), ("source_organisations", "World Bank"), ("languages", "English")], "dimension string, value string")
    asked = [(0, "Australia documents before 2016 by the WORLD BANK, tag: coast"), (1, "latest since 2001 in China"), (2, "files in english after 2010"), (3, "plain"), (4, "中国 2001")]
    given = [(0, "Climate adaptation ", "china", None, "French", ["Coast", "reef", " "], 2001, None), (1, None, "CHINA", "WHO", None, None, None, 2020), (3, " ", None, None, "english", [], None, None)]
    q = spark.createDataFrame(asked, "query_id long, question string")
    g = spark.createDataFrame(given, "query_id long, policy_area string, country_or_region string, source_organisation string, language string, tags array<string>, published_year_from int, published_year_to int")
    r = {x.query_id: x for x in filters.infer(q, labels, 2024, g).collect()}
    assert (r[0].policy_areas, r[0].country_regions, r[0].source_organisations) == (["Climate adaptation"], ["china", "Australia"], ["World Bank"])
    assert (r[0].languages, r[0].tags, r[0].year_from, r[0].year_to) == (["French"], ["Coast", "reef"], 2001, None)
    # one given year leaves the question's unread; freshness still sets the first
    assert (r[1].country_regions, r[1].source_organisations, r[1].year_from, r[1].year_to, r[1].freshness) == (["CHINA"], ["WHO"], 2019, 2020, True)
    assert (r[2].languages, r[2].year_from, r[2].year_to) == (["English"], 2011, None)
    assert (r[3].policy_areas, r[3].languages, r[3].tags) == ([], ["english"], [])
    assert (r[4].country_regions, r[4].year_from, r[4].year_to) == (["China"], 2001, 2001)
    some = {x.query_id: x for x in filters.infer(q, labels, 2024, g.select("query_id", "published_year_to")).collect()}
    assert (some[0].country_regions, some[0].year_from, some[0].year_to) == (["Australia"], None, 2015)


def test_missing_regions(spark):
    asked = spark.createDataFrame([(0, "Australia"), (0, "China"), (0, "France"), (1, "Mali"), (1, "Chad"), (2, "Oz")], "query_id long, region string")
    cited = spark.createDataFrame([(0, 1, "of 中国 only"), (0, 2, None), (1, 1, "about MALI"), (1, 3, "france"), (2, 1, "oz oz")], "query_id long, doc_id long, text string")
    docs = spark.createDataFrame([(1, "Australia"), (2, None), (3, "Niger")], "doc_id long, country_region string")
    assert pairs(filters.missing_regions(asked, cited, docs)) == {(0, "France"), (1, "Chad"), (2, "Oz")}

from creditloom.operators import research


def test_flatten_research_without_cuts(spark):
    replies = spark.createDataFrame([(1, '{"long": "' + "z" * 900 + '"}'), (2, "y" * 1200)], "company_id int, reply string")
    assert {r.company_id: len(r.content) for r in research.flatten_research(replies).collect()} == {1: 900, 2: 1200}
    cut = research.flatten_research(replies, research.LABEL_CHARS, research.FINDINGS_CHARS).collect()
    assert {r.company_id: len(r.content) for r in cut} == {1: 800, 2: 1000}

from sitegauge.llm import near_dedup


def test_texts_without_a_shared_bucket_are_filtered_before_they_are_shuffled(spark, monkeypatch):
    texts = spark.range(-1000, 20_000).selectExpr("id", "concat('text ', id) as text")
    ids = spark.range(-1000, 20_000, 50).select("id")
    kept = near_dedup._perhaps(texts, ids)
    assert kept.columns == ["id", "text"]
    found = [r.id for r in kept.select("id").collect()]
    assert set(found) >= set(range(-1000, 20_000, 50)) and len(found) == len(set(found)) < 500
    plan = kept.join(ids, "id")._jdf.queryExecution().optimizedPlan().toString()
    # the filter is joined with the texts first, below the join with the ids
    assert plan.index("_piece") > plan.index("Join Inner, (id#")
    monkeypatch.setattr(near_dedup, "FILTER_BITS", 8)
    assert {r.id for r in near_dedup._perhaps(texts, ids).select("id").collect()} >= set(range(-1000, 20_000, 50))

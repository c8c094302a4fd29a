from sitegauge.operators.features import page_features
from sitegauge.operators.issues import page_issues
from sitegauge.streaming.page_audit import read_crawl_stream, write_issue_stream


def test_stream_equals_batch(spark, crawl, tmp_path):
    pages = crawl(*[{"html": "<p><img>" * (i % 3), "load_time": float(i)} for i in range(12)])
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    query = write_issue_stream(read_crawl_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    batch = page_issues(page_features(pages))
    got = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))

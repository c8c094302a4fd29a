import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sitegauge.llm import sharding


def shard_of(key, weights):
    """Brute force: the shard of the highest score."""
    best = None
    for i, weight in enumerate(weights):
        if weight > 0:
            u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            if best is None or math.log(u) / weight > best[0]:
                best = (math.log(u) / weight, i)
    return best[1]


ROWS = [(1, "one"), (2, None), (3, ""), (4, "ü" * 40000), (None, "no id"), (None, None), (None, "no id"),
        (5, "same id"), (5, "same id"), (5, "other text"), *[(i, f"text {i % 7}") for i in range(10, 400)]]


def expected(rows, n):
    out, of_shard = [], defaultdict(list)
    for doc_id, text in rows:
        data = (text or "").encode()
        key = "-" if doc_id is None else doc_id
        of_shard[shard_of(key, [1.0] * n)].append(
            ((doc_id is not None, doc_id or 0), zlib.crc32(data), len(data) + 1, doc_id, shard_of(key, [1.0] * (n + 1))))
    for shard, held in of_shard.items():
        for slot, (_, crc, size, doc_id, grown) in enumerate(sorted(held, key=lambda r: r[:3])):
            out.append((doc_id, size, crc, "key", shard, slot, grown))
    return sorted(out, key=repr)


def test_against_brute_force(docs_of):
    docs = docs_of(*ROWS).withColumn("shard", F.lit("mine")).withColumn("key", F.lit(7)).repartition(3)
    got = sharding.shards(docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(ROWS, 16)
    assert sharding.shards(docs.where("false")).collect() == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    records = spark.range(20000).toDF("doc_id")
    moved = sharding.moves(records, [1.0] * 16, [1.0] * 17).collect()
    assert {r.to_shard for r in moved} == {16}
    assert abs(len(moved) - 20000 / 17) < 5 * math.sqrt(20000 / 17)


def test_weights(spark):
    records = spark.range(20000).toDF("doc_id")
    weights = [1.0, 2.0, 0.0, 5.0]
    held = Counter(r.shard for r in sharding.assign(records, weights).collect())
    assert held[2] == 0
    for shard, weight in enumerate(weights):
        assert abs(held[shard] - 20000 * weight / 8) < 5 * math.sqrt(20000)
    some = {r.doc_id: r.shard for r in sharding.assign(records.where("doc_id < 50"), weights).collect()}
    assert some == {i: shard_of(i, weights) for i in range(50)}
    # a heavier shard only gains, a lighter one only loses
    assert {r.to_shard for r in sharding.moves(records, weights, [1.0, 3.0, 0.0, 5.0]).collect()} == {1}
    assert {r.from_shard for r in sharding.moves(records, weights, [1.0, 2.0, 0.0, 4.0]).collect()} == {3}


def test_one_key_for_all_rows_is_numbered_in_many_tasks(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shards(docs.repartition(8))
    assert sorted(r.slot for r in got.collect()) == list(range(5000))


def test_written_shards(spark, docs_of, tmp_path):
    sharding.write_shards(docs_of(*ROWS), str(tmp_path / "out"), [1.0] * 4)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in read.collect() if r.doc_id and r.doc_id > 9) == [
        (i, f"text {i % 7}") for i in range(10, 400)]
    assert all(r.shard == shard_of("-" if r.doc_id is None else r.doc_id, [1.0] * 4) for r in read.collect())


def test_plan_has_no_python(docs_of):
    plan = sharding.shards(docs_of((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import math

from pyspark.sql import functions as F

from pagegrain.llm import mixing
from tests.llm.conftest import CLASHING, EDGE


def test_rates_are_met(spark, docs_of):
    docs = docs_of([(d, "t", "en", "big" if d % 10 else "small") for d in range(4000)])
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=8000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 6000) < 6 * math.sqrt(6000) and abs(n["big"] - 2000) < 6 * math.sqrt(2000)
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "small": 3.0}, total=8000)
    key = lambda df: sorted((r.doc_id, r.copy, r.mix_key) for r in df.collect())
    assert key(out) == key(again) != key(mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=8000, seed=1))


def test_counts_are_poisson(docs_of):
    docs = docs_of([(d, "t") for d in range(5000)])
    times = {r.doc_id: r.n for r in mixing.mix(docs, {"s": 1.0}, total=10_000).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for k in range(6):
        share = sum(times.get(d, 0) == k for d in range(5000)) / 5000
        assert abs(share - math.exp(-2) * 2**k / math.factorial(k)) < 0.03


def test_large_rates(docs_of):
    n = mixing.mix(docs_of([(1, "t"), (2, "u")]), {"s": 1.0}, total=4000).count()
    assert abs(n - 4000) < 6 * math.sqrt(4000)


def test_edges(docs_of, spark):
    docs = docs_of([*EDGE, (60, "no source")], CLASHING).withColumn("source", F.when(F.col("doc_id") < 6, F.col("source")))
    out = mixing.mix(docs, alpha=1.0, total=200)
    assert {c for c in out.columns} == set(docs.columns) and out.filter("copy < 0").count() == 0 and out.filter("source is null").count() > 0
    same = out.filter("doc_id = 4").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in same)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, {}).count() == 0 and mixing.mix(docs, {"other": 1.0}).count() == 0


def test_every_internal_name_passes_through(docs_of):
    names = ["own", "rate", "pieces", "cdf", "_source", "_who", "_u", "_n", "u", "n", "who", "of", "w", "P", "c"]
    plain = {(r.doc_id, r.copy, r.mix_key) for r in mixing.mix(docs_of([(d, "t") for d in range(50)])).collect()}
    out = mixing.mix(docs_of([(d, "t") for d in range(50)], [(c, f"mine {c}") for c in names])).collect()
    assert {(r.doc_id, r.copy, r.mix_key) for r in out} == plain and all(r[c] == f"mine {c}" for r in out for c in names)

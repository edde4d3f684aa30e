"""Operator 7: mixing sources to target weights by Poisson replication.

Each source has a target share of ``total`` rows, hence a repetition rate (target rows by rows). A
document's number of copies is the Poisson variate of that rate at a uniform number drawn from a
hash of (seed, document): the same seed gives the same mixture, whatever the partitioning. Copies are
then dealt to partitions and sorted by a random key, which is a global shuffle: row order within a
part file and the part a row lies in are both random. Only DataFrame functions are used.

A rate over ``PIECE`` is drawn as a sum of independent pieces, so that exp(-rate) keeps its precision.

Cases: a null source is a source of its own. A null text is replicated like any other; a null doc_id
draws by its text. Repeated rows get equal numbers of copies. A source without a weight, or with
weight zero, is left out (that is its target). An empty table, or weights of zero for all sources,
gives no rows. ``copy`` and ``mix_key`` replace columns of that name; all others pass through under any
name. Rows without doc_id that share their text draw alike and share their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.columns import quoted, unpack
from pagegrain.storage import stash

ALPHA = 0.5
PIECE = 400.0
BROADCAST_BYTES = 8 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the md5 of the parts."""
    return random_bits(*parts).cast("double") / F.lit(float(1 << 52))


def random_bits(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where nothing is left in double precision."""
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), start, add, lambda s: s["c"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """(source, rate, pieces, cdf): target rows by present rows. Without ``weights`` a source weighs n**alpha."""
    per = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.sqrt("n") if alpha == 0.5 else F.pow("n", F.lit(alpha))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    per = stash(per.withColumn("w", weight), "sources")
    n, w = per.agg(F.sum("n"), F.sum("w")).first()
    share = F.col("w") * F.lit(float(total if total is not None else n or 0)) / F.lit(w or 1.0) / F.col("n")
    per = per.select("source", share.alias("rate")).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    return per.withColumn("cdf", _cdf(F.col("rate") / F.col("pieces")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: int = 0) -> DataFrame:
    """The documents of the mixture, each as often as drawn, with ``copy`` (from 0) and ``mix_key``, in random order."""
    columns = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    per = stash(rates(docs, weights, alpha, total), "rates")
    if (per.agg(F.sum(8 * F.size("cdf") + F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        per = F.broadcast(per)
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    u = uniform(F.lit(str(seed)), F.lit("0"), who)
    rows = docs.select(F.struct(*map(quoted, columns)).alias("own"), F.col("source").alias("of"), who.alias("who"), u.alias("u"))
    rows = rows.join(per, F.col("of").eqNullSafe(F.col("source")))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("pieces") - 1), F.lit(0),
        lambda a, j: a + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(str(seed)), j.cast("string"), F.col("who")))),
    )
    drawn = F.when(F.col("pieces") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(drawn)
    rows = rows.withColumn("n", drawn).filter("n > 0").select("own", "who", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    key = random_bits(F.lit(str(seed)), F.lit("order"), F.col("copy").cast("string"), F.col("who"))
    rows = rows.select("own", "copy", key.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")
    return unpack(rows, columns, copy=F.col("copy"), mix_key=F.col("mix_key"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_sql(table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    return f"""
WITH RECURSIVE per AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM {table} GROUP BY source),
rate AS (SELECT source, w * (SELECT sum(n) FROM per)::DOUBLE / (SELECT sum(w) FROM per) / n AS rate FROM per),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 10 * sqrt(rate) + 20)
),
drawn AS (SELECT d.*, ('0x' || substr(md5('0:0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {table} AS d),
often AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS copies FROM drawn AS d)
SELECT {columns}, copy::INTEGER AS copy, ('0x' || substr(md5('0:order:' || copy || ':' || doc_id), 1, 13))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM often)
"""


SQL = mixing_sql()

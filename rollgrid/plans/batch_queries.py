"""Registered queries over permuted batches, balanced parts, resampling and graph searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollgrid.operators import batch, graph, groups
from rollgrid.plans.catalog import query, rounded, table
from rollgrid.plans.more_queries import LINES, lines


@query(f"""
SELECT epoch, batch, count(*)::BIGINT AS n, 0::BIGINT AS missing FROM (SELECT floor(pos / 1000)::BIGINT AS batch FROM ({LINES})), (SELECT unnest(range(2)) AS epoch) GROUP BY 1, 2""")
def permuted_batches(spark, sf_dir):
    """Every epoch deals all line items once, in an order of its own: batches, their sizes and the positions that no epoch
    or more than one batch of an epoch has."""
    dealt = batch.mini_batches(lines(spark, sf_dir).select("pos"), 1000, epochs=2, seed=7).select(F.col("epoch").cast("long").alias("epoch"), F.col("batch").cast("long").alias("batch"), "pos")
    once = dealt.groupBy("epoch", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("batch"))
    return once.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n") == 1, 0).otherwise(1)).cast("long").alias("missing"))


@query("""
SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS total, least(4, count(*))::BIGINT AS parts, true AS even FROM documents WHERE source IS NOT NULL GROUP BY source""")
def balanced_sources(spark, sf_dir):
    """Documents of each source in four parts whose lengths differ by no more than the longest document."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), "n_chars")
    sums = batch.balanced(docs, "source", "n_chars", 4, equal=False).groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("longest"))
    out = sums.groupBy("source").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("parts"), (F.max("total") - F.min("total") <= F.max("longest")).alias("even"))
    return out.withColumn("even", F.col("even") | (F.col("parts") < 4))


def poisson_sql(row: str, replicate: str, seed: int = 0) -> str:
    """The hash and counts of ``groups.poisson_counts`` in SQL."""
    import math

    p, (a, b, c) = groups.PRIME, groups.MULTIPLIERS
    begin = f"(((({replicate} + {seed + 1}) % {p}) * {a} + 1) % {p})"
    one = f"((({row} % {p}) * {b} + {begin}) % {p})"
    two = f"(({one} * {one} + {begin}) % {p})"
    three = f"((({two} * {c}) % {p} + ({two} * {two}) % {p}) % {p})"
    total, bounds = 0.0, []
    for k in range(groups.MOST_COUNT):
        total += math.exp(-1) / math.factorial(k)
        bounds.append(int(total * p))
    return f"len(list_filter({bounds}::BIGINT[], lambda z: {three} >= z))"


@query(f"""
SELECT event_type, replicate, round(sum(w * value) / sum(w), 6) AS mean FROM (
  SELECT event_type, value, replicate, {poisson_sql("event_id", "replicate")} AS w FROM events, (SELECT unnest(range(50)) AS replicate)) GROUP BY 1, 2""")
def resampled_means(spark, sf_dir):
    """Fifty bootstrap means of the values of each event type."""
    out = groups.poisson_bootstrap(table(spark, sf_dir, "events"), "event_type", "value", "event_id", 50)
    return rounded(out.withColumn("replicate", F.col("replicate").cast("long")))


@query("""
WITH RECURSIVE e AS (SELECT o_custkey % 25 AS src, (o_custkey * 7 + o_orderkey % 5) % 25 AS dst, min(1 + o_orderkey % 9) AS cost FROM orders GROUP BY 1, 2),
w(start, node, cost) AS (SELECT n_nationkey, n_nationkey::BIGINT, 0::BIGINT FROM nation UNION SELECT w.start, e.dst, w.cost + e.cost FROM w JOIN e ON e.src = w.node WHERE w.cost + e.cost < 60)
SELECT start AS src, node::INT AS dst, min(cost)::DOUBLE AS cost FROM w GROUP BY 1, 2""")
def cheapest_routes(spark, sf_dir):
    """Costs between all nations over edges that the orders give."""
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.lit(0).alias("graph"), (F.col("o_custkey") % 25).cast("int").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % 25).cast("int").alias("dst"), (1 + F.col("o_orderkey") % 9).alias("cost"))
    nations = table(spark, sf_dir, "nation").select(F.lit(0).alias("graph"), F.col("n_nationkey").alias("src"))
    asked = nations.join(nations.withColumnRenamed("src", "dst"), "graph")
    return graph.shortest_paths(edges, asked, delta=4.0).where("found").select("src", "dst", "cost")

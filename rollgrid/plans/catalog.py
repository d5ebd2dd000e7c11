"""The registered queries over the operators, each bound to the test tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.functions import arrays as A
from rollgrid.functions import geometry as G
from rollgrid.functions import scores as S
from rollgrid.functions import text as T
from rollgrid.operators import advantages, batch, graph, groups, manifests, scenes, spatial
from rollgrid.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as the query of its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rollouts of their order: token and a score from 0 to 1."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("token"), (F.col("l_quantity") / 50).alias("pdms_scaled"), (F.col("l_discount") * 10).alias("pdms"))


def user_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("uid"), (F.col("value") / 500).alias("reward"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and filter in one plan: the learnable groups."""
    return scene_filter(spark, sf_dir)


# group statistics and filters


@query("""
SELECT l_orderkey AS token, count(*)::BIGINT AS group_size,
  round(avg(l_discount * 10), 6) AS pdms_mean, round(stddev_samp(l_discount * 10), 6) AS pdms_std, round(max(l_discount * 10) - min(l_discount * 10), 6) AS pdms_range,
  round(avg(l_quantity / 50), 6) AS pdms_scaled_mean, round(stddev_samp(l_quantity / 50), 6) AS pdms_scaled_std, round(max(l_quantity / 50) - min(l_quantity / 50), 6) AS pdms_scaled_range
FROM lineitem GROUP BY l_orderkey""")
def group_stats(spark, sf_dir):
    return rounded(groups.group_stats(rollouts(spark, sf_dir)))


@query("""
WITH s AS (SELECT l_orderkey AS token, avg(l_quantity / 50) AS m, stddev_samp(l_quantity / 50) AS sd, max(l_quantity / 50) - min(l_quantity / 50) AS r FROM lineitem GROUP BY 1),
a AS (SELECT *, m / r AS p FROM s WHERE sd > 0.01 AND r > 1e-6),
b AS (SELECT *, round_even(p * 32, 0) AS k FROM a WHERE pow(p, 8) + pow(1 - p, 8) < 0.1),
c AS (SELECT *, CASE WHEN k * (32 - k) >= 0 THEN sqrt(k * (32 - k) / 992.0::DOUBLE) * r END AS pred FROM b)
SELECT token, round(p, 6) AS p_est, round(sd, 6) AS std, round(pred, 6) AS pred_std FROM c WHERE abs(pred - sd) / sd < 0.1""")
def scene_filter(spark, sf_dir):
    # the last bits of a mean decide ties of the rounded counts, so groups are added as the rows are stored
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), (F.col("l_quantity") / 50).alias("pdms_scaled"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = groups.scene_filter(groups.group_stats(stored, measures=["pdms_scaled"], order=["file", "row"]))
    return rounded(out.select("token", "p_est", F.col("pdms_scaled_std").alias("std"), "pred_std"))


@query("""
WITH s AS (SELECT o_custkey AS token, count(*)::BIGINT AS n, avg(o_totalprice / 500000) AS m, max(o_totalprice / 500000) AS best FROM orders GROUP BY 1)
SELECT token, n, round((1 - m) * (best - m), 6) AS learnability FROM s ORDER BY (1 - m) * (best - m) DESC, token LIMIT 100""")
def learnability_top100(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("token"), (F.col("o_totalprice") / 500000).alias("pdms_scaled"))
    return rounded(groups.learnability_ranking(rows).limit(100).select("token", "n", "learnability"))


@query("""
SELECT o_custkey AS token, o_orderkey AS pos, o_totalprice AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def best_of_n(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("score"))
    return groups.best_of_n(rows)


@query("""
WITH g AS (SELECT l_orderkey, avg(l_quantity / 50) AS m, coalesce(stddev_samp(l_quantity / 50), 0) AS sd, max(l_quantity / 50) AS best FROM lineitem GROUP BY 1)
SELECT count(*)::BIGINT AS rollouts, round(avg(l_quantity / 50), 6) AS mean, round(stddev_pop(l_quantity / 50), 6) AS std,
  round(quantile_cont((l_quantity / 50)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont((l_quantity / 50)::DOUBLE, 0.9), 6) AS p90,
  round(quantile_cont((l_quantity / 50)::DOUBLE, 0.95), 6) AS p95, round(quantile_cont((l_quantity / 50)::DOUBLE, 0.99), 6) AS p99,
  (SELECT count(*)::BIGINT FROM g) AS groups, (SELECT round(avg(CASE WHEN sd = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM g) AS zero_std_ratio,
  (SELECT round(avg(CASE WHEN sd < 0.01 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM g) AS low_std_ratio, (SELECT round(avg(best - m), 6) FROM g) AS headroom
FROM lineitem""")
def rollout_report(spark, sf_dir):
    return rounded(groups.rollout_report(rollouts(spark, sf_dir)))


@query("""
WITH g AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING max(l_quantity) <> min(l_quantity))
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM g)""")
def group_filter_zero_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return groups.group_filter(rows, "l_partkey", "l_quantity")


@query("""
WITH g AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) > 20 AND avg(l_quantity) < 30)
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM g)""")
def group_filter_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return groups.group_filter(rows, "l_partkey", "l_quantity", "mean", 20, 30)


@query("""
SELECT l_orderkey AS token FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R') OR max(l_quantity / 50) = 0""")
def persistent_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("safe"), (F.col("l_quantity") / 50).alias("pdms_scaled"))
    return groups.persistent_failures(rows)


CUSTOMER_STATS = "SELECT o_custkey AS k, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1 HAVING count(*) > 1"


def customer_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(f"""
WITH s AS ({CUSTOMER_STATS}), r AS (
  SELECT rank() OVER (ORDER BY m) - 1 + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY sd) - 1 + (count(*) OVER (PARTITION BY sd) - 1) / 2.0::DOUBLE AS b FROM s)
SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS spearman FROM r""")
def spearman(spark, sf_dir):
    return rounded(groups.spearman(customer_stats(spark, sf_dir), "m", "sd"))


@query(f"""
WITH s AS ({CUSTOMER_STATS}), b AS (SELECT *, floor((row_number() OVER (ORDER BY m, k) - 1) * 5 / count(*) OVER ())::INT AS bin FROM s)
SELECT bin, count(*)::BIGINT AS n, round(min(m), 6) AS low, round(max(m), 6) AS high, round(avg(sd), 4) AS mean FROM b GROUP BY bin""")
def quintiles(spark, sf_dir):
    return rounded(groups.quantile_report(customer_stats(spark, sf_dir), "k", "m", "sd").withColumn("mean", F.round("mean", 4)))


@query("""
SELECT quantile_cont(n_chars::DOUBLE, 0.5) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n_chars::DOUBLE, 0.99), 6) AS p99 FROM documents""")
def percentiles(spark, sf_dir):
    shares = {f"p{q}": q / 100 for q in (50, 90, 95, 99)}
    return rounded(groups.percentiles(table(spark, sf_dir, "documents"), "n_chars", shares))


@query("""
SELECT floor(l_quantity * 0.1)::BIGINT AS cx, floor(l_discount * 100 * 0.1)::BIGINT AS cy, count(*)::BIGINT AS n, least(count(*), 500) / 500.0::DOUBLE AS level FROM lineitem GROUP BY 1, 2""")
def histogram2d(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return groups.histogram2d(rows, "x", "y", 0.1, 500)


@query("""
SELECT avg(n_chars) AS mean, max(n_chars) AS max, min(n_chars) AS min, avg(CASE WHEN n_chars = (SELECT max(n_chars) FROM documents) THEN 1.0::DOUBLE ELSE 0 END) AS clip_ratio FROM documents""")
def length_metrics(spark, sf_dir):
    return groups.length_metrics(table(spark, sf_dir, "documents"), "n_chars")


@query("""SELECT label, count(*)::BIGINT AS n, round((2 * count(*) * sum(q) - 2 * any_value(ss)) / (count(*) * (count(*) - 1)), 4) AS mean_squared FROM (
  SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q FROM embeddings) JOIN (
  SELECT label, sum(s * s) AS ss FROM (SELECT label, i, sum(v) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) USING (label)
GROUP BY label HAVING count(*) > 1""")
def mean_pairwise_distance(spark, sf_dir):
    out = spatial.mean_pairwise_distance(table(spark, sf_dir, "embeddings"), "label", "embedding").where("n > 1")
    return rounded(out, 4)


# advantages


@query("SELECT event_id, round((value / 500 - avg(value / 500) OVER w) / (coalesce(stddev_samp(value / 500) OVER w, 1.0) + 1e-6), 6) AS advantages FROM events WINDOW w AS (PARTITION BY user_id)")
def grpo(spark, sf_dir):
    return rounded(advantages.advantage(user_rewards(spark, sf_dir), "grpo").select("event_id", "advantages"))


@query("SELECT event_id, round((value / 500 - avg(value / 500) OVER w) / greatest(coalesce(stddev_samp(value / 500) OVER w, 0), 0.05), 6) AS advantages FROM events WINDOW w AS (PARTITION BY user_id)")
def grpo_std_floor(spark, sf_dir):
    return rounded(advantages.advantage(user_rewards(spark, sf_dir), "grpo_std_floor").select("event_id", "advantages"))


@query("SELECT event_id, round(value / 500 - avg(value / 500) OVER (PARTITION BY user_id), 6) AS advantages FROM events")
def dr_grpo(spark, sf_dir):
    return rounded(advantages.advantage(user_rewards(spark, sf_dir), "dr_grpo").select("event_id", "advantages"))


@query("""SELECT event_id, round(value / 500 - coalesce((sum(value / 500) OVER w - value / 500) / nullif(count(*) OVER w - 1, 0), 0), 6) AS advantages FROM events WINDOW w AS (PARTITION BY user_id)""")
def rloo(spark, sf_dir):
    return rounded(advantages.advantage(user_rewards(spark, sf_dir), "rloo").select("event_id", "advantages"))


@query("""
SELECT event_id, round(coalesce(CASE WHEN row_number() OVER o = 1 THEN (value / 500 - lead(value / 500) OVER o) / (stddev_samp(value / 500) OVER (PARTITION BY user_id) + 1e-6) ELSE 0 END, 0), 6) AS advantages
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY value DESC, event_id)""")
def pass_at_k(spark, sf_dir):
    return rounded(advantages.advantage(user_rewards(spark, sf_dir), "grpo_passk", tie="event_id").select("event_id", "advantages"))


@query("""SELECT user_id AS uid, round(avg(abs(a)), 6) AS abs_standardised, round(avg(abs(c)), 6) AS abs_centred FROM (
  SELECT user_id, (value / 500 - avg(value / 500) OVER w) / (coalesce(stddev_samp(value / 500) OVER w, 1.0) + 1e-6) AS a, value / 500 - avg(value / 500) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id)) GROUP BY 1""")
def group_advantages(spark, sf_dir):
    return rounded(advantages.group_advantages(user_rewards(spark, sf_dir)))


@query("""
SELECT user_id AS uid, list(round(s, 4) ORDER BY ts, event_id) AS returns FROM (
  SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM events) GROUP BY 1""")
def reverse_returns(spark, sf_dir):
    """Token rewards of a user's events in order, as returns of all tokens."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))["value"].alias("token_rewards"))
    rows = rows.withColumns({"mask": F.transform("token_rewards", lambda x: F.lit(1)), "baseline": F.lit(0.0)})
    out = advantages.advantage(rows, "remax")
    return out.select("uid", F.transform("returns", lambda x: F.round(x, 4)).alias("returns"))


@query("""
SELECT event_id, round(value / 500 - other, 6) AS kl, round(abs(value / 500 - other), 6) AS abs_kl, round(0.5 * (value / 500 - other) * (value / 500 - other), 6) AS mse,
  round(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, exp(other - value / 500) - (other - value / 500) - 1)), 6) AS low_var FROM (SELECT *, (event_id % 7) / 7.0::DOUBLE AS other FROM events)""")
def divergences(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("p"), ((F.col("event_id") % 7) / 7.0).alias("q"))
    p, q = F.col("p"), F.col("q")
    return rounded(rows.select("event_id", *[advantages.divergence(p, q, k).alias(n) for k, n in (("kl", "kl"), ("abs", "abs_kl"), ("mse", "mse"), ("low_var_kl", "low_var"))]))


# frames and scenes


def user_frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("log_name"), F.col("event_id").alias("token"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start_time"), "value", "event_type")


@query("""
SELECT log_name, now, prev, dt FROM (
  SELECT user_id AS log_name, event_id AS now, lag(event_id) OVER w AS prev, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 3) AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE prev IS NOT NULL AND abs(dt) <= 3600""")
def adjacency(spark, sf_dir):
    return rounded(scenes.adjacent(user_frames(spark, sf_dir), gap=3600.0), 3)


@query("""
SELECT user_id AS log_name, event_id AS first, last FROM (
  SELECT user_id, event_id, lead(event_id, 13) OVER w AS last, row_number() OVER w - 1 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE last IS NOT NULL AND n % 14 = 0""")
def hopping_windows(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("log_name"), F.col("event_id").alias("token"), "ts")
    out = scenes.hopping_windows(frames, scenes.FrameWindow(4, 10), order=["ts", "token"])
    return out.select("log_name", F.element_at("frames", 1)["token"].alias("first"), F.element_at("frames", -1)["token"].alias("last"))


@query("""
SELECT user_id AS log_name, round(max(s), 4) AS largest FROM (
  SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS s FROM events) GROUP BY 1""")
def rolling_sum_max(spark, sf_dir):
    return rounded(scenes.rolling_sums(user_frames(spark, sf_dir), "log_name", ["start_time", "token"], "value"), 4)


@query("""
WITH f AS (SELECT user_id, ts, event_id, value > 100 AS flag FROM events WHERE event_type <> 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - sum(flag::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
SELECT log_name, max(n)::BIGINT AS longest FROM (SELECT user_id AS log_name, run, sum(flag::INT) AS n FROM r GROUP BY 1, 2) GROUP BY 1""")
def longest_run(spark, sf_dir):
    """Clicks are passed over without ending a run."""
    return scenes.longest_runs(user_frames(spark, sf_dir), "log_name", ["start_time", "token"], F.when(F.col("event_type") != "click", F.col("value") > 100))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t0, value AS v0, lead(epoch_us(ts) / 1e6) OVER w AS t1, lead(value) OVER w AS v1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts))),
k AS (SELECT *, unnest(range(ceil(t0 / 3600)::BIGINT, ceil(t1 / 3600)::BIGINT)) AS k FROM g WHERE t1 > t0)
SELECT user_id AS log_name, k * 3600 AS at, round(v0 + (v1 - v0) * (k * 3600 - t0) / (t1 - t0), 4) AS value FROM k""")
def resample_lerp(spark, sf_dir):
    return rounded(scenes.resampled(user_frames(spark, sf_dir), "log_name", "start_time", "value", 3600), 4)


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, abs(l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey)) / 10 AS d FROM lineitem),
e AS (SELECT *, exp(-d * d / 0.2) AS raw FROM d)
SELECT l_partkey, round(sum(q * wt) / sum(wt), 5) AS q FROM (
  SELECT l_partkey, l_quantity AS q, CASE WHEN abs(sum(raw) OVER p) <= 1e-8 THEN 1.0::DOUBLE / count(*) OVER p ELSE raw / sum(raw) OVER p END AS wt FROM e WINDOW p AS (PARTITION BY l_partkey)) GROUP BY 1""")
def kernel_weights(spark, sf_dir):
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("q"))
    lines = lines.withColumn("d", F.abs(F.col("q") - F.avg("q").over(W.partitionBy("l_partkey"))) / 10)
    return rounded(scenes.weighted_means(scenes.kernel_weights(lines, "l_partkey", "d"), "weight", ["q"], ["l_partkey"]), 5)


@query("""
SELECT o_orderkey, CASE WHEN kind = 0 THEN o_totalprice END AS score_stage_one, CASE WHEN kind <> 0 THEN o_totalprice END AS score_stage_two, o_totalprice AS final_score
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind FROM orders)""")
def stage_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("frame_type"))
    return scenes.stage_columns(rows, ["score"], score="score").select("o_orderkey", "score_stage_one", "score_stage_two", "final_score")


@query("""
WITH p AS (SELECT o.o_custkey AS now, o.o_custkey + 1 AS prev, [o.o_orderkey] AS a, [o.o_orderkey + 1] AS b FROM orders o),
f AS (SELECT c_custkey AS token, c_acctbal / 10000 AS score FROM customer),
s AS (SELECT o_orderkey AS token, o_totalprice / 500000 AS score, 1.0::DOUBLE AS weight FROM orders),
m AS (SELECT now, prev, list_concat(list(a[1]), []) AS la, list(b[1]) AS lb FROM p GROUP BY 1, 2),
sn AS (SELECT now, prev, sum(s.weight * s.score) / sum(s.weight) AS v FROM (SELECT now, prev, unnest(la) AS t FROM m) JOIN s ON s.token = t GROUP BY 1, 2),
sp AS (SELECT now, prev, sum(s.weight * s.score) / sum(s.weight) AS v FROM (SELECT now, prev, unnest(lb) AS t FROM m) JOIN s ON s.token = t GROUP BY 1, 2),
j AS (SELECT m.now, m.prev, f1.score * sn.v AS x, f2.score * sp.v AS y FROM m LEFT JOIN f f1 ON f1.token = m.now LEFT JOIN f f2 ON f2.token = m.prev
      LEFT JOIN sn ON sn.now = m.now AND sn.prev = m.prev LEFT JOIN sp ON sp.now = m.now AND sp.prev = m.prev)
SELECT now || '|' || prev AS mapping, round((coalesce(x, 0) + coalesce(y, 0)) / nullif((x IS NOT NULL)::INT + (y IS NOT NULL)::INT, 0), 6) AS score FROM j""")
def two_stage_scores(spark, sf_dir):
    """Customers as first-stage scenes, their orders as second-stage ones."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token"), (F.col("c_acctbal") / 10000).alias("score"))
    second = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), (F.col("o_totalprice") / 500000).alias("score"), F.lit(1.0).alias("weight"))
    mapping = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("now")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("now"), (F.col("o_orderkey") + 1).alias("prev"))).alias("pairs")).withColumn("prev", F.col("now") + 1)
    return rounded(scenes.two_stage_scores(first, second, mapping).select("mapping", "score"))


@query("""
WITH l AS (SELECT o.o_orderkey AS token, max(o_totalprice) AS old, sum(l_extendedprice) AS new FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1)
SELECT token, round(coalesce(new, old), 2) AS score FROM l""")
def score_update(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_totalprice").alias("score"))
    change = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("token")).agg(F.sum("l_extendedprice").alias("score"))
    return rounded(scenes.updated(base, change, "token"), 2)


# scores


def line_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("nc"), F.lit(1.0).alias("dac"),
        (F.col("l_quantity") / 50).alias("ep"), (F.col("l_discount") * 10).alias("ttc"), (F.col("l_tax") * 12.5).alias("hc"),
    )


LINE_SQL = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS nc, 1.0::DOUBLE AS dac, l_quantity / 50 AS ep, l_discount * 10 AS ttc, l_tax * 12.5 AS hc FROM lineitem"
CLIP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))".format
EP, TTC, HC = CLIP("ep"), CLIP("ttc"), CLIP("hc")


@query(f"""
SELECT l_orderkey, l_extendedprice, round(nc * dac * (5 * ep + 5 * ttc + 2 * hc) / 12, 6) AS plain,
  round(CASE WHEN nc = 0 THEN 0 ELSE {CLIP(f'(5 * (1 - pow(1 - {EP}, 0.6)) + 5 * (1 - pow(1 - {TTC}, 0.6)) + 2 * {HC}) / 12')} END, 6) AS scaled,
  round(CASE WHEN nc = 0 THEN 0 ELSE (1 - pow(1 - {EP}, 0.4)) * (1 - pow(1 - {TTC}, 0.4)) * {HC} + 1e-6 END, 6) AS product,
  round(0.5 * nc + 0.5 * nc * (5 * (1 - pow(1 - {EP}, 0.6)) + 5 * (1 - pow(1 - {TTC}, 0.6)) + 2 * {HC}) / 12 + 0.1 * (1 - nc) * {TTC}, 6) AS safety_first
FROM ({LINE_SQL})""")
def driving_scores(spark, sf_dir):
    rows = line_metrics(spark, sf_dir)
    m = [F.col(c) for c in ("nc", "dac", "ep", "ttc", "hc")]
    return rounded(rows.select("l_orderkey", "l_extendedprice", S.driving_score(*m).alias("plain"), S.scaled_score(*m).alias("scaled"), S.product_scaled_score(*m).alias("product"), S.safety_first_reward(*m).alias("safety_first")))


@query(f"""
SELECT l_orderkey, l_extendedprice, round(CASE WHEN l_linenumber = 1 THEN nc * (5 * ep + 5 * ttc + 2 * hc + 2 * ep) / 14 ELSE nc * (5 * ep + 5 * ttc + 2 * hc + 2 * ep + 2 * hc) / 16 END, 6) AS score FROM ({LINE_SQL})""")
def extended_scores(spark, sf_dir):
    rows = line_metrics(spark, sf_dir)
    comfort = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("hc"))
    return rounded(rows.select("l_orderkey", "l_extendedprice", S.extended_score(F.col("nc"), F.array("ep", "ttc", "hc", "ep"), comfort).alias("score")))


# manifests


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'train' ELSE 'rest' END AS part FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def manifest_split(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    inside = manifests.members(docs, labels, "doc_id").withColumn("part", F.lit("train"))
    return inside.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("part", F.lit("rest")))


@query("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only
FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT vec_id AS b FROM embeddings) ON a = b""")
def set_counts(spark, sf_dir):
    return manifests.set_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("""
WITH v AS (SELECT user_id, avg(value) AS a FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1),
p AS (SELECT user_id, avg(value) AS b FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1)
SELECT 'value' AS metric, round(avg(a), 6) AS base, round(avg(b), 6) AS candidate, round(avg(b - a), 6) AS difference, count(*)::BIGINT AS n FROM v JOIN p USING (user_id)""")
def paired_difference(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ends = F.broadcast(events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high")))  # one row
    marked = events.crossJoin(ends)
    base, candidate = (marked.where(F.col("event_type") == F.col(c)).groupBy(F.col("user_id").alias("token")).agg(F.avg("value").alias("value")) for c in ("low", "high"))
    long = manifests.long_differences(base, candidate, ["value"])
    return rounded(long.groupBy("metric").agg(F.avg("base").alias("base"), F.avg("candidate").alias("candidate"), F.avg("difference").alias("difference"), F.count(F.lit(1)).alias("n")))


@query("""SELECT user_id AS token FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def complete_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("token"), F.col("event_type").alias("builder"))
    kinds = sorted(r[0] for r in events.select("builder").distinct().collect())
    return manifests.complete(events, kinds)


# batches


def nations(spark, sf_dir):
    return batch.indexed(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


N = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey, n_name FROM nation"


@query(f"SELECT pos * 3 + k AS pos, n_nationkey, n_name FROM ({N}), range(3) r(k)")
def repeat_interleave(spark, sf_dir):
    return batch.repeated(nations(spark, sf_dir), 3)


@query(f"SELECT k * 25 + pos AS pos, n_nationkey, n_name FROM ({N}), range(2) r(k)")
def repeat_tile(spark, sf_dir):
    return batch.repeated(nations(spark, sf_dir), 2, interleave=False)


@query(f"SELECT pos + k * 25 AS pos, n_nationkey, n_name FROM ({N}), range(2) r(k) WHERE pos + k * 25 < 32")
def pad_to_multiple(spark, sf_dir):
    return batch.padded(nations(spark, sf_dir), 16)[0]


@query(f"SELECT pos, n_nationkey, n_name, floor(pos / 5)::INT AS chunk FROM ({N})")
def chunk(spark, sf_dir):
    return batch.chunked(nations(spark, sf_dir), 5)


@query(f"SELECT ((pos - 3) / 4)::BIGINT AS pos, n_nationkey, n_name FROM ({N}) WHERE pos >= 3 AND pos < 20 AND (pos - 3) % 4 = 0")
def slice_rows(spark, sf_dir):
    return batch.sliced(nations(spark, sf_dir), 3, 20, 4)


@query(f"SELECT pos, n_nationkey, n_name, upper(n_name) AS upper FROM ({N})")
def zip_columns(spark, sf_dir):
    a = nations(spark, sf_dir)
    return batch.zipped(a, a.select("pos", "n_nationkey", F.upper("n_name").alias("upper")))


@query(f"SELECT 24 - pos AS pos, n_nationkey, n_name FROM ({N})")
def reorder(spark, sf_dir):
    a = nations(spark, sf_dir)
    return batch.taken(a, a.select((24 - F.col("pos")).alias("at"), "pos"))


@query("""
SELECT n_nationkey AS k, 'both' AS part FROM nation INTERSECT SELECT s_nationkey, 'both' FROM supplier
UNION ALL (SELECT c_nationkey, 'only customers' FROM customer EXCEPT SELECT s_nationkey, 'only customers' FROM supplier)
UNION ALL SELECT r_regionkey, 'regions' FROM region""")
def set_operations(spark, sf_dir):
    key = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"))
    both = key("nation", "n_nationkey").intersect(key("supplier", "s_nationkey")).withColumn("part", F.lit("both"))
    only = key("customer", "c_nationkey").subtract(key("supplier", "s_nationkey")).withColumn("part", F.lit("only customers"))
    return both.unionByName(only).unionByName(key("region", "r_regionkey").withColumn("part", F.lit("regions")))


@query()
def balanced_parts(spark, sf_dir):
    """Documents dealt into four parts of near equal length for each source."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), "n_chars")
    return batch.part_sums(batch.balanced(docs, "source", "n_chars", 4, equal=False).withColumn("part", F.concat_ws("-", "source", "part")), "part", "n_chars")


# text


@query("""
SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def latest_turn(spark, sf_dir):
    return groups.latest_by(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "turn", "text")


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\+?\d[\d() -]{7,}\d')) AS n_numbers, coalesce(regexp_extract_all(text, '(\w+)@\w+', 1)[1], '') AS mailbox FROM documents""")
def extracted_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\+?\d[\d() -]{7,}\d"), F.lit(0))).cast("long").alias("n_numbers"), F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit(r"(\w+)@\w+"), F.lit(1)), F.lit(1)), F.lit("")).alias("mailbox"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT o_orderkey, o_custkey / 4.0::DOUBLE AS x, -o_custkey / 8.0::DOUBLE AS y, 3 AS n FROM orders")
def waypoints(spark, sf_dir):
    """Orders written as trajectory texts and parsed again: the first of three triples."""
    n = lambda c: F.format_string("%.3f", c)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") / 4).alias("a"), (-F.col("o_custkey") / 8).alias("b"))
    triple = F.concat(F.lit("("), n(F.col("a")), F.lit(", "), n(F.col("b")), F.lit(", 0.5)"))
    text = F.concat(F.lit('{"future_trajectory": ['), triple, F.lit(","), triple, F.lit(","), triple, F.lit("]}"))
    parsed = orders.select("o_orderkey", T.tagged_trajectory(text, n=3).alias("t"))
    return parsed.select("o_orderkey", F.element_at("t", 1)["x"].alias("x"), F.element_at("t", 1)["y"].alias("y"), F.size("t").alias("n"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM nation""")
def answer_rewards(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey")
    said = F.concat(F.lit("First I think. Answer: 7\nAnswer: $1,"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit("$ dollars"))
    truth = F.concat(F.lit("1"), F.lpad((F.col("n_nationkey") + F.col("n_nationkey") % 2).cast("string"), 3, "0"))
    return rows.select("n_nationkey", T.answer_reward(said, truth).alias("reward"))


@query("""
SELECT n_nationkey, list_transform(range(6), lambda i: CASE WHEN i <= n_nationkey % 6 THEN 1 ELSE 0 END) AS mask FROM nation""")
def response_masks(spark, sf_dir):
    """Token ids whose end token (2) stands at a place that depends on the key."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i >= F.col("n_nationkey") % 6, F.lit(2)).otherwise(F.lit(9)))
    return table(spark, sf_dir, "nation").select("n_nationkey", A.response_mask(ids, 2).alias("mask"))


# graphs and space


@query("""
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
w(start, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 2)
SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2""")
def bfs_depth(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    return graph.reached(edges, table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node")), 2)


@query("""
SELECT type, id, round(distance, 6) AS distance FROM (
  SELECT s_nationkey AS type, s_suppkey AS id, sqrt(pow(s_acctbal - 1000, 2) + pow(s_suppkey, 2)) AS distance, row_number() OVER (PARTITION BY s_nationkey ORDER BY sqrt(pow(s_acctbal - 1000, 2) + pow(s_suppkey, 2)), s_suppkey) AS n FROM supplier)
WHERE n <= CASE type WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END""")
def nearest_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    return rounded(spatial.nearest(rows, 1000.0, 0.0, {k: {0: 5, 1: 3}.get(k, 1) for k in range(25)}).select("type", "id", "distance"))


@query("""
SELECT c_custkey AS pid, n_nationkey AS gid FROM customer JOIN nation ON c_acctbal > n_nationkey * 400 - 1000 AND c_acctbal < n_nationkey * 400 - 700 AND c_nationkey + 0.5 > 0 AND c_nationkey + 0.5 < n_nationkey + 0.25""")
def points_in_polygons(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") + 0.5).alias("y"))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("n_nationkey")
    low, high, top = k * 400 - 1000, k * 400 - 700, k + 0.25
    rings = table(spark, sf_dir, "nation").select(k.alias("gid"), F.array(corner(low, F.lit(0)), corner(high, F.lit(0)), corner(high, top), corner(low, top)).alias("ring"))
    return spatial.points_in_polygons(points, rings, 100.0)


@query("""
SELECT o_orderkey, round(atan2(sin(a), cos(a)), 6) AS wrapped, round(x * cos(a) - y * sin(a), 6) AS rx, round(x * sin(a) + y * cos(a), 6) AS ry
FROM (SELECT o_orderkey, o_totalprice / 10000 AS a, o_custkey::DOUBLE / 100 AS x, o_totalprice / 1e6 AS y FROM orders)""")
def rotations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("a"), (F.col("o_custkey").cast("double") / 100).alias("x"), (F.col("o_totalprice") / 1e6).alias("y"))
    rx, ry = G.rotated(F.col("x"), F.col("y"), F.col("a"))
    return rounded(rows.select("o_orderkey", G.wrapped(F.col("a")).alias("wrapped"), rx.alias("rx"), ry.alias("ry")))


@query("""
WITH p AS (SELECT user_id, value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.user_id, round(sum(sqrt(pow(b.value - a.value, 2) + 1)), 4) AS length FROM p a JOIN p b ON a.user_id = b.user_id AND b.n = a.n + 1 GROUP BY 1""")
def path_lengths(spark, sf_dir):
    """Events of a user as points (order, value) of a path."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))["value"].alias("v"))
    points = F.transform("v", lambda v, i: F.struct(i.cast("double").alias("x"), v.alias("y")))
    out = rows.select("user_id", points.alias("p")).where(F.size("p") > 1)
    return rounded(out.select("user_id", F.element_at(G.path_progress(F.col("p")), -1).alias("length")), 4)


# streams


@query("""
SELECT user_id AS token, count(*)::BIGINT AS group_size, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_std, round(max(value) - min(value), 4) AS value_range FROM events GROUP BY 1""")
def streamed_group_stats(spark, sf_dir):
    """The events read as a stream until all is there; running statistics by user."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumnRenamed("user_id", "token")
    return rounded(logs.settled(logs.running_group_stats(stream, "token", "value"), ["token"]), 4)


@query("""
SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS begins, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streamed_windows(spark, sf_dir):
    """Counts of tumbling days of event time."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = logs.settled(logs.windowed_counts(stream, length="1 day", late="400 days"), ["window", "event_type"])
    return rounded(out.select(F.unix_seconds("window.start").alias("begins"), "event_type", "n", "total"), 4)

"""More registered queries: guards, sinks and readers, token-level estimators, text, geometry, batches and plug-ins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.functions import arrays as A
from rollgrid.functions import geometry as G
from rollgrid.functions import registry
from rollgrid.functions import scores as S
from rollgrid.functions import text as T
from rollgrid.operators import advantages, batch, graph, groups, guards, manifests, metrics, scenes, scorer, simulation, spatial
from rollgrid.operators.storage import folder
from rollgrid.plans.catalog import query, rounded, table
from rollgrid.sources import readers, writers


def scratch(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def user_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user in order as token arrays: rewards, values and a mask that spares one event type."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 500).alias("r"), (F.col("event_type") != "click").cast("int").alias("m"))
    each = events.groupBy(F.col("user_id").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "r", "m"))).alias("a"))
    return each.select("uid", F.col("a")["r"].alias("token_rewards"), F.transform(F.col("a")["r"], lambda x: x / 2).alias("values"), F.col("a")["m"].alias("mask"))


TOKENS = "SELECT user_id AS uid, event_id, ts, value / 500 AS r, value / 1000 AS v, (event_type <> 'click')::INT AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"

# guards


@query("""
SELECT 'unique orders' AS guard, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS passed
UNION ALL SELECT 'unique lines', (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem)
UNION ALL SELECT 'orders have lines', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'one line an order', NOT EXISTS (SELECT 1 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 1)
UNION ALL SELECT 'lines of known orders', NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'texts are there', NOT EXISTS (SELECT 1 FROM documents WHERE text IS NULL OR lang IS NULL)
UNION ALL SELECT 'labels within documents', NOT EXISTS (SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'documents within labels', NOT EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'customers apart from nations', NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey IN (SELECT n_nationkey FROM nation))
UNION ALL SELECT 'dense customers', (SELECT count(DISTINCT c_custkey) = 100 AND count(*) = 100 FROM customer WHERE c_custkey BETWEEN 1 AND 100)
UNION ALL SELECT 'twenty-five nations', (SELECT count(*) = 25 FROM nation)
UNION ALL SELECT 'six regions', (SELECT count(*) = 6 FROM region)
UNION ALL SELECT 'embeddings of equal size', NOT EXISTS (SELECT 1 FROM embeddings WHERE len(embedding) <> (SELECT max(len(embedding)) FROM embeddings))""")
def guard_results(spark, sf_dir):
    """Every guard over the tables: whether it lets them pass."""
    t = lambda name: table(spark, sf_dir, name)
    orders, lines = t("orders").select(F.col("o_orderkey").alias("token")), t("lineitem").select(F.col("l_orderkey").alias("token"))
    docs, labels = t("documents").withColumnRenamed("doc_id", "token"), t("labels").withColumnRenamed("doc_id", "token")
    customers, nations = t("customer").select(F.col("c_custkey").cast("long").alias("token")), t("nation").select(F.col("n_nationkey").cast("long").alias("token"))
    size = t("embeddings").agg(F.max(F.size("embedding"))).first()[0]
    pairs = t("embeddings").select(F.col("vec_id").alias("token"), "embedding", F.sequence(F.lit(1), F.lit(size)).alias("place"))
    checks: dict[str, Callable[[], object]] = {
        "unique orders": lambda: guards.unique(orders, "token"),
        "unique lines": lambda: guards.unique(lines, "token"),
        "orders have lines": lambda: guards.covered(lines, orders),
        "one line an order": lambda: guards.covered(lines, orders, expected=1),
        "lines of known orders": lambda: guards.within_manifest(lines, orders),
        "texts are there": lambda: guards.required(docs, ["text", "lang"]),
        "labels within documents": lambda: guards.subset(labels, docs),
        "documents within labels": lambda: guards.subset(docs, labels),
        "customers apart from nations": lambda: guards.disjoint(customers, nations),
        "dense customers": lambda: guards.dense_steps(customers, 100, "token"),
        "twenty-five nations": lambda: guards.exactly(nations, 25),
        "six regions": lambda: guards.exactly(t("region"), 6),
        "embeddings of equal size": lambda: guards.parallel(pairs, ["place", "embedding"]),
    }
    rows = []
    for name, check in checks.items():
        try:
            check()
            rows.append((name, True))
        except guards.GuardError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "guard string, passed boolean")


# sinks and readers


@query("SELECT o_orderkey::VARCHAR AS token, o_totalprice / 500000 AS pdms, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS pdms_scaled FROM orders")
def jsonl_round_trip(spark, sf_dir):
    """Objects with all their keys, written and read as rollouts."""
    path = scratch(spark, "jsonl")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("token"), (F.col("o_totalprice") / 500000).alias("pdms"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("double")).alias("pdms_scaled"))
    writers.jsonl(rows, path)
    return readers.rollouts(spark, path, "token string, pdms double, pdms_scaled double")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS pos, o_orderkey::VARCHAR AS token FROM orders")
def manifest_round_trip(spark, sf_dir):
    path = scratch(spark, "manifest")
    writers.manifest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("token"), "o_orderkey"), path, order="o_orderkey")
    return readers.manifest(spark, path).select(F.col("pos").cast("long").alias("pos"), "token")


@query("SELECT DISTINCT l_orderkey::VARCHAR AS token FROM lineitem")
def token_set_round_trip(spark, sf_dir):
    """The first columns of a tab-separated file, once each."""
    path = scratch(spark, "tokens")
    table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).write.text(path)
    return readers.token_set(spark, path).toDF("token")


@query("SELECT c_custkey::VARCHAR AS token, coalesce(round(c_acctbal / 10000, 4), 0) AS pdms, 0.0::DOUBLE AS pdms_scaled FROM customer")
def scores_round_trip(spark, sf_dir):
    """Score rows as CSV with missing metrics as 0, read again with numeric columns."""
    path = scratch(spark, "scores")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("token"), F.round(F.col("c_acctbal") / 10000, 4).alias("pdms"), F.lit(None).cast("double").alias("pdms_scaled"))
    writers.scores(rows, path)
    return spark.read.option("header", True).schema("token string, pdms double, pdms_scaled double").csv(path)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def dataset_split(spark, sf_dir):
    """One split of a partitioned table, by the name path@split."""
    path = scratch(spark, "dataset")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split"))
    writers.parquet(rows, path)
    return readers.dataset(spark, f"{path}@train").select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey AS a, s_nationkey AS b FROM supplier")
def nested_round_trip(spark, sf_dir):
    """Columns named by path as structs, written as JSON and flattened again."""
    path = scratch(spark, "nested")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key/supplier"), F.col("s_nationkey").alias("key/nation"))
    writers.jsonl(rows.select(*writers.nested(rows.columns)), path)
    back = spark.read.schema("key struct<supplier:bigint,nation:bigint>").json(path)
    return writers.flattened(back).toDF("a", "b")


@query("""
SELECT budget, count(*)::BIGINT AS n, max(token) AS last FROM (
  SELECT *, row_number() OVER (ORDER BY learnability DESC, token) AS place FROM (
    SELECT o_custkey AS token, (1 - avg(o_totalprice / 500000)) * (max(o_totalprice / 500000) - avg(o_totalprice / 500000)) AS learnability FROM orders GROUP BY 1)) JOIN (SELECT unnest([10, 40]) AS budget) ON place <= budget GROUP BY 1""")
def budgets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("token"), (F.col("o_totalprice") / 500000).alias("pdms_scaled"))
    top = groups.top_budgets(groups.learnability_ranking(rows), [10, 40])
    parts = [frame.select(F.lit(budget).alias("budget"), "token") for budget, frame in top.items()]
    return parts[0].unionByName(parts[1]).groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.max("token").alias("last"))


# estimators over tokens


@query(f"""
WITH t AS ({TOKENS}), z AS (SELECT avg(s) AS mean, var_samp(s) AS var FROM (
  SELECT m, sum(r) OVER (PARTITION BY uid, seg ORDER BY i DESC) AS s FROM (SELECT *, sum(1 - m) OVER (PARTITION BY uid ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM t)) WHERE m = 1),
x AS (SELECT uid, i, m, sum(r) OVER (PARTITION BY uid, seg ORDER BY i DESC) AS s FROM (SELECT *, coalesce(sum(1 - m) OVER (PARTITION BY uid ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM t))
SELECT uid, round(sum(s * m), 6) AS returns, round(sum((s - (SELECT avg(s) FROM x WHERE m = 1)) / sqrt((SELECT var_samp(s) FROM x WHERE m = 1) + 1e-8) * m), 3) AS advantages FROM x GROUP BY uid""")
def reinforce_plus_plus(spark, sf_dir):
    """Returns in reverse, reset where the mask is 0, whitened over all live tokens."""
    out = advantages.advantage(user_tokens(spark, sf_dir), "reinforce_plus_plus")
    total = lambda c, places: F.round(F.aggregate(F.zip_with(c, "mask", lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x), places)
    return out.select("uid", total("returns", 6).alias("returns"), total("advantages", 3).alias("advantages"))


@query(f"""
WITH t AS ({TOKENS} WHERE event_type <> 'click'),
a AS (SELECT uid, i, v, sum(r) OVER (PARTITION BY uid ORDER BY i DESC) - v AS adv FROM t)
SELECT uid, round(sum(adv + v), 6) AS returns, round(sum((adv - (SELECT avg(adv) FROM a)) / sqrt((SELECT var_samp(adv) FROM a) + 1e-8)), 3) AS advantages FROM a GROUP BY uid""")
def generalised_advantages(spark, sf_dir):
    """With gamma and lambda 1 the advantage of a token is the sum of the rewards from it on less its value."""
    rows = user_tokens(spark, sf_dir)
    live = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("x"), F.col("mask").alias("m")), lambda z: z["m"] == 1), lambda z: z["x"])
    rows = rows.select("uid", live("token_rewards").alias("token_rewards"), live("values").alias("values")).where(F.size("values") > 0).withColumn("mask", F.transform("values", lambda x: F.lit(1)))
    out = advantages.advantage(rows, "gae")
    total = lambda c, places: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), places)
    return out.select("uid", total("returns", 6).alias("returns"), total("advantages", 3).alias("advantages"))


@query(f"WITH t AS ({TOKENS}) SELECT round(avg(r), 6) AS mean, round(var_samp(r), 6) AS variance FROM t WHERE m = 1")
def masked_moments(spark, sf_dir):
    out = metrics.masked_moments(user_tokens(spark, sf_dir), "token_rewards", "mask")
    return rounded(out.toDF(*["mean", "variance"][: len(out.columns)]))


@query(f"""
WITH t AS ({TOKENS}) SELECT 'token' AS mode, round(avg(r), 6) AS loss FROM t WHERE m = 1
UNION ALL SELECT 'seq', round(avg(a), 6) FROM (SELECT uid, coalesce(sum(r * m) / (sum(m) + 1e-8), 0) AS a FROM t GROUP BY uid)""")
def average_losses(spark, sf_dir):
    rows = user_tokens(spark, sf_dir)
    one, two = (metrics.average_loss(rows, "token_rewards", "mask", mode) for mode in ("token", "seq"))
    return rounded(one.select(F.lit("token").alias("mode"), F.col(one.columns[0]).alias("loss")).unionByName(two.select(F.lit("seq").alias("mode"), F.col(two.columns[0]).alias("loss"))))


@query("""
SELECT event_id, round(greatest(-0.3 * a, least(1e9, 0.0)), 6) AS penalty, round(clipped, 6) AS clipped FROM (
  SELECT event_id, value / 500 AS a, CASE WHEN value / 5 <= 40 THEN 0.0::DOUBLE WHEN value / 5 <= 90 THEN -(value / 5 - 40) / 50 ELSE -1.0::DOUBLE END AS clipped FROM events)""")
def length_penalties(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("a"), (F.col("value") / 5).alias("n"))
    return rounded(rows.select("event_id", F.greatest(-0.3 * F.col("a"), F.lit(0.0)).alias("penalty"), S.soft_length_penalty(F.col("n"), 90, 50).alias("clipped")))


@query("""
SELECT o_orderkey, CASE WHEN isnan(x) THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)) END AS clipped,
  CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE x END AS filtered FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice / 250000 END AS x, (o_orderkey % 5)::DOUBLE AS h FROM orders)""")
def clipped_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 250000).alias("x"), (F.col("o_orderkey") % 5).cast("double").alias("h"))
    return rows.select("o_orderkey", S.clip01(F.col("x")).alias("clipped"), S.human_filtered(F.col("x"), F.col("h")).alias("filtered"))


# windows


@query("""
SELECT user_id, event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
FROM (SELECT *, CASE WHEN event_type = 'click' THEN value END AS x FROM events)""")
def forward_filled(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_type") == "click", F.col("value")))
    out = scenes.forward_filled(events, "user_id", ["ts", "event_id"], "x")
    return out.select("user_id", "event_id", F.col("x").alias("filled"))


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN best > 5 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / best)) ELSE 1.0::DOUBLE END, 6) AS progress
FROM (SELECT *, max(l_quantity * (l_returnflag <> 'R')::INT) OVER (PARTITION BY l_orderkey) AS best FROM lineitem)""")
def normalised_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), "l_linenumber", F.col("l_quantity").alias("progress"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("gate"))
    out = scenes.normalised_progress(rows)
    return rounded(out.select(F.col("token").alias("l_orderkey"), "l_linenumber", F.col(out.columns[-1]).alias("progress")))


# manifests


@query("""
SELECT o_orderkey AS token, CASE WHEN o_orderkey % 3 = 0 THEN 'dev' ELSE 'train' END AS part FROM orders""")
def routed_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"))
    train, dev = manifests.routed(orders, orders.where("token % 3 <> 0"), orders.where("token % 3 = 0"))
    return train.withColumn("part", F.lit("train")).unionByName(dev.withColumn("part", F.lit("dev")))


@query("""
SELECT o_custkey AS log_name, list(o_orderkey ORDER BY o_orderkey) AS tokens FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1""")
def pending_tokens(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log_name"), F.col("o_orderkey").alias("token"))
    out = manifests.pending(orders, orders.where("token % 4 = 0").select("token"))
    return out.select(F.col(out.columns[0]).alias("log_name"), F.sort_array(F.col(out.columns[1])).alias("tokens"))


@query("""
SELECT o_orderkey AS token FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 = 0""")
def two_stage_tokens(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), "o_orderstatus")
    return manifests.two_stage_tokens(orders.where("o_orderstatus = 'F'").select("token"), orders.where("o_orderstatus <> 'F'").select("token"), orders.where("token % 5 = 0").select("token")).select("token").distinct()


# batches over tables that grow


def lines(spark, sf_dir):
    return batch.indexed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).drop("l_extendedprice")


LINES = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem"


@query(f"SELECT pos, l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({LINES})")
def indexed_lines(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"SELECT epoch, batch, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM (SELECT *, floor(pos / 1000)::BIGINT AS batch FROM ({LINES})), (SELECT unnest(range(2)) AS epoch) GROUP BY 1, 2")
def mini_batches(spark, sf_dir):
    out = batch.mini_batches(lines(spark, sf_dir), 1000, epochs=2)
    return out.groupBy(F.col("epoch").cast("long").alias("epoch"), F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"SELECT pos, l_orderkey, l_linenumber, l_partkey, l_quantity, l_partkey % 10 AS bin FROM ({LINES})")
def zipped_lines(spark, sf_dir):
    a = lines(spark, sf_dir)
    return batch.zipped(a, a.select("pos", "l_orderkey", (F.col("l_partkey") % 10).alias("bin")))


@query(f"SELECT (pos - 100) // 7 AS pos, l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({LINES}) WHERE pos >= 100 AND pos < 2000 AND (pos - 100) % 7 = 0")
def sliced_lines(spark, sf_dir):
    return batch.sliced(lines(spark, sf_dir), 100, 2000, 7)


@query(f"WITH n AS (SELECT max(pos) AS top FROM ({LINES})) SELECT top - pos AS pos, l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({LINES}), n")
def reversed_lines(spark, sf_dir):
    a = lines(spark, sf_dir)
    top = a.agg(F.max("pos")).first()[0]
    return batch.taken(a, a.select((F.lit(top) - F.col("pos")).alias("at"), "pos"))


@query(f"SELECT pos * 2 + k AS pos, l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({LINES}), range(2) r(k)")
def repeated_lines(spark, sf_dir):
    return batch.repeated(lines(spark, sf_dir), 2)


# texts


@query("""
SELECT o_orderkey, 2 AS n, o_custkey / 4.0::DOUBLE AS x, -o_custkey / 8.0::DOUBLE AS y, true AS parsed_ok, o_orderkey % 3 AS digit, CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS boxed FROM orders""")
def parsed_answers(spark, sf_dir):
    """Answers written as texts and parsed again: points, fenced JSON, a digit, a boxed result."""
    o = F.col("o_orderkey")
    number = lambda c: F.format_string("%.3f", c)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") / 4).alias("a"), (-F.col("o_custkey") / 8).alias("b"))
    point = F.concat(F.lit("["), number(F.col("a")), F.lit(", "), number(F.col("b")), F.lit("]"))
    planned = F.concat(F.lit("I plan <PLANNING>"), point, F.lit(", "), point, F.lit("</PLANNING>"))
    triple = F.concat(F.lit("("), number(F.col("a")), F.lit(", "), number(F.col("b")), F.lit(", 0.0)"))
    body = F.concat(F.lit('```json\n{"explanation": "go", "trajectory": "['), triple, F.lit(']"}\n```'))
    boxed = F.when(o % 2 == 0, F.lit("<think>so</think> \\boxed{7}")).otherwise(F.lit("seven"))
    parsed = orders.select("o_orderkey", T.planned_pairs(planned, n=2).alias("p"), T.json_trajectory(body).alias("j"), T.choice_digit(F.concat(F.lit("it is "), (o % 3).cast("string"))).alias("d"), T.boxed_format(boxed).alias("f"))
    first = F.element_at("p", 1)
    return parsed.select("o_orderkey", F.size("p").alias("n"), first["x"].alias("x"), first["y"].alias("y"), F.col("j.parsed_ok").alias("parsed_ok"), F.col("d").cast("long").alias("digit"), F.col("f").cast("double").alias("boxed"))


@query("""
SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE 1 END + CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN turn % 2 = 0 THEN 'image' ELSE 'text' END AS last
FROM conversations WHERE text NOT LIKE '%<image>%' AND text NOT LIKE '%<video>%' AND length(text) > 0""")
def content_parts(spark, sf_dir):
    """Turns with images put before and after them, as typed parts."""
    rows = table(spark, sf_dir, "conversations").where("text NOT LIKE '%<image>%' AND text NOT LIKE '%<video>%' AND length(text) > 0")
    prompt = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), F.col("text"), F.lit("<image>"))).otherwise(F.col("text"))
    parts = rows.select("conv_id", "turn", T.content_parts(prompt).alias("p"))
    return parts.select("conv_id", "turn", F.size("p").alias("n"), F.element_at("p", -1)["type"].alias("last"))


# geometry


@query("""
SELECT o_orderkey, round((x - 5) * cos(0.3) + (y - 2) * sin(0.3), 4) AS rx, round(-(x - 5) * sin(0.3) + (y - 2) * cos(0.3), 4) AS ry, round(x, 3) AS gx, round(y, 3) AS gy FROM (
  SELECT o_orderkey, o_custkey::DOUBLE / 100 AS x, o_totalprice / 1e5 + 1e-5 AS y FROM orders)""")
def frames_of_reference(spark, sf_dir):
    """Poses seen from another pose, and back."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(G.pose(F.col("o_custkey").cast("double") / 100, F.col("o_totalprice") / 1e5 + 1e-5, F.lit(0.1))).alias("p"), G.pose(F.lit(5.0), F.lit(2.0), F.lit(0.3)).alias("o"))
    seen = rows.withColumn("r", G.to_relative(F.col("p"), F.col("o")))
    seen = seen.withColumn("g", G.to_global(F.col("r"), F.col("o")))
    one = lambda c, f: F.element_at(c, 1)[f]
    return rounded(seen.select("o_orderkey", F.round(one("r", "x"), 4).alias("rx"), F.round(one("r", "y"), 4).alias("ry"), F.round(one("g", "x"), 3).alias("gx"), F.round(one("g", "y"), 3).alias("gy")))


@query("""
SELECT o_orderkey, round(least(d, 20.0), 6) AS x, round(greatest(0.0, least(d - 20.0, 10.0)), 6) AS y, round(least(30.0, 20.0 + d / 10), 6) AS along FROM (SELECT o_orderkey, (o_custkey % 40)::DOUBLE AS d FROM orders)""")
def places_on_a_path(spark, sf_dir):
    """A path of two legs: the point at a distance, and the distance of a point beside its second leg."""
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    path = F.array(corner(0.0, 0.0), corner(20.0, 0.0), corner(20.0, 10.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("double").alias("d"), path.alias("p"))
    at = G.at_distance(F.col("p"), F.col("d"))
    return rounded(rows.select("o_orderkey", at["x"].alias("x"), at["y"].alias("y"), G.projected(F.col("p"), F.lit(23.0), F.col("d") / 10).alias("along")))


@query("""
SELECT a.s_suppkey AS aid, b.s_suppkey AS bid FROM supplier a JOIN supplier b
ON abs(a.s_acctbal - b.s_acctbal) <= 300 AND abs(a.s_nationkey - b.s_nationkey) <= 1""")
def overlapping_boxes(spark, sf_dir):
    """Suppliers as boxes of 300 by 1 about their balance and nation."""
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(300.0).alias("width"), F.lit(1.0).alias("height"))
    return spatial.boxes_overlapping(boxes, boxes, 100.0)


# plug-ins and graphs


def halved(rows: list[dict]) -> list[float]:
    return [r["o_totalprice"] / 2 for r in rows]


@query("SELECT o_orderkey, o_totalprice / 2 AS reward FROM orders")
def reward_plugin(spark, sf_dir):
    """A batch reward function as a column."""
    return table(spark, sf_dir, "orders").select("o_orderkey", registry.reward_column(halved, "batch", "o_totalprice").alias("reward"))


@query("""
SELECT l_orderkey AS token, l_linenumber AS line, CASE WHEN l_orderkey % 10 = 0 THEN 0.0::DOUBLE ELSE count(*) OVER (PARTITION BY l_orderkey) END AS score FROM lineitem""")
def scored_groups(spark, sf_dir):
    """Rows scored with all of their group; groups on which the scorer fails get zero rows."""

    def scorer(rows: list[dict]) -> list[dict]:
        if rows[0]["token"] % 10 == 0:
            raise RuntimeError("no score")
        return [{"token": r["token"], "line": r["line"], "score": float(len(rows))} for r in rows]

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), F.col("l_linenumber").alias("line"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return registry.scored_by_group(rows, scorer, "token", f"{kinds}, score double", lambda r: {"token": r["token"], "line": r["line"], "score": 0.0}, threads=4)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey % 5) % 97 AS dst FROM orders WHERE o_custkey < 97),
w(node, depth) AS (SELECT 1, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 30)
SELECT '1' AS start, node::VARCHAR AS node, min(depth) AS depth FROM w GROUP BY 2""")
def reach_30(spark, sf_dir):
    """A search over thirty levels."""
    orders = table(spark, sf_dir, "orders").where("o_custkey < 97")
    edges = orders.select(F.col("o_custkey").cast("string").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % 97).cast("string").alias("dst"))
    return graph.reached(edges, spark.createDataFrame([("1",)], "node string"), 30)


# the scorer: customers stand for states, nations for map polygons


def map_polygons(spark, sf_dir):
    n = F.col("n_nationkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    low, high = n * 400 - 1000, n * 400 - 300
    ring = F.array(corner(low, F.lit(-1)), corner(high, F.lit(-1)), corner(high, F.lit(30)), corner(low, F.lit(30)))
    kind = F.element_at(F.array(F.lit("LANE"), F.lit("ROADBLOCK"), F.lit("LANE_CONNECTOR"), F.lit("INTERSECTION")), n % 4 + 1)
    return table(spark, sf_dir, "nation").select(n.alias("gid"), kind.alias("kind"), (n % 3 != 0).alias("on_route"), ring.alias("ring"))


def states(spark, sf_dir):
    """A box of 200 by 1 around each customer, as corners and centre."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), (F.col("c_custkey") % 3).alias("proposal"), F.col("c_custkey").alias("step"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") + 0.25).alias("y"))
    shift = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(100.003, 0.5), (-100.003, 0.5), (-100.003, -0.5), (100.003, -0.5), (0.003, 0.0)])])
    each = c.withColumn("s", F.explode(shift))
    return each.select("scene", "proposal", "step", "s.corner", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))


AREAS = """
WITH p AS (SELECT n_nationkey AS gid, ['LANE', 'ROADBLOCK', 'LANE_CONNECTOR', 'INTERSECTION'][n_nationkey % 4 + 1] AS kind, n_nationkey % 3 <> 0 AS on_route, n_nationkey * 400 - 1000 AS low, n_nationkey * 400 - 300 AS high FROM nation),
s AS (SELECT c_nationkey AS scene, c_custkey % 3 AS proposal, c_custkey AS step, c_acctbal AS x FROM customer),
k AS (SELECT scene, proposal, step, unnest([0, 1, 2, 3, 4]) AS corner, x + unnest([100.003, -100.003, -100.003, 100.003, 0.003])::DOUBLE AS x FROM s),
h AS (SELECT k.scene, k.proposal, k.step, gid, kind, on_route, count(*) FILTER (corner < 4) AS n, list(corner) FILTER (corner < 4) AS corners, bool_or(corner = 4) AS centre
      FROM k JOIN p ON k.x > low AND k.x < high GROUP BY ALL),
a AS (SELECT scene, proposal, step, count(*) FILTER (kind IN ('LANE', 'LANE_CONNECTOR') AND n > 0) AS lanes, coalesce(max(n) FILTER (kind IN ('LANE', 'LANE_CONNECTOR')), 0) AS most,
             len(list_distinct(flatten(coalesce(list(corners) FILTER (kind IN ('ROADBLOCK', 'INTERSECTION') AND n > 0), [])))) AS covered,
             coalesce(bool_or(kind IN ('LANE', 'LANE_CONNECTOR') AND on_route AND centre), false) AS routed, coalesce(bool_or(kind = 'INTERSECTION' AND centre), false) AS crossing FROM h GROUP BY ALL),
areas AS (SELECT s.scene, s.proposal, s.step, coalesce(lanes, 0) > 1 AND coalesce(most, 0) <> 4 AS multiple_lanes, coalesce(covered, 0) <> 4 AS off_road, NOT coalesce(routed, false) AS oncoming, coalesce(crossing, false) AS crossing
          FROM s LEFT JOIN a USING (scene, proposal, step))"""


@query(f"{AREAS} SELECT * FROM areas")
def ego_areas(spark, sf_dir):
    return scorer.ego_areas(states(spark, sf_dir), map_polygons(spark, sf_dir), 100.0)


@query(f"{AREAS} SELECT scene, proposal, CASE WHEN bool_or(off_road) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM areas GROUP BY 1, 2")
def on_road(spark, sf_dir):
    return scorer.on_road(ego_areas(spark, sf_dir))


def collisions(spark, sf_dir):
    """Line items as contacts of their order's proposals."""
    kind = F.when(F.col("l_returnflag") == "R", "active_front").when(F.col("l_returnflag") == "A", "active_lateral").otherwise("active_rear")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene"), (F.col("l_suppkey") % 3).alias("proposal"), F.col("l_linenumber").alias("step"), (F.col("l_partkey") % 4).alias("track"), kind.alias("kind"), (F.col("l_partkey") % 2 == 0).alias("agent"),
        (F.col("l_quantity") > 25).alias("multiple_lanes"), F.lit(False).alias("off_road"), (F.col("l_discount") > 0.05).alias("crossing"), (F.col("l_tax") * 100 - 1).alias("speed"), (F.col("l_returnflag") == "R").alias("ahead"), (F.col("l_linestatus") == "F").alias("behind"),
    )


CONTACTS = """
WITH c AS (SELECT l_orderkey AS scene, l_suppkey % 3 AS proposal, l_linenumber AS step, l_partkey % 4 AS track, l_partkey % 2 = 0 AS agent, l_quantity > 25 AS loose, l_discount > 0.05 AS crossing,
                  l_tax * 100 - 1 AS speed, l_returnflag AS flag, l_linestatus = 'F' AS behind FROM lineitem),
a AS (SELECT scene, proposal, step, bool_or(loose) AS loose, bool_or(crossing) AS crossing FROM c GROUP BY 1, 2, 3)"""


def states_of(met: DataFrame) -> DataFrame:
    names = ("multiple_lanes", "off_road", "crossing")
    return met.groupBy("scene", "proposal", "step").agg(*[F.max(n).alias(n) for n in names])


@query(f"""{CONTACTS},
f AS (SELECT c.scene, c.proposal, step, track, agent, flag = 'R' OR (flag = 'A' AND a.loose) AS fault FROM c JOIN a USING (scene, proposal, step)),
h AS (SELECT *, min(CASE WHEN NOT fault THEN step END) OVER (PARTITION BY scene, proposal, track) AS passed FROM f)
SELECT scene, proposal, min(CASE WHEN fault AND (passed IS NULL OR step < passed) THEN CASE WHEN agent THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 1.0::DOUBLE END) AS score,
  min(CASE WHEN fault AND (passed IS NULL OR step < passed) THEN step END) AS first FROM h GROUP BY 1, 2""")
def no_fault_collisions(spark, sf_dir):
    met = collisions(spark, sf_dir)
    return scorer.no_fault(met.select("scene", "proposal", "step", "track", "kind", "agent"), states_of(met), met)


@query(f"""{CONTACTS},
f AS (SELECT c.scene, c.proposal, step, track, flag = 'R' OR ((a.loose OR a.crossing) AND NOT behind) AS fault FROM c JOIN a USING (scene, proposal, step) WHERE speed >= 0.005),
h AS (SELECT *, min(CASE WHEN NOT fault THEN step END) OVER (PARTITION BY scene, proposal, track) AS passed FROM f),
b AS (SELECT scene, proposal, min(step) AS first FROM h WHERE fault AND (passed IS NULL OR step < passed) GROUP BY 1, 2)
SELECT scene, proposal, CASE WHEN first IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, first FROM (SELECT DISTINCT scene, proposal FROM c) LEFT JOIN b USING (scene, proposal)""")
def time_to_collision(spark, sf_dir):
    met = collisions(spark, sf_dir)
    contacts = met.select("scene", "proposal", "step", F.lit(0).alias("later"), "track", "speed", "ahead", "behind")
    return scorer.time_to_collision(contacts, states_of(met), met)


@query("""SELECT l_orderkey AS scene, l_suppkey % 3 AS proposal, CASE WHEN bool_or(l_returnflag = 'A') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM lineitem GROUP BY 1, 2""")
def red_lights(spark, sf_dir):
    met = collisions(spark, sf_dir)
    token = F.concat(F.when(F.col("kind") == "active_lateral", "red_light_").otherwise("track_"), F.col("track").cast("string"))
    return scorer.lights(met.withColumn("track", token), met)


@query("""
WITH f AS (SELECT user_id AS scene, row_number() OVER w AS step, value / 100 AS x, value / 100 - lag(value / 100) OVER w AS dx, event_type <> 'click' AS oncoming, event_id % 5 = 0 AS crossing FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT scene, sum(CASE WHEN oncoming AND NOT crossing THEN abs(coalesce(dx, 0)) ELSE 0 END) OVER (PARTITION BY scene ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM f),
r AS (SELECT scene, step - row_number() OVER (PARTITION BY scene, x > 2 ORDER BY step) AS g, x > 2 AS beside FROM (SELECT scene, x, row_number() OVER (PARTITION BY scene ORDER BY step) AS step FROM f WHERE NOT crossing)),
k AS (SELECT scene, max(n) AS longest FROM (SELECT scene, g, count(*) AS n FROM r WHERE beside GROUP BY 1, 2) GROUP BY 1)
SELECT scene, CASE WHEN max(s) < 2 THEN 1.0::DOUBLE WHEN max(s) < 6 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS direction, CASE WHEN coalesce(max(longest), 0) >= 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS lanes FROM s LEFT JOIN k USING (scene) GROUP BY 1""")
def direction_and_lanes(spark, sf_dir):
    """Events of a user as states of one proposal."""
    from pyspark.sql import Window as W

    step = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    each = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene"), F.lit(0).alias("proposal"), step.alias("step"), (F.col("value") / 100).alias("x"), F.lit(0.0).alias("y"), (F.col("event_type") != "click").alias("oncoming"), (F.col("event_id") % 5 == 0).alias("crossing"))
    centres, areas = each.select("scene", "proposal", "step", "x", "y", F.col("x").alias("deviation")), each.select("scene", "proposal", "step", "oncoming", "crossing")
    one, two = scorer.direction(centres, areas, 3).withColumnRenamed("score", "direction"), scorer.lane_keeping(centres, areas, 4, beside=2.0).withColumnRenamed("score", "lanes")
    return one.join(two, ["scene", "proposal"], "left").select("scene", "direction", F.coalesce("lanes", F.lit(1.0)).alias("lanes"))


@query("""
WITH m AS (SELECT l_orderkey AS scene, l_linenumber AS proposal, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS gate, l_quantity / 5 AS p, l_discount * 10 AS ttc, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lk, l_tax * 12.5 AS hc FROM lineitem),
b AS (SELECT *, max(p * gate) OVER (PARTITION BY scene) AS best FROM m),
n AS (SELECT *, CASE WHEN best > 5 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, p / best)) ELSE 1.0::DOUBLE END AS share FROM b)
SELECT scene, proposal, round(share, 6) AS progress, round(gate * (5 * share + 5 * ttc + 2 * lk + 2 * hc) / 14, 6) AS score FROM n""")
def proposal_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("proposal"), F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0).alias("no_fault"), F.lit(1.0).alias("on_road"), F.lit(1.0).alias("direction"), F.lit(1.0).alias("lights"),
        (F.col("l_quantity") / 5).alias("progress"), (F.col("l_discount") * 10).alias("ttc"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("lane_keeping"), (F.col("l_tax") * 12.5).alias("comfort"),
    )
    return rounded(scorer.score_proposals(rows))


@query("""
WITH o AS (SELECT l_orderkey AS scene, CASE WHEN l_returnflag = 'R' THEN 'red_light_' ELSE 'car_' END || l_partkey AS token, l_quantity AS progress, l_extendedprice / 1000 AS distance, l_tax * 100 AS speed, l_discount AS heading FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY distance, token) AS place FROM o WHERE progress > 20)
SELECT o_orderkey AS scene, token, round(coalesce(20 + distance, 80.0), 6) AS lead_progress, round(CASE WHEN token IS NULL OR token LIKE 'red_light%' THEN 0.0 ELSE speed * cos(heading - 0.1) END, 6) AS lead_velocity
FROM orders LEFT JOIN n ON scene = o_orderkey AND place = 1""")
def leading_objects(spark, sf_dir):
    """Line items as objects ahead on the path of their order."""
    token = F.concat(F.when(F.col("l_returnflag") == "R", "red_light_").otherwise("car_"), F.col("l_partkey").cast("string"))
    objects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.lit(0).alias("proposal"), token.alias("token"), F.col("l_quantity").alias("progress"), (F.col("l_extendedprice") / 1000).alias("distance"), (F.col("l_tax") * 100).alias("speed"), F.col("l_discount").alias("heading"))
    proposals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), F.lit(0).alias("proposal"), F.lit(20.0).alias("ego_progress"), F.lit(0.1).alias("ego_heading"), F.lit(80.0).alias("path_length"))
    return rounded(simulation.leading(objects, proposals).drop("proposal"))


@query("""
SELECT c_nationkey AS scene, c_custkey AS agent, step, round(c_acctbal + 2.5 * step * 0.5, 6) AS x, round(c_custkey - step * 0.5, 6) AS y
FROM customer, range(0, 5) t(step) WHERE c_custkey % 7 <> 0""")
def observed_agents(spark, sf_dir):
    """Customers in straight motion, without those that overlap at the start."""
    agents = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("agent"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.lit(2.5).alias("vx"), F.lit(-1.0).alias("vy"), F.lit(0.0).alias("heading"))
    out = simulation.observed(agents, agents.where("agent % 7 = 0").select("scene", "agent"), 4, 0.5)
    return rounded(out.select("scene", "agent", F.col("step").cast("long").alias("step"), "x", "y"))


@query("""
SELECT c_nationkey AS scene, c_custkey AS step, later, round(c_acctbal + 0.5 * cos(0.3) * 3 * later, 4) AS x, round(0.5 * sin(0.3) * 3 * later, 4) AS y FROM customer, (SELECT unnest([0, 3, 6, 9]) AS later)""")
def moved_boxes(spark, sf_dir):
    """The first corner of each customer's box, moved on at its speed."""
    corner = F.struct(F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    boxes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.lit(0).alias("proposal"), F.col("c_custkey").alias("step"), F.array(corner).alias("ring"), F.lit(3.0).alias("speed"), F.lit(0.3).alias("heading"))
    out = scorer.moved_boxes(boxes, [0, 3, 6, 9], 0.5)
    first = F.element_at("ring", 1)
    return rounded(out.select("scene", F.col("begin").alias("step"), "later", first["x"].alias("x"), first["y"].alias("y")), 4)

"""Near-duplicate components by bottom-k sketches and inverted lists.

One hash function orders the shingles of a document; the ``SKETCH`` smallest hashes are its sketch (a smaller set is
kept whole). Documents with equal sets form a class at once, so copies never meet in pairs.

* Candidates. Two sets of Jaccard similarity 0.85 or more share at least ``SHARED`` sketch values, but for a chance
  below 1e-9 (for sets kept whole: exactly). So it is enough to enter each class into the inverted lists of the
  sketch values that stand first in one common order, all but SHARED - 1 of them. The order puts values that many
  classes share last, so a passage in a third of all documents makes no list unless it is most of a document.
* Leaders. Within each list every class is held against the leader only, the one whose sketch the others share most:
  a number of pairs linear in the lists. Verified links give first components, in which groups of near copies meet.
* The rest. In short lists, pairs of different components are joined. In long ones (over ``LONG`` members) sets are
  told apart by their differences from the leader h: with R = h - A, U = A - h and D = R + U, two sets share
  |h| - |Ra| - |Rb| + |Da & Db| shingles. A class that is not linked with the leader can only be linked with one whose
  own differences it shares about half of, so an index over the rarest differences finds these pairs, and a group of
  thousands of near copies makes next to none. This is exact: no partner is dropped and no list is capped.
* Filters. The union sketch estimates the similarity of each candidate pair, and full sets, recomputed from the texts
  of the classes that still have candidates, decide.

Components come from hooking and pointer jumping on stored tables; nothing is gathered on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import ascii_lower, broadcast_if_small, read, row_keys, small, stored

SHINGLE = 3
PERCENT = 85
SKETCH = 64
SHARED = 33
#: The same for a similarity of 0.8.
SHARED_80 = 30
#: Chance of missing a link by the sketch bound, where it is derived for another similarity.
CHANCE = 1e-10
#: From how many classes on a sketch value moves to the end of the order.
FREQUENT = 8
#: Members from which on a list is searched by differences from its leader.
LONG = 16


def shared_values(percent: int, sketch: int = SKETCH) -> int:
    """How many of the ``sketch`` least values of their union two sets of a similarity share at least, but for CHANCE."""
    if sketch == SKETCH and percent in (85, 80):
        return {85: SHARED, 80: SHARED_80}[percent]
    j, below = percent / 100, 0.0
    for t in range(sketch + 1):
        below += math.comb(sketch, t) * j**t * (1 - j) ** (sketch - t)
        if below > CHANCE:
            return max(t, 1)
    return sketch


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def shingle_set(words: Column, shingle: int = SHINGLE) -> Column:
    """The sorted distinct hashes of the shingles; fewer words make one shingle, none an empty set. ``words`` is a column."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (shingle - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(shingle)]))
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    none = F.array().cast("array<bigint>")
    return F.sort_array(F.array_distinct(F.when(F.size(words) >= shingle, grams).when(F.size(words) > 0, short).otherwise(none)))


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b): the smallest vertex it is connected with.

    Each round hooks every vertex to its smallest neighbour, follows the pointers to their roots, and contracts the
    links to roots; at least half of the vertices that still have links go in each round.
    """
    both = links.select("a", "b").where("a <> b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = None

    def jump(hooked: DataFrame) -> DataFrame:
        x, y = hooked.alias("x"), hooked.alias("y")
        return x.join(y, F.col("x.root") == F.col("y.v"), "left").select(F.col("x.v").alias("v"), F.col("x.root").alias("old"), F.coalesce("y.root", "x.root").alias("root"))

    while not both.isEmpty():
        hooked = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "hooks")
        while True:  # each pass follows a pointer twice, so paths shrink to a quarter
            jumped = stored(jump(jump(hooked).select("v", "root")), "jumps")
            hooked = jumped.select("v", "root")
            if jumped.where("old <> root").isEmpty():
                break
        if roots is None:
            roots = hooked
        else:
            moved = roots.alias("x").join(hooked.alias("y"), F.col("x.root") == F.col("y.v"), "left")
            roots = stored(moved.select(F.col("x.v").alias("v"), F.coalesce("y.root", "x.root").alias("root")), "roots")
        at = hooked.withColumnRenamed("v", "a").withColumnRenamed("root", "ra")
        bt = hooked.withColumnRenamed("v", "b").withColumnRenamed("root", "rb")
        both = stored(both.join(at, "a").join(bt, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if roots is None:
        return links.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    return roots


class Linker:
    """Finds the links between the classes of a corpus."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, sketch: int, shared: int):
        self.docs, self.text_col, self.shingle, self.percent, self.k, self.t = docs, text_col, shingle, percent, sketch, shared
        self.ids = [F.col(id_col), F.col(text_col)]
        k1, k2 = row_keys(*self.ids)
        sets = docs.select(F.col(id_col).alias("doc_id"), k1, k2, words_of(F.col(text_col)).alias("words"))
        sets = sets.withColumn("set", shingle_set(F.col("words"), shingle))
        base = sets.select("doc_id", "k1", "k2", F.size("set").alias("n"), F.xxhash64("set").alias("v"), F.xxhash64(F.lit("set"), "set").alias("v2"), F.slice("set", 1, sketch).alias("sketch"))
        self.base = stored(base, "sketches")
        classes = self.base.where("n > 0").groupBy("v", "v2").agg(F.min("doc_id").alias("doc"), F.min(F.struct("k1", "k2")).alias("k"), F.count(F.lit(1)).alias("copies"))
        self.classes = stored(classes, "classes")
        repeated = self.classes.where("copies > 1").select("v", "k")
        others = self.base.where("n > 0").select("v", F.struct("k1", "k2").alias("own")).join(broadcast_if_small(repeated), "v").where(F.col("own") != F.col("k")).select("own").distinct()
        # equal rows share their keys too, so classes are made distinct once more
        reps = self.base.where("n > 0").join(broadcast_if_small(stored(others, "copies")), F.struct("k1", "k2") == F.col("own"), "left_anti")
        reps = reps.select("v", "k1", "k2", "n", "sketch")
        self.reps = stored(reps.dropDuplicates(["v"]) if not repeated.isEmpty() else reps, "reps")

    def need(self, n: Column) -> Column:
        """How many sketch values a class shares with any partner at least."""
        exact = F.ceil(n * F.lit(self.percent) / F.lit(100.0)).cast("int")
        return F.when(n * 100 < F.lit(self.k * self.percent), exact).otherwise(F.lit(self.t))

    def lists(self) -> DataFrame:
        """(value, v, n): the inverted lists, without those of one member."""
        counts = self.reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= 2)
        counts = stored(counts, "sketch-counts")
        often = counts.where(F.col("df") >= FREQUENT)
        hits = self.reps.select("v", F.explode("sketch").alias("value")).join(broadcast_if_small(often), "value").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("last"))
        hits = stored(hits, "sketch-last")
        first = self.reps.select("v", "n", "sketch").join(broadcast_if_small(hits, 20_000), "v", "left")
        last = F.coalesce(F.col("last")["value"], F.array().cast("array<bigint>"))
        order = F.concat(F.array_except("sketch", last), last)
        middle = F.coalesce(F.aggregate(F.col("last")["df"], F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0))
        entered = first.select("v", "n", middle.alias("middle"), F.explode(F.slice(order, F.lit(1), F.size("sketch") - self.need(F.col("n")) + 1)).alias("value"))
        leaders = entered.groupBy("value").agg(F.min(F.struct(-F.col("middle"), "v", "n")).alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
        leaders = stored(leaders, "list-leaders")
        joined = entered.join(broadcast_if_small(leaders), "value")
        return stored(joined.select("value", "v", "n", F.col("leader.v").alias("lv"), F.col("leader.n").alias("ln"), "members"), "lists")

    def alike_sizes(self, a: str, b: str) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose union sketch leaves the similarity possible."""
        ids = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
        sketches = self.reps.select("v", "n", "sketch").join(broadcast_if_small(ids), "v", "left_semi")
        sides = [sketches.select(F.col("v").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in ("a", "b")]
        met = pairs.join(sides[0], "a").join(sides[1], "b")
        union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, self.k)
        met = met.withColumn("u", union).withColumn("common", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))))
        # sets kept whole on both sides, with a union kept whole too, give the similarity itself
        whole = (F.col("na") <= self.k) & (F.col("nb") <= self.k)
        exact = F.size(F.array_intersect("sa", "sb")) * 100 >= F.size(F.array_union("sa", "sb")) * self.percent
        floor = F.ceil(F.size("u") * F.lit(self.t / self.k))
        return met.where(F.when(whole, exact).otherwise(F.col("common") >= floor)).select("a", "b")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(v, set): the full sets of the classes ``ids`` (v), from their texts."""
        rows = self.classes.select("v", "k.k1", "k.k2").join(broadcast_if_small(ids.distinct()), "v", "left_semi").dropDuplicates(["v"])
        k1, k2 = row_keys(*self.ids)
        words = self.docs.select(k1, k2, F.col(self.text_col).alias("text")).join(broadcast_if_small(rows), ["k1", "k2"]).select("v", words_of(F.col("text")).alias("words"))
        return stored(words.select("v", shingle_set(F.col("words"), self.shingle).alias("set")).dropDuplicates(["v"]), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, common, total) of the pairs, by full sets."""
        pairs = stored(pairs, "pairs")
        sets = self.sets_of(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))))
        sides = [sets.select(F.col("v").alias(x), F.col("set").alias(f"s{x}")) for x in ("a", "b")]
        met = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return stored(met.select("a", "b", "common", (F.size("sa") + F.size("sb") - F.col("common")).alias("total")), "verified")

    def differing(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of members (v, lv, comp) with one leader and different components that may be linked.

        With g = percent * |A| + (100 + percent) * |R| the sets are linked if and only if they share at least
        (g(a) + g(b) - (100 + percent) * |h|) / (100 + percent) differences, and a set is linked with the leader if
        and only if g <= 100 * |h|. Each member enters the index with its rarest differences, all but as many as any
        partner must share less one; members that are linked with the leader meet only those that are not.
        """
        p = self.percent
        pairs = stored(members.select("v", "lv", "comp").distinct(), "led")
        sets = self.sets_of(pairs.select("v").unionByName(pairs.select(F.col("lv").alias("v"))))
        mine, its = sets.select("v", "set"), sets.select(F.col("v").alias("lv"), F.col("set").alias("h"))
        met = pairs.join(mine, "v").join(its, "lv")
        r, u = F.array_except("h", "set"), F.array_except("set", "h")
        met = met.select("v", "lv", "comp", F.size("h").alias("h"), F.size("set").alias("n"), F.size(r).alias("r"), F.concat(r, u).alias("d"))
        g = F.col("n") * p + F.col("r") * (100 + p)
        most = F.ceil((g - F.col("h") * p + 1) / (100.0 + p))
        least = F.ceil((g - F.col("h") * 100) / (100.0 + p))
        apart = g > F.col("h") * 100
        met = met.withColumn("g", g).withColumn("apart", apart).withColumn("own", F.size("d") - most + 1).withColumn("reach", F.when(apart, F.size("d") - F.greatest(least, F.lit(1)) + 1).otherwise(F.col("own")))
        met = stored(met, "differences")
        each = met.select("lv", "v", F.explode("d").alias("x"))
        shared = stored(each.groupBy("lv", "x").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-differences")
        found = each.join(broadcast_if_small(shared), ["lv", "x"])
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lv", "v").orderBy("df", "x"))).withColumn("all", F.count(F.lit(1)).over(W.partitionBy("lv", "v")))
        info = met.select("lv", "v", "comp", "n", "h", "g", "apart", "own", "reach", F.size("d").alias("nd"))
        index = ranked.join(info, ["lv", "v"]).withColumn("at", F.col("nd") - F.col("all") + F.col("rank")).where("at <= reach")
        index = index.select("lv", "x", "v", "comp", "n", "h", "g", "apart", (F.col("at") <= F.col("own")).alias("near"), (F.col("nd") - F.col("at") + 1).alias("left"))
        index = stored(index, "difference-index")
        a, b = index.where("apart").alias("x"), index.alias("y")
        kinds = ~F.col("y.apart") | (F.col("x.near") & F.col("y.near") & (F.col("x.v") < F.col("y.v")))
        same = (F.col("x.lv") == F.col("y.lv")) & (F.col("x.x") == F.col("y.x")) & (F.col("x.comp") != F.col("y.comp"))
        # at the first difference that two sets share, those still to come have to suffice for what this pair needs
        enough = F.col("x.g") + F.col("y.g") - F.col("x.h") * (100 + p) <= F.least("x.left", "y.left") * (100 + p)
        return a.join(b, same & kinds & enough & self.alike_sizes("x.n", "y.n")).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()

    def links(self) -> DataFrame:
        """The verified links (a, b) that connect every component."""
        lists = self.lists()
        led = lists.where((F.col("v") != F.col("lv")) & self.alike_sizes("n", "ln")).select(F.col("lv").alias("a"), F.col("v").alias("b")).distinct()
        linked = F.col("common") * 100 >= F.col("total") * self.percent
        links = self.verified(self.estimated(stored(led, "pairs"))).where(linked).select("a", "b")
        comps = components(links)
        members = lists.where("members > 2").join(broadcast_if_small(comps), "v", "left").withColumn("comp", F.coalesce("root", "v")).drop("root")
        members = stored(members, "members")
        mixed = members.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
        open_ = stored(members.join(broadcast_if_small(stored(mixed, "mixed")), "value", "left_semi"), "open-lists").where("v <> lv")
        short = open_.where(F.col("members") <= LONG)
        x, y = short.alias("x"), short.alias("y")
        rest = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.comp") != F.col("y.comp")) & self.alike_sizes("x.n", "y.n"))
        rest = rest.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
        rest = stored(rest.unionByName(self.differing(open_.where(F.col("members") > LONG))).distinct(), "pairs")
        second = self.verified(self.estimated(rest)).where(linked).select("a", "b")
        return links.unionByName(second)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, sketch: int = SKETCH, shared: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id), and the row keys k1 and k2.

    Null and empty texts and texts of white space have no shingles and stay alone. Equal rows stay together: they get
    one component and one decision. A row without id joins its component but is not kept in the place of one that has
    an id; where all lack it, component_id is null. An empty table gives an empty table; other columns take no part.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    linker = Linker(docs, id_col, text_col, shingle, percent, sketch, shared or shared_values(percent, sketch))
    comps = components(linker.links())
    named = linker.classes.select("v", "v2", "doc").join(broadcast_if_small(comps), "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = stored(named, "named")
    ids = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stored(named.select("v", "v2", "root").join(broadcast_if_small(ids), "root").select("v", "v2", "component_id"), "named")
    rows = linker.base.select("doc_id", "k1", "k2", "n", "v", "v2")
    full = rows.where("n > 0").join(broadcast_if_small(named), ["v", "v2"]).select("doc_id", "k1", "k2", "n", "component_id")
    full = full.unionByName(rows.where("n = 0").select("doc_id", "k1", "k2", "n", F.col("doc_id").alias("component_id")))
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "k1", "k2")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("k1", "k2")


def near_duplicates_sql(docs: str, shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL over all pairs that share a shingle, for small tables."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM {docs}),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.to_id),
comp AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""


OP4_SQL = near_duplicates_sql("documents")

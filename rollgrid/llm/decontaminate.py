"""Benchmark decontamination over a positional inverted index.

1. Benchmark items become windows of ten consecutive words (an item of fewer words is one window).
2. One pass over the documents counts every benchmark word; each window keeps its ``LISTS`` rarest words.
3. A second pass stores postings (word hash, document, position) of those words only: the index.
4. The list of a window's rarest word, moved by its offset, gives start positions; each further list is intersected
   at its own offset. What survives is compared word for word with the document, in a third pass.
5. ``near`` intersects more lists of a window with some slop, for passages that were edited.

Window tables are broadcast if their counted size allows. Postings of a frequent word stay spread over the
documents that hold it: joins on a word are map-side, and intersections are keyed by document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import ascii_lower, broadcast_if_small, read, row_keys, small, stored

WINDOW = 10
LISTS = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def windows_of(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (p1, p2, words, item): every window of every item; p1 and p2 hash its words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - F.lit(window - 1), F.lit(1)))
    cut = items.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(window)).alias("words"))
    return cut.select(*phrase_keys(F.array_join("words", " ")), "words", "item").distinct()


def phrase_keys(phrase: Column) -> list[Column]:
    return [F.xxhash64(phrase).alias("p1"), F.xxhash64(F.lit("phrase"), phrase).alias("p2")]


def index(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, lists: int) -> tuple[DataFrame, DataFrame]:
    """(lists, postings): the ``lists`` rarest words of each window that can occur (p1, p2, length, off, term, rank), and
    the postings of those words (term, k1, k2, pos)."""
    spread = windows.select("p1", "p2", "words").distinct()
    terms = spread.select("p1", "p2", F.size("words").alias("length"), F.posexplode("words").alias("off", "word")).select("p1", "p2", "length", "off", F.xxhash64("word").alias("term"))
    terms = stored(terms, "bench-terms")
    vocabulary = broadcast_if_small(terms.select("term").distinct())
    hashes = F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w))
    counts = docs.select(F.explode(hashes).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").count()
    counts = stored(counts, "bench-counts")
    rarest = W.partitionBy("p1", "p2").orderBy("count", "off")
    # a window with a word that no document holds cannot occur
    ranked = terms.join(broadcast_if_small(counts), "term", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= lists)
    ranked = stored(ranked, "bench-lists")
    possible = ranked.join(ranked.where("count = 0").select("p1", "p2").distinct(), ["p1", "p2"], "left_anti")
    possible = stored(possible, "bench-lists")
    chosen = broadcast_if_small(possible.select("term").distinct())
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    postings = docs.select(k1, k2, F.posexplode(hashes).alias("pos", "term")).join(chosen, "term", "left_semi")
    return possible, stored(postings.select("term", "k1", "k2", "pos"), "postings")


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: int = LISTS, slop: int = 0) -> DataFrame:
    """Candidate places (k1, k2, p1, p2, start, length) where the ``lists`` rarest words of a window stand as they do in
    it, all but the rarest up to ``slop`` words beside."""
    possible, postings = index(docs, windows, id_col, text_col, lists)
    first = possible.where("rank = 1").select("term", "p1", "p2", "off", "length")
    found = postings.join(broadcast_if_small(first), "term").select("k1", "k2", "p1", "p2", (F.col("pos") - F.col("off")).alias("start"), "length").where("start >= 0")
    for rank in range(2, lists + 1):
        following = possible.where(F.col("rank") == rank).select("p1", "p2", "off", "term")
        # a window of fewer words has no further list and stays as it is
        short = found.join(broadcast_if_small(following.select("p1", "p2")), ["p1", "p2"], "left_anti")
        moved = found.join(broadcast_if_small(following), ["p1", "p2"])
        if slop:  # an equi-join on each place that the word may take
            moved = moved.withColumn("pos", F.explode(F.sequence(F.col("start") + F.col("off") - slop, F.col("start") + F.col("off") + slop))).drop("off")
            both = moved.join(postings.distinct(), ["k1", "k2", "term", "pos"], "left_semi").drop("term", "pos").distinct()
        else:
            moved = moved.withColumn("pos", F.col("start") + F.col("off")).drop("off")
            both = moved.join(postings, ["k1", "k2", "term", "pos"], "left_semi").drop("term", "pos")
        found = stored(both.unionByName(short), "bench-found")
    return found


def near(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 3, terms: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Proximity matches (doc_id, item, start, length, k1, k2): the ``terms`` rarest words of a window all stand within
    ``slop`` words of the places that the rarest one of them gives them; start is where the window would begin.

    This finds edited passages too, and everything that exact windows find. A window of fewer words needs all of them.
    Null and empty texts match nothing, equal rows match alike, and an item without id is left out. Empty tables give
    none; other columns take no part.
    """
    windows = stored(windows_of(benchmark, window, item_col, "text"), "bench-windows")
    found = occurrences(docs, windows, id_col, text_col, terms, slop)
    items = windows.where("item is not null").select("p1", "p2", "item").distinct()
    named = stored(found.join(broadcast_if_small(items), ["p1", "p2"]).select("k1", "k2", "item", "start", "length").distinct(), "bench-near")
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    ids = docs.select(F.col(id_col).alias("doc_id"), k1, k2).distinct()
    return ids.join(named, ["k1", "k2"]).select("doc_id", "item", "start", "length", "k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", lists: int = LISTS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, an
    array of (start, length), and the row keys k1 and k2.

    A document word inside any occurrence of a window is hit. Null and empty texts have no words; an item without
    words has no window; an item without id marks words but is not listed. Items that repeat are listed once; equal
    rows get equal results. An empty benchmark leaves every document clean, and empty documents give an empty table.
    Other columns take no part.
    """
    windows = stored(windows_of(benchmark, window, item_col, "text"), "bench-windows")
    found = occurrences(docs, windows, id_col, text_col, lists)
    near = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length", "p1", "p2")).alias("near"))
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), k1, k2, words_of(F.col(text_col)).alias("words"))
    near = F.broadcast(near) if small(found, 1_000_000) else near
    joined = rows.join(near, ["k1", "k2"], "left")

    def same(x: Column) -> Column:
        phrase = F.array_join(F.slice(F.col("words"), x["start"] + 1, x["length"]), " ")
        a, b = phrase_keys(phrase)
        return (a == x["p1"]) & (b == x["p2"])

    exact = joined.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), F.coalesce(F.filter("near", same), F.array().cast("array<struct<start:int,length:int,p1:bigint,p2:bigint>>")).alias("hits"))
    exact = stored(exact, "bench-exact")
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    listed = exact.where(F.size("hits") > 0).select("k1", "k2", F.explode(F.array_distinct(F.transform("hits", lambda x: F.struct(x["p1"], x["p2"])))).alias("p")).select("k1", "k2", "p.p1", "p.p2")
    items = windows.select("p1", "p2", "item").distinct()
    listed = listed.join(broadcast_if_small(items), ["p1", "p2"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = exact.join(listed, ["k1", "k2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.transform("hits", lambda x: F.struct(x["start"], x["length"])).alias("spans"),
        "k1",
        "k2",
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).drop("spans", "k1", "k2")


def decontaminate_sql(docs: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM {docs}),
b AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.p = win.p AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP9_SQL = decontaminate_sql("documents")

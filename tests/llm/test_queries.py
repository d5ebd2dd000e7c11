"""The registered queries over the test tables, against SQL where there is any, else against brute force."""

import html
import math
import os
import re
from collections import defaultdict

import duckdb
import pytest

from rollgrid.llm import registry
from rollgrid.llm import token_counts as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_thirteen_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def test_op1_counts_what_the_library_counts(spark, db):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(T.vocabulary_path(T.VOCABULARY))
    docs = db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    want = {i: (len(t.encode()), len(e.ids), len(e.ids) > 2048) for (i, t), e in zip(docs, tokenizer.encode_batch([t for _, t in docs], add_special_tokens=False))}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.QUERIES["op1_token_counts"](spark, SF).collect()} == want


def test_op8_reads_whole_articles(spark, db):
    want = {}
    for page, source in db.sql("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article))
        want[page] = "\n".join(b for b in blocks if b)
    got = registry.QUERIES["op8_html_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_learned_queries_return_every_document(spark, db):
    ids = sorted(r[0] for r in db.sql("SELECT doc_id FROM documents").fetchall())
    quality = registry.QUERIES["op5_quality"](spark, SF).collect()
    language = registry.QUERIES["op2_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in quality) == sorted(r.doc_id for r in language) == ids
    known = {r[0] for r in db.sql("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL").fetchall()}
    assert {r.lang_pred for r in language} <= known | {"und"} and all(0 <= r.score <= 1 for r in [*quality, *language])
    assert defaultdict(int, {r.doc_id: r.predicted for r in quality}) == {r.doc_id: int(r.score >= 0.3) for r in quality}

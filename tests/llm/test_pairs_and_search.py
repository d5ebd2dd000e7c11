"""Near duplicates, repeated passages, top-k search, HTML and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollgrid.llm import html_text as H
from rollgrid.llm import near_dedup as N
from rollgrid.llm import substring_dedup as S
from rollgrid.llm import top_k as K
from tests.llm import edge_cases as E

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(rows, n=3, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


@pytest.fixture(scope="module")
def near_rows():
    """Near copies around thresholds, exact copies, a passage that many share, chains, and short texts."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12]), vocabulary)) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([20, 40, 90]))) + " " + passage) for i in range(60)]
    text = [rng.choice(vocabulary) for _ in range(400)]
    for i in range(12):  # a chain: neighbours are alike, its ends are not
        rows.append((300 + i, " ".join(text)))
        for _ in range(6):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rows += [(400 + i, "a short one") for i in range(4)] + [(410, "A SHORT one"), (411, "a short"), (412, "a short"), (413, ""), (414, None), (415, "one two three four"), (416, "one two three five")]
    for size in (5, 20, 63, 64, 65, 80):
        words = [rng.choice(vocabulary) for _ in range(size)]
        rows += [(500 + 10 * size + k, edited(rng, words, k, vocabulary)) for k in range(4)]
    return rows


@pytest.mark.parametrize(("shingle", "percent", "shared", "long"), [(3, 85, N.SHARED, 16), (3, 85, N.SHARED, 2), (5, 80, N.SHARED_80, 4)])
def test_components_by_brute_force(spark, near_rows, monkeypatch, shingle, percent, shared, long):
    monkeypatch.setattr(N, "LONG", long)
    got = N.near_duplicates(spark.createDataFrame(near_rows, "doc_id long, text string"), percent=percent, shingle=shingle, shared=shared)
    assert E.by_id(got, "doc_id", "n_shingles", "component_id") == plain_components(near_rows, shingle, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_duplicate_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    got = N.near_duplicates(docs)
    want = plain_components([(r[0], r[1]) for r in E.ROWS])
    assert [x[:2] for x in E.by_id(got, "doc_id", "n_shingles")] == sorted((x[:2] for x in want), key=repr)
    assert {r.component_id for r in got.where("doc_id = 1").collect()} == {1}
    assert N.near_duplicates(E.empty(spark)).count() == 0


def test_shared_values_follow_the_similarity(spark):
    assert N.shared_values(85) == N.SHARED and N.shared_values(80) == N.SHARED_80
    assert [N.shared_values(p) for p in (1, 50, 70, 90, 99, 100)] == sorted(N.shared_values(p) for p in (1, 50, 70, 90, 99, 100)) and N.shared_values(100) == 64
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, edited(rng, base, i % 20, words)) for i in range(60)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50)
    assert E.by_id(got, "doc_id", "n_shingles", "component_id") == plain_components(rows, 3, 50)
    with pytest.raises(ValueError):
        N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=0)


def test_tables_can_be_discarded(spark):
    from rollgrid.llm import common

    back = common.stored(spark.range(5), "some")
    assert back.count() == 5 and common.discard(spark) >= 1 and common.discard(spark) == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in N.components(links).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1 and got[0] != got[100]
    assert N.components(links.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(999)) for _ in range(9)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(7))
    clean = [(i, "\n".join(sentence() for _ in range(6))) for i in range(8)]
    planted = [(20, sentence() + "\n" + passage + "\n" + sentence()), (21, sentence() + " " + passage.upper().replace(" ", "  ") + " " + sentence()), (22, passage), (23, passage)]
    docs = spark.createDataFrame(clean + planted + [(30, None), (31, ""), (32, "Short. Short.\nShort."), (33, "Short. Short.\nShort.")], "doc_id long, text string")
    spans = S.repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == {21, 22, 23} and all(r.first_doc_id == 20 and r.n_words == 63 for r in spans)
    got = {r.doc_id: r for r in S.dedup_passages(docs).collect()}
    texts = dict(clean + planted)
    for i, text in clean:
        assert got[i].text == text
    assert got[20].text == texts[20] and got[22].text == "" and got[30].text is None
    start, stop = got[21].removed_spans[0]
    assert got[21].text == texts[21][:start] + texts[21][stop:] and len(got[21].text.split()) == 18


def plain_spans(rows, n=50):
    """Unions of all windows of n words that an earlier document holds too, by Python's own strings."""
    first, out = {}, []
    for i, text in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r)):
        marks = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        words = [text[a:b].translate(FOLD) for a, b in marks]
        spans = []
        for at in range(len(words) - n + 1):
            f = first.setdefault(tuple(words[at : at + n]), (i, text))
            if f != (i, text):
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + n
                    spans[-1][2].append(f[0])
                else:
                    spans.append([at, at + n, [f[0]]])
        out += [(i, marks[a][0], marks[b - 1][1], b - a, min((f is not None, f) for f in fs)[1]) for a, b, fs in spans]
    return sorted(out, key=repr)


def found_spans(spark, rows, **options):
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return E.by_id(got, "doc_id", "start", "stop", "n_words", "first_doc_id")


def test_passages_by_brute_force(spark, monkeypatch):
    """Passages pasted anywhere, cut out anywhere, wrapped, of one word, of long and wide words, and common sentences."""
    rng = random.Random(11)
    words = lambda n, size=5: ["".join(rng.choice("abcdéfgh") for _ in range(rng.randrange(1, size))) + str(rng.randrange(99)) for _ in range(n)]
    end = lambda: rng.choice([".", ".", "!", "?\n", "\n", ",", ".\n\n"])
    prose = lambda n: " ".join(" ".join(words(rng.randrange(1, 18))) + end() for _ in range(n))
    common = [prose(1) for _ in range(6)]
    rows = [(i, " ".join(prose(3) + " " + rng.choice(common) for _ in range(8))) for i in range(40)]
    plain = [t for _, t in rows]
    for i in range(40, 160):
        source = rng.choice(plain).split(" ")
        size = rng.choice([30, 49, 50, 51, 60, 120])
        at = rng.randrange(max(1, len(source) - size))
        piece = source[at : at + size]
        kind = rng.randrange(5)
        piece = ["\n".join(piece)] if kind == 0 else [x.upper() for x in piece] if kind == 1 else ["  \t".join(piece)] if kind == 2 else piece
        rows.append((i, " ".join([*prose(2).split(" ")[: rng.randrange(30)], *piece, *prose(2).split(" ")[rng.randrange(9) :], rng.choice(common)])))
    rows += [(200, "and " * 70), (201, "x " + "and " * 50), (202, "AND\u00a0and " * 60), (203, " ".join(words(120))), (205, " ".join(words(45, 60)) + ". " + " ".join(words(9)) + ".")]
    rows += [(204, "so " + rows[-2][1].replace(" ", "\v") + " go"), (206, "Other " + rows[-1][1]), (207, rows[0][1]), (207, rows[0][1]), (None, rows[1][1]), (208, None), (209, "\n \n")]
    want = plain_spans(rows)
    assert len(want) > 60 and found_spans(spark, rows) == want
    monkeypatch.setattr(S, "RUN", 1000)
    monkeypatch.setattr(S, "CHUNK", 64)
    assert found_spans(spark, rows, run_words=21) == plain_spans(rows, 21)


def test_a_run_of_sentences_of_several_documents_is_no_passage(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice("red green blue grey teal pink plum lime".split()) + str(rng.randrange(9999)) for _ in range(9)) + "."
    rows = [(i, " ".join(sentence() for _ in range(9))) for i in range(7)]
    rows.append((9, " ".join(t.split(". ")[4] + "." for _, t in rows)))
    assert found_spans(spark, rows) == []


def test_digests_of_words():
    texts = ["", " a  B\n", "x" * 5000 + " é.\u00a0 ", "\n\n", "b a", "a b"]
    words = S.Words([t.encode() for t in texts])
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(words.bounds).tolist() == [len(p) for p in plain]
    flat = [w.translate(FOLD) for p in plain for w in p]
    assert len(set(flat)) == len(set(words.hashes.tolist())) and all((a == b) == (x == y) for a, x in zip(flat, words.hashes) for b, y in zip(flat, words.hashes))
    pairs = words.digests(np.arange(len(flat) - 1), 2)
    for h in pairs:
        assert all((flat[i : i + 2] == flat[j : j + 2]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))
    text = np.searchsorted(words.bounds, np.arange(len(flat)), side="right") - 1
    zero = words.characters[words.begins[text]]
    places = zip(text, words.characters[words.starts] - zero, words.characters[words.stops] - zero)
    assert [texts[t][a:b].translate(FOLD) for t, a, b in places] == flat


def test_repeated_passage_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    out = S.dedup_passages(docs)
    assert out.count() == len(E.ROWS) and set(docs.columns) | {"removed_spans"} == set(out.columns)
    assert S.repeated_spans(E.empty(spark)).count() == 0
    text = "One sentence that is long enough to be a unit. " * 12
    assert found_spans(spark, [(1, text), (1, text)]) == []  # equal rows are one document
    both = [(1, text), (2, text), (2, text)]  # as documents repeat each other, their equal rows all lose the passage
    cut = S.dedup_passages(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text.strip()) for r in cut) == [(1, text.strip()), (2, ""), (2, "")]


def plain_top_k(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(256 * float(x))) for x in v])
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[q][0], v)), i) for i, vs in ok.items() for v in vs if i != q and len(v) == len(ok[q][0]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(9)]  # ties
    rows += [(500, [0.0] * 8), (510, None), (520, []), (530, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (610, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(7) for n in ("dim", "norm", "q", "floor", "rank", "part", "kind")})
    want = plain_top_k(rows, 5, 10)
    for queries, stream, seeds in ((8, 50, 32), (8192, 250_000, 4096)):  # on the driver: blocks, streams and seeds
        monkeypatch.setattr(K, "QUERIES", queries)
        monkeypatch.setattr(K, "STREAM", stream)
        monkeypatch.setattr(K, "SEEDS", seeds)
        got = K.top_k(df, F.pmod("vec_id", F.lit(10)) == 0)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
    assert K.top_k(df.limit(0), F.lit(True)).count() == 0
    assert K.top_k(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_top_k_of_many_equal_vectors(spark):
    """Ties go to the smaller ids, whatever the partitions; no row outgrows ROW_BYTES."""
    rng = np.random.default_rng(4)
    rows = [(i, [0.5] * 16 if i % 3 else rng.standard_normal(16).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(300)
    got = K.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top_k(rows, 5, 100)
    table = df.select("vec_id", K.quantised(F.col("embedding")).alias("q"), F.lit(1.0).alias("norm"), F.lit(16).alias("dim"), F.lit(0.0).alias("floor"), F.lit(1).alias("part"))
    sizes = [len(r.vectors) for r in K.packed(table.coalesce(2), ["part"]).collect()]
    assert max(sizes) <= K.ROW_BYTES and sum(sizes) == 3000 * 16 * 4


def test_blocks_of_queries():
    assert K.block_plan([]) == []
    plan = K.block_plan([(8, 5, 9000), (8, 4, 10), (8, 3, 20000), (8, -9, 1), (4, 7, 3)])
    assert plan == [(8, 5, 0, 2), (8, 4, 2, 3), (8, 3, 2, 3), (8, -9, 5, 1), (4, 7, 6, 1)]
    many = K.block_plan([(8, n, 10**9) for n in range(40)])
    assert sum(parts for *_, parts in many) <= 1.1 * K.BLOCKS


def test_top_k_prunes():
    rng = np.random.default_rng(0)
    v = np.rint(rng.standard_normal((5000, 16)) * rng.exponential(40, (5000, 1))).astype(np.int64)
    v = v[np.argsort(-(v**2).sum(1))]
    turn = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    search = K.Search(5, np.arange(0, 5000, 50), v[::50], np.full(100, -np.inf), turn)
    search.add(np.arange(5000), v)
    assert search.scored < 0.2 * 100 * 5000
    for q in (0, 40, 99):
        scores = v @ v[q * 50]
        scores[q * 50] = np.iinfo(np.int64).min
        assert sorted(search.found[q].tolist()) == sorted(np.sort(scores)[-5:].tolist())


PAGE = '<html><head><title>T</title><style>p{}</style><script>x="<p>no</p>"</script></head><body><div class=top>Site name</div><nav><a href=/>%s</a></nav>%s<div class="comments"><p>reader says %s</p></div><footer>f %s</footer></body></html>'


def read_html(source):
    return H.extract(H.Tree(source))


def test_blocks_and_entities():
    page = "<article><h1>A &amp; B</h1><p>one <b>two</b>&nbsp;three\n four<br>five<p>six<aside>not</aside><ul><li>a<li>b</ul><form><input>no</form></article>"
    assert read_html(page) == "A & B\none two three four\nfive\nsix\na\nb"
    assert read_html("") == "" and read_html("just text &lt;b&gt; &am") == "just text <b> &am"
    assert read_html("<p>open <!-- never closed") == "open" and read_html("<p>x<script>if (a<b) '</p>'") == "x"
    assert read_html("<div hidden>h</div><p style='display: none'>h</p><p>seen") == "seen"
    assert read_html("<body><header>head</header><div class='cookie-notice'>c</div><p>text</p>") == "text"
    assert read_html("<b>" * 3000 + "deep<p>x") == "deep\nx"
    assert read_html("<article><p>" + "w " * 200_000) == " ".join(["w"] * 200_000)


@pytest.mark.parametrize("tag", ["b", "div"])
def test_deep_pages_read_like_shallow_ones(tag):
    deep = f"<{tag}>" * 3000
    for end in ("", f"</{tag}>" * 3000):
        page = deep + "<p>out</p><nav>menu</nav><article><p>one <i>x</i></p><script>if (a) b</script><div>two</div><div hidden>h</div><p>three</article><style>p{}</style>" + end
        assert read_html(page) == "one x\ntwo\nthree"
    tree, pivot = H.Tree(deep + "<p>a<p>b"), H.Tree(deep + "<i>c</i><p>d")
    assert sum(x >= 0 for x in H.aligned(tree.structure, pivot.structure)) == 3002
    assert read_html(f"<{tag}>" * 100_000 + "<ul>" * 20_000 + "<p>end") == "end"


def test_names_are_weak_evidence():
    """Classes and ids rule out what all their words name, and never the main mass or what holds a marked article."""
    assert read_html('<div class="site-content has-sidebar"><p>all the text</p></div><p>x</p>') == "all the text\nx"
    assert read_html('<div class="sidebar"><article><p>inside</p></article></div><p>out</p>') == "inside"
    assert read_html('<article class="related-article post"><p>kept</p></article>') == "kept"
    assert read_html('<article><p class="notice-of-award">won a prize</p><p class="sidebar-box">no</p><p>and more of it</p></article>') == "won a prize\nand more of it"
    assert read_html('<div class="page-notice">most of the text is here</div><p>less</p>') == "most of the text is here\nless"
    assert read_html('<div class="cookie-notice">c</div><ul id="nav-2"><li>m</ul><div class="share-links">s</div><p>the text itself</p>') == "the text itself"
    assert read_html('<article class="comment"><p>reader</p></article><article><p>a text that is longer</p></article>') == "a text that is longer"


def test_layouts_of_a_host(spark):
    """Pages of two layouts without marks: each learns from its own, headers go, all texts stay."""
    one = lambda i: f"<body><div>Site name</div><div><i>Read on</i></div><section><p>story {i} goes on</p><p>and ends {i}</p></section><div>All rights kept</div>"
    two = lambda i: f"<body><table><tr><td>Old name</td><td><p>tale {i} starts here</p><p>it is done {i}</p></td><td>Old foot</td></tr></table>"
    rows = [(i, f"https://mixed.example/{i}", one(i) if i % 2 else two(i)) for i in range(40)] + [(99, "https://mixed.example/99", "<body><h1>Odd one</h1>")]
    got = texts_of(spark, rows)
    assert all(got[i] == (f"story {i} goes on\nand ends {i}" if i % 2 else f"tale {i} starts here\nit is done {i}") for i in range(40)) and got[99] == "Odd one"


def test_alignments_are_kept_up_to_a_bound():
    store = H.Kept(10)
    for n in range(100):
        assert store.keep(n, n, 3) == n and store.held <= 10 and len(store) <= 3


def test_tree_matching_is_the_largest(spark):
    def tree(*children):
        labels, parents = ["#"], [-1]

        def add(node, parent):
            labels.append(node[0])
            parents.append(parent)
            me = len(labels) - 1
            for c in node[1:]:
                add(c, me)

        for c in children:
            add(c, 0)
        return tuple(labels), tuple(parents)

    def size(a, b, x=0, y=0):
        kids = [[i for i, p in enumerate(t[1]) if p == n] for t, n in ((a, x), (b, y))]
        if a[0][x] != b[0][y]:
            return 0
        m = [[0] * (len(kids[1]) + 1) for _ in range(len(kids[0]) + 1)]
        for i, c in enumerate(kids[0], 1):
            for j, d in enumerate(kids[1], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + size(a, b, c, d))
        return 1 + m[-1][-1]

    rng = random.Random(1)

    def grow(depth):
        return (rng.choice("abc"), *[grow(depth - 1) for _ in range(rng.randrange(4) if depth else 0)])

    for _ in range(60):
        a, b = tree(*[grow(2) for _ in range(3)]), tree(*[grow(2) for _ in range(3)])
        partner = H.aligned(a, b)
        pairs = [(x, y) for x, y in enumerate(partner) if y >= 0]
        assert len(pairs) == size(a, b)
        assert all(a[0][x] == b[0][y] for x, y in pairs) and len({y for _, y in pairs}) == len(pairs)
        assert all(partner[a[1][x]] == b[1][y] for x, y in pairs if x)


def test_long_lists_of_children_are_aligned(monkeypatch):
    rng = random.Random(3)
    page = lambda n, kinds: H.Tree("<body>" + "".join(f"<div><{rng.choice(kinds)}>x</div>" for _ in range(n))).structure
    for n, m, cells in ((450, 450, H.CELLS), (2000, 101, H.CELLS), (40, 30, 20), (7, 90, 1), (90, 7, 1)):
        a, b = page(n, ["i", "b", "u", "s"]), page(m, ["b", "i", "u", "em"])
        monkeypatch.setattr(H, "CELLS", cells)
        pairs = [(x, y) for x, y in enumerate(H.aligned(a, b)) if y >= 0]
        monkeypatch.undo()
        kinds = [[t[0][i + 1] for i, label in enumerate(t[0]) if label == "div"] for t in (a, b)]
        row = [0] * (m + 1)
        for x in kinds[0]:
            new = [0]
            for j, y in enumerate(kinds[1]):
                new.append(max(row[j + 1], new[j], row[j] + 1 + (x == y)))
            row = new
        assert len(pairs) == row[-1] + 2  # the root and the body
        assert all(a[0][x] == b[0][y] for x, y in pairs) and all(p < q for (_, p), (_, q) in zip(pairs, pairs[1:]))


def test_wrappers_of_a_host(spark):
    rows = [(i, f"https://one.example/{i}", PAGE % (f"link {i}", f"<div id=c><p>text {i} is here</p><p>and more {i}</p></div>", i, i)) for i in range(30)]
    rows += [(100, "https://two.example/x", "<article>only <i>one</i></article>"), (101, None, "<p>no host"), (102, "odd", None), (103, "https://two.example/y", ""), (103, "https://two.example/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    got = {r.page_id: r for r in H.extract_text(pages).collect()}
    assert all(got[i].text == f"text {i} is here\nand more {i}" for i in range(30))
    assert got[100].text == "only one" and got[101].text == "no host" and got[102].text == "" and got[103].n_chars == 0
    assert H.extract_text(pages).count() == len(rows) and H.extract_text(pages.limit(0)).count() == 0


def texts_of(spark, rows):
    return {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_of_a_page_are_no_template(spark):
    article = "<article><h1>A title</h1><p>first words</p><p>second words</p></article>"
    plain = PAGE % ("link", "<p>first words</p><p>second words</p>", "r", "f")
    rows = [(i, "https://rows.example/x", PAGE % ("link", article, "r", "f")) for i in range(10)]
    rows += [(20 + i, f"https://urls.example/{i}", PAGE % (f"link {i}", article, i, i)) for i in range(10)] + [(30, "https://urls.example/z", PAGE % ("z", "<article><p>other</p></article>", "z", "z"))]
    rows += [(40 + i, f"https://plain.example/{i}", plain) for i in range(10)]
    got = texts_of(spark, rows)
    assert all(got[i] == "A title\nfirst words\nsecond words" for i in [*range(10), *range(20, 30)]) and got[30] == "other"
    assert all(got[i].endswith("first words\nsecond words") for i in range(40, 50))


def test_template_of_small_hosts(spark):
    """A header is kept on hosts of one and two different pages, and known from three on; versions of an article agree."""
    story = lambda i: f"<p>text {i} is here and goes on</p><p>and more {i} to be read</p>"
    for number in (1, 2, 3, 7):
        rows = [(i, f"https://few.example/{i}", PAGE % ("link", story(i), i, i)) for i in range(number)]
        head = "Site name\n" if number < 3 else ""
        assert texts_of(spark, rows + rows[:1]) == {i: f"{head}text {i} is here and goes on\nand more {i} to be read" for i in range(number)}
    versions = [(i, f"https://old.example/{i}", PAGE % ("link", f"<article>{story(0)}<p>edit {i}</p></article>", i, i)) for i in range(4)]
    assert all("text 0 is here" in t and "and more 0" in t and f"edit {i}" in t for i, t in texts_of(spark, versions).items())


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language" and len(corpus_pipeline.STAGES) == 5
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/{n}")
        after = {r.doc_id for r in docs.collect()}
        assert after <= ids
        if name == "near duplicates":
            want = plain_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert after == {d for d, _, c in want if c == d}
        if n < 4:
            assert docs.columns == columns
            ids = after
    assert after == ids and docs.where("taken > 2 * size").count() == 0


def test_pipeline_takes_odd_rows(spark):
    """Every stage over nulls, empty and long texts, ties, repeated rows, clashing names, and empty tables."""
    sf = "/root/testdata/sf0.001"
    for docs in (E.documents(spark), E.documents(spark, clashing=True)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == columns and {r.doc_id for r in out.collect()} <= {r[0] for r in E.ROWS}
        assert corpus_pipeline.language_stage(spark, docs, sf).where("text is null").count() == 0
        assert corpus_pipeline.line_stage(spark, docs, sf).count() == len(E.ROWS)
        near = corpus_pipeline.near_stage(spark, docs, sf).collect()
        assert sorted((r.doc_id for r in near), key=repr) == sorted((r[0] for r in E.ROWS), key=repr)  # equal rows stay together
        assert corpus_pipeline.benchmark_stage(spark, docs, sf).count() == len(E.ROWS)
        mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
        assert mixed.count() == len(E.ROWS) and mixed.where("taken > 2 * size").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, E.empty(spark), sf).count() == 0
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)


def test_first_thresholds_need_no_window(spark):
    """The longest vectors come from a bounded top-k in each task, not from a sorted dimension."""
    rows = spark.createDataFrame([(i, [i % 7, -i], float(i % 5), 2) for i in range(50)] + [(99, [1], 9.0, 1)], "vec_id long, q array<long>, norm double, dim int")
    ids, vectors = K.longest(rows, 2, 12)
    assert ids.tolist() == [i for _, i in sorted((-(i % 5), i) for i in range(50))[:12]] and vectors.tolist() == [[i % 7, -i] for i in ids]
    plan = rows.where("dim = 2").orderBy(F.col("norm").desc(), "vec_id").limit(12).select("vec_id", "q")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Window" not in plan

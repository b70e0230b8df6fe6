import html
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import html_extract, jaccard_join, neighbours, packing


# ------------------------------------------------------------------------------------------------------------ Jaccard join
def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent, k=4):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(out[root(i)])) for i in range(len(rows)))


def near_copies(seed, groups=6, copies=14):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 4000))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(int(rng.integers(20, 120)))] + passage * int(rng.integers(0, 2))
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[rng.integers(0, len(text))] = word()
            rows.append(" ".join(text))
    rows += ["a b c", "A  b\nc", "a b", "", None, " ", "x y z w", "x y z w", " ".join(passage)]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)) * 3, rows)]


@pytest.mark.parametrize(("seed", "percent"), [(0, 85), (1, 85), (2, 60), (3, 100)])
def test_components_are_exact(spark, seed, percent):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sig": F.lit(1), "n": F.lit(2)}).repartition(5)
    got = jaccard_join.near_duplicates(docs, ["doc_id"], percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, percent)


def test_join_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (4, "another text by the same id"), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.near_duplicates(docs, ["doc_id"]).collect())
    assert got == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (4, 3, 4), (5, 0, 5)]
    assert jaccard_join.near_duplicates(docs.limit(0), ["doc_id"]).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [tuple(map(int, rng.integers(100, 160, 2))) for _ in range(45)] + [(200, 200), (300, 3000), (3000, 300)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in list(parent)}


def test_skipping_loses_nothing():
    rng = np.random.default_rng(7)
    n = np.sort(rng.integers(5, 60, 300)).astype(np.int64)
    pos = np.array([rng.integers(0, k) for k in n])
    bits = np.zeros((300, 8), np.uint64)
    got = {(a, b) for x, y in jaccard_join.list_pairs(np.arange(300), n, pos, np.arange(300), bits, 85) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 100 * n[i] >= 85 * n[j] and 1 + min(n[i] - pos[i], n[j] - pos[j]) - 1 >= math.ceil(85 * (n[i] + n[j]) / 185 - 1e-9)}
    assert got == want


def test_derived_answers_hold():
    rng = random.Random(4)
    decided = 0
    for _ in range(3000):
        pivot = set(rng.sample(range(60), rng.randrange(20, 40)))
        near = lambda drop, more: (pivot - set(rng.sample(sorted(pivot), rng.randrange(drop)))) | set(rng.sample(range(60, 120), rng.randrange(more)))  # noqa: E731, B023
        a, b = near(6, 8), near(6, 8)
        may, does = jaccard_join.derived(len(a), len(b), len(a & pivot), len(b & pivot), len(pivot), 85)
        links = 100 * len(a & b) >= 85 * len(a | b)
        assert (may or not links) and (links or not does)
        decided += does or not may
    assert decided > 500


def test_hot_list_of_sets_that_link_in_chains(spark):
    """One shingle stands in all texts, which drift so far that the pivot links with few of them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(260):
        words = list(base)
        for k in range(i // 20, i // 20 + 3):
            words[8 + 4 * k % 60] = f"x{rng.randrange(4)}"
        if rng.random() < 0.5:
            words += [f"t{rng.randrange(30)}"] * rng.randrange(1, 3)
        rows.append((i, " ".join(words)))
    rows += [(1000, "long " + " ".join(f"v{i % 5000}" for i in range(200_000))), (1001, "longer " + " ".join(f"v{i % 5000}" for i in range(200_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, ["doc_id"]).collect())
    assert got == brute(rows, 85) and len({c for _, _, c in got}) > 2


# --------------------------------------------------------------------------------------------------------------- neighbours
def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((8, 32))
    x = (centre[rng.integers(0, 8, 1500)] + 0.7 * rng.standard_normal((1500, 32))).astype(np.float32)
    x[700:760] = x[50]  # copies of a query
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    got = neighbours.nearest(rows, F.col("vec_id") % 50 == 0).toPandas()
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        c = u @ u[q]
        c[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(c, 12)))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert own.score.tolist() == pytest.approx([y[q] @ y[i] / np.sqrt(y[q] @ y[q]) / np.sqrt(y[i] @ y[i]) for i in own.vec_id], rel=1e-12)
        hit += len(set(own.vec_id) & set(best))
        if q == 50:
            assert own.vec_id.tolist() == [700, 701, 702, 703, 704]
    assert hit >= 0.9 * 5 * 30


@pytest.mark.parametrize(("rows", "spread"), [(4000, None), (8000, None), (3000, 0.7)])
def test_neighbours_verify_a_part_and_find_most(rows, spread):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((rows, 64))
    if spread:
        x = spread * x + rng.standard_normal((10, 64))[rng.integers(0, 10, rows)]
    block, hits = neighbours.Block(np.arange(rows), x), 0
    unit = neighbours.unit(x)
    for q in range(0, rows, 50):
        best = unit @ unit[q]
        best[q] = -9
        hits += len(set(np.argsort(-best)[:5]) & set(block.search(q, x[q], 5)[0].tolist()))
    print(rows, spread, "recall", hits / (5 * block.searches), "verified", block.verified / block.searches / rows)
    assert hits >= 0.9 * 5 * block.searches and block.verified <= 0.2 * rows * block.searches


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (6, [1.0, 1.0]), (50, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9))
    got = [tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 50), (0, 2, 6), (0, 3, 7), (50, 1, 0), (50, 2, 6), (50, 3, 7)]
    assert [s for *_, s in got[:3]] == pytest.approx([1, math.sqrt(0.5), -1])
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    far = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(far, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 0.707107), (2, 0.0)]


# -------------------------------------------------------------------------------------------------------------------- html
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<div class="top">Site name</div><nav><ul><li>Home</li></ul></nav><div class="ad">Buy {n}</div>{main}
<div class="comments"><p>first!</p></div><form>mail <input></form><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><h1>A</h1><p><b>one<br>two &lt;3<p>three&nbsp;\n four</p></article>tail", "A one two <3 three four"),
        ("<body><nav>menu</nav><p>a<i>b</i>c</p><aside>x</aside><div>d <a title='x>y'>link</a></div></body>", "abc d link"),
        ("<main><header><h1>Head</h1><p>by me</p></header><p>x</p></main><p>out</p>", "Head x"),
        ("<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "1 2 a b c"),
        ("<p>cut <!-- never ends", "cut"),
        ("<script>x", ""),
        ("<div hidden>no</div><div style='display: none'>no</div><div role=navigation>no</div><p>yes &amp", "yes &"),
        ("a < b and <3", "a < b and <3"),
        ("", ""),
        ("<textarea><p>no</textarea><select><option>no</select><noscript>no</noscript>ok", "ok"),
        ("<article><div class='comment-list'>no</div><p>yes</p></article><article class='comment'>no</article>", "yes"),
    ],
)
def test_main_text(source, text):
    assert html_extract.main_text(source) == text


def test_wrapper_drops_what_pages_share(spark):
    body = lambda k: f"<div class='x'>Read more here</div><div class='y'><p>Story {k} about {k * k}.</p><p>End {k}</p></div><div>All rights</div>"
    pages = [(k, f"http://Host.example/{k}", PAGE.format(n=k, main=body(k)), "z") for k in range(9)]
    pages += [(20, "http://lone.example/", PAGE.format(n=1, main=body(3)), "z"), (21, None, None, "z"), (22, "not a url", "", None), (23, "http://host.example/c", PAGE.format(n=3, main=body(3)), "z"), (24, "http://host.example/d", "<div>" * 3000 + "deep", "z")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(rows, ["page_id", "url"]).collect()}
    for k in range(9):
        assert got[k]["text"] == f"Story {k} about {k * k}. End {k}"
    assert got[20]["text"] == "Site name Read more here Story 3 about 9. End 3 All rights"  # one page makes no wrapper
    assert got[21]["text"] == got[22]["text"] == "" and got[21]["n_chars"] == 0
    assert got[23]["text"] == got[3]["text"] and got[24]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(rows.limit(0), ["page_id"]).count() == 0


def test_all_pages_of_a_layout_vote(spark):
    one = lambda k: f"<div class='x'>Read more here</div><div class='y'>{'<p>On sale</p>' * (k % 2)}<p>Story {k} of {k * 7}</p></div><div class='z'>All rights</div>"
    two = lambda k: f"<table><tr><td>Contents</td><td>Imprint</td></tr></table><section><ul><li>item {k}</li><li>item {k * k}</li></ul></section><h4>Legal text</h4>"
    pages = [(k, "https://h.example/a", one(k)) for k in range(40)] + [(k, "https://h.example/b", two(k)) for k in range(100, 125)]
    pages += [(k, "https://h.example/c", one(3)) for k in range(200, 230)]  # copies, which have one vote between them
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows, ["page_id"]).collect()}
    assert all(got[k] == ("On sale " if k % 2 else "") + f"Story {k} of {k * 7}" for k in range(40))
    assert all(got[k] == f"item {k} item {k * k}" for k in range(100, 125)) and all(got[k] == got[3] for k in range(200, 230))


def test_extraction_is_as_brute_force_on_each_host(spark, data, monkeypatch):
    monkeypatch.setattr(html_extract, "REFERENCES", 10**6)
    rng = random.Random(2)
    given = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    for host in range(6):
        template = ["".join(rng.choice(("<div class='a'>", "<div>", "<section>")) + f"fixed {host} {i}</div>") for i in range(4)]
        for k in range(rng.randrange(2, 12)):
            parts = [*template, *(f"<div class='b'>own {rng.randrange(9)}</div>" for _ in range(rng.randrange(4)))]
            given.append((1000 + 20 * host + k, f"http://host{host}.example/{k}", "".join(p for p in parts if rng.random() < 0.9)))
    rows = spark.createDataFrame(given, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows, ["page_id"]).collect()}
    hosts = {}
    for i, url, source in given:
        hosts.setdefault(url.split("/")[2].lower(), []).append((i, source))
    dropped = 0
    for pages in hosts.values():
        sources = sorted({s for _, s in pages}, key=lambda s: (zlib.crc32(s.encode()), s))
        wrapper = html_extract.induce(sources)
        for i, source in pages:
            assert got[i] == html_extract.main_text(source, wrapper)
            dropped += got[i] != html_extract.main_text(source)
    assert dropped > 10


def test_articles_keep_shared_paragraphs(spark):
    pages = [(k, "http://h.example/", PAGE.format(n=k, main=f"<article><p>Same &eacute;</p><p>own {k}</p></article>")) for k in range(6)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(rows, ["page_id"]).collect()} == {f"Same {html.unescape('&eacute;')} own {k}" for k in range(6)}


def test_tree_matching_is_the_largest():
    tree = lambda label, *kids: [label, None, list(kids)]
    a = tree("r", tree("a"), tree("b", tree("c"), tree("d")), tree("e"))
    b = tree("r", tree("b", tree("d")), tree("a"), tree("e"))
    html_extract.shape(a), html_extract.shape(b)
    assert html_extract.matching(a, b) == 4  # r, b, d, e
    assert {x[0] for x, _ in html_extract.aligned(a, b)} == {"r", "b", "d", "e"}
    assert html_extract.matching(a, tree("q", tree("a"))) == 0


def test_long_and_deep_pages_align_as_short_ones_do():
    body = lambda k, n: "<div class='x'>Read more here</div>" + "<span></span>" * (k % 2) + "<hr>" + f"<div>own {k}</div><hr>" * n + "<div class='z'>All rights</div>"
    wrapper = html_extract.induce([body(k, 8) for k in range(5)])
    assert html_extract.main_text(body(9, 1500), wrapper) == " ".join(["own 9"] * 1500)
    deep = lambda k: "<div>" * 400 + f"<div class='z'>All rights</div><p>own {k}</p>"
    assert html_extract.main_text(deep(9), html_extract.induce([deep(k) for k in range(5)])) == "own 9"


def test_split_matching_is_as_large(monkeypatch):
    rng = random.Random(5)
    tree = lambda depth: [rng.choice("ab"), None, [tree(depth - 1) for _ in range(rng.randrange(6) if depth else 0)]]
    pairs = [(["r", None, [tree(2) for _ in range(9)]], ["r", None, [tree(2) for _ in range(12)]]) for _ in range(20)]
    for a, b in pairs:
        html_extract.shape(a), html_extract.shape(b)
    whole = [html_extract.matching(a, b) for a, b in pairs]
    html_extract._SIZES.clear()
    monkeypatch.setattr(html_extract, "CELLS", 4)
    assert [html_extract.matching(a, b) for a, b in pairs] == whole == [sum(1 for _ in html_extract.aligned(a, b)) for a, b in pairs]


# ---------------------------------------------------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 ...", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 0"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, kept, sf), name)
        assert after.columns == docs.columns
        gone = {r["doc_id"] for r in kept.join(after.select("doc_id"), "doc_id", "left_anti").select("doc_id").collect()}
        if name == "language_id":
            assert {10**6, 10**6 + 1} <= gone and len(gone) < 20
        if name == "quality_rules":
            assert gone == {r["doc_id"] for r in corpus_pipeline.quality_rules.check_rules(kept, ["doc_id"]).where("not kept").collect()}
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in kept.dropDuplicates(["doc_id"]).collect()]
            groups = brute(rows, corpus_pipeline.SIMILARITY, corpus_pipeline.SHINGLE)
            want = sorted({c for _, n, c in groups if n} | {i for i, n, _ in groups if not n})
            assert sorted(r["doc_id"] for r in after.collect()) == want
        kept = after
    packed = corpus_pipeline.pack(spark, kept, sf).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in kept.collect()} and (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert packed.sequence_id.nunique() <= 1.02 * packed.length.sum() / packing.Limits().tokens + 2


def test_pipeline_odd_rows(spark, data):
    """Rows without an id are judged like others, texts under one id apart; other columns pass through."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = [r["text"] for r in docs.where("length(text) between 1500 and 3000").orderBy("doc_id").limit(60).collect()]
    junk = "$$ ## && || " * 100
    rows = [(None, good[0]), (None, good[1]), (None, good[1]), (None, junk), (None, None), (10**6, good[2]), (10**6, good[3] + " " + good[4]), (10**6 + 1, good[5] + " one more"), (10**6 + 2, " ".join(good[:50]) * 12), (10**6 + 3, "")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    extra = {"n": F.lit(1), "sig": F.lit("z"), "key": F.lit(2.5), "kept": F.lit("no"), "component_id": F.lit(7), "lang_pred": F.lit("z"), "score": F.lit(None).cast("string")}
    all_rows = docs.unionByName(odd).withColumns(extra)
    kept, before = all_rows, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.materialize(stage(spark, kept, data), name)
        assert kept.columns == all_rows.columns and kept.dtypes == all_rows.dtypes
        if name == "quality_rules":
            texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
            assert (None, junk) not in texts and (None, None) not in texts and sum(t == good[1] and i is None for i, t in texts) == 2
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in before.collect()})
    groups = brute([(i, r[2]) for i, r in enumerate(rows)], corpus_pipeline.SIMILARITY, corpus_pipeline.SHINGLE)
    sizes = {}
    for i, _, c in groups:
        sizes.setdefault(c, set()).add(rows[i])
    assert len(left) == len(sizes) and len(set(left)) == len(left)
    for members in sizes.values():  # one of each group stays, of those with the smallest id
        least = min(m[:2] for m in members)
        assert sum((t in {m[2] for m in members if m[:2] == least}) and (i is None, i or 0) == least for i, t in left) == 1
    assert not any(i is None and t in good for i, t in left)  # each has a copy with an id
    packed = corpus_pipeline.pack(spark, kept, data)
    assert packed.agg(F.count_if(F.col("piece") == 0)).first()[0] == len(left)


def test_pipeline_of_an_empty_table(spark, data):
    kept = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialize(stage(spark, kept, data), name)
        assert kept.count() == 0


def test_language_sample_sends_no_text_by_language(spark, monkeypatch):
    from textloom.llm import langid

    seen = []
    frame = type(spark.range(1))
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(self._jdf.queryExecution().optimizedPlan().toString() + self._sc._jvm.PythonSQLUtils.explainString(self._jdf.queryExecution(), "simple")) or plain(self))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        langid.train(spark.createDataFrame([(i, "some words here", "en") for i in range(20)], "doc_id long, text string, lang string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("BroadcastHashJoin" in s for s in seen) and not any("SortMergeJoin" in s for s in seen)


def test_neighbours_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    table = rows.toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -9
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hits, total = hits + len(best & got[ids[i]]), total + 5
    assert hits / total >= 0.9

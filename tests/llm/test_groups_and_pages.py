"""SimHash, embeddings, components, WARC and HTML extraction against brute force; the pipeline."""

import hashlib
import re
import time
import tracemalloc
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bizlens.llm import embeddings, mainblocks, simhash, warc
from bizlens.llm.common import scratch_path
from bizlens.llm.components import components
from bizlens.llm.queries import QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL


def smallest_reachable(n, pairs):
    root = np.arange(n)
    a, b = (np.array(x, np.int64) for x in (zip(*pairs) if len(pairs) else ((), ())))
    simhash.unite(root, a, b)
    return simhash.find(root, np.arange(n))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 600, (500, 2)).tolist() + [[i, i + 1] for i in range(700, 760)] + [[5, 5]]
    links = spark.createDataFrame(pairs + pairs[:9], "a bigint, b bigint").union(spark.sql("select null, 1L"))
    root = smallest_reachable(800, pairs)
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: root[i] for p in pairs for i in p if p[0] != p[1]}
    assert components(links.where("false")).count() == 0


# ---- SimHash

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_contract_and_spark_hash(spark):
    texts = ["", None, " \n", "A b", "A B C d", "É X\x1cY z w", "one two three four five six"] + [
        r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40).collect()]
    assert [simhash.fingerprint(t or "") & (2**64 - 1) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1) == plain_fingerprint("A b c D")


def plain_groups(rows):
    fp = sorted({plain_fingerprint(t) for _, t in rows})
    at = {f: i for i, f in enumerate(fp)}
    u = np.array(fp, np.uint64)
    root = smallest_reachable(len(fp), [(i, j) for i in range(len(fp)) for j in
                                        np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 4).tolist()])
    least = {}
    for d, t in rows:
        k = root[at[plain_fingerprint(t)]]
        least[k] = min(least.get(k, d), d)
    return {d: (format(plain_fingerprint(t), "016x"), least[root[at[plain_fingerprint(t)]]]) for d, t in rows}


@pytest.mark.parametrize("options", [{}, {"shard_points": 40, "sample": 400}])
def test_simhash_groups_are_exact(spark, options):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    base = docs.first().text
    docs = docs.union(spark.createDataFrame(
        [(900, None), (901, ""), (902, "  ")] + [(1000 + i, base + f" tail{i}") for i in range(60)], docs.schema)) \
        .withColumn("component_id", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, **options).collect()}
    expected = plain_groups(rows)
    assert got == expected
    kept = simhash.keep_one(docs.union(docs.limit(20)), **options)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected.values()}) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_tree_finds_every_near_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(-2**63, 2**63 - 1, 3000, dtype=np.int64)
    crowd = np.full(700, base[0])
    for _ in range(3):
        crowd = crowd ^ np.left_shift(np.uint64(1), rng.integers(0, 64, 700).astype(np.uint64)).view(np.int64)
    points = np.unique(np.concatenate([base, crowd, base[:500] ^ 0b1011]))
    tree, leaves = simhash.build_tree(points[::3], len(points), 300)
    home, who, leaf = simhash.place(tree, points, 4)
    root = np.arange(len(points))
    for k in range(leaves):
        a, b = simhash.shard_links(points[home == k], points[who[leaf == k]], 4)
        simhash.unite(root, np.searchsorted(points, a), np.searchsorted(points, b))
    u = points.view(np.uint64)
    plain = smallest_reachable(len(points), [(i, j) for i in range(len(points)) for j in
                                             np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 4).tolist()])
    assert leaves > 4 and (simhash.find(root, np.arange(len(points))) == plain).all()


# ---- embeddings

def plain_links(rows):
    sound = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = embeddings.unit(np.array([rows[i][1] for i in sound], np.float64))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = smallest_reachable(len(sound), np.argwhere(near).tolist())
    out = {d: (0, d) for d, _ in rows}
    least = {}
    for k, i in enumerate(sound):
        least[root[k]] = min(least.get(root[k], rows[i][0]), rows[i][0])
    for k, i in enumerate(sound):
        out[rows[i][0]] = (int(near[k].sum()), least[root[k]])
    return out


@pytest.mark.parametrize("options", [{}, {"stored_block": 50, "asked_block": 70}])
def test_embedding_links(spark, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 64))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    across = rng.normal(size=base.shape)
    across -= (across * unit).sum(1)[:, None] * unit
    across /= np.linalg.norm(across, axis=1)[:, None]
    near = [c * unit + np.sqrt(1 - c * c) * across for c in (0.94, 0.952, 0.97, 0.99)]
    crowd = base[0] + 0.02 * rng.normal(size=(150, 64))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, *near, crowd, base[:9]])]
    vectors += [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, [-0.0] * 64]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("point", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_embeddings(df, **options).collect()}
    expected = plain_links(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in expected.values())
    assert found >= 0.99 * there and all(got[d][0] <= expected[d][0] for d in expected)
    assert found < there or {d: v[:2] for d, v in got.items()} == expected
    assert all(v[2] == (v[1] == d) for d, v in got.items())


def test_embeddings_empty_and_other_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 0.0]), (3, [2.0, 4.0]), (3, [2.0, 4.0]), (None, [5.0])],
                               "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.link_embeddings(df).collect()), key=str)
    assert got == [(1, 2, 1), (2, 0, 2), (3, 2, 1), (3, 2, 1), (None, 0, None)]
    assert embeddings.link_embeddings(df.where("false")).count() == 0


def test_recall_of_two_corner_buckets():
    rng = np.random.default_rng(8)
    x = embeddings.unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * embeddings.unit(z)
    for n in (10_000, 5_000_000):
        plan = embeddings.hash_plan(n)
        a, b = embeddings.buckets(x, plan), embeddings.buckets(y, plan)
        met = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
        assert met.mean() > 0.99


# ---- WARC

def test_warc_round_trip(spark):
    same = "a" * 120
    pages = [(5, "u", same), (3, "u\r\nx", same), (4, None, same), (None, "v", same), (7, "u", "short"), (8, "u", "short"),
             (9, "u", None), (3, "u", same), (10, "é", "é" * 60), (11, "w", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    index, records = warc.archive(df)
    got = sorted((tuple(r)[:1] + tuple(r)[2:6] for r in records.collect()), key=str)
    expected = []
    for p, _, html in pages:
        data = (html or "").encode()
        again = html == same and p != 3
        expected.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(expected, key=str)
    chosen = warc.read(index.where("page_id in (10, 11, 5)")).collect()
    assert {r.page_id: r.payload.decode() for r in chosen} == {10: "é" * 60, 11: "x" * 300_000, 5: ""}
    assert warc.archive(df.where("false"))[1].count() == 0


def test_warc_reads_in_as_many_tasks_as_the_bytes_ask_for(spark, monkeypatch):
    rows = [(i, "u", "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(3000)) + str(i)) for i in range(200)]
    index = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), scratch_path(spark, "w"))
    assert warc.tasks(index) == 1 and warc.tasks(index.where("false")) == 1
    total = index.agg({"length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "STRETCH", 2000)
    monkeypatch.setattr(warc, "TASK", total // 20)
    assert warc.tasks(index) >= 20
    got = warc.read(index)
    assert {r.page_id for r in got.collect()} == set(range(200)) and got.count() == 200
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 5 and max(sizes) < 100


def test_neighbouring_records_are_read_together():
    offsets = [0, 10, 30, 30 + warc.GAP + 50, 30 + warc.GAP + 70]
    assert list(warc.ranges(offsets, [10, 10, 10, 20, 5])) == [(0, 3), (3, 5)]
    assert list(warc.ranges([0, warc.MOST], [warc.MOST, 5])) == [(0, 1), (1, 2)]
    assert list(warc.ranges([], [])) == []


# ---- HTML

def plain_article(html):
    article = html[html.index("<article>") + 9:html.index("</article>")]
    parts = (" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", article))
    return "\n\n".join(p for p in parts if p)


def test_articles_of_the_pages(spark):
    got = QUERIES["op10_html"](spark, SF_ORACLE).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF_ORACLE}/pages.parquet").collect()}
    assert len(got) == len(html)
    for r in got:
        assert r.text == plain_article(html[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<html><body><header><h1>Site</h1><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to make this site better. Please accept them now.</p><button>OK</button></div>
<div id="content"><article><header><h1>A title</h1></header><p>First paragraph of the article, long enough.</p>
<p>Short.</p><ul><li>Point one</li><li>Point two</li></ul><p>Another &amp; text&nbsp;x &lt;b&gt;<script>no()</script>.</p>
<div class="ad"><p>Buy this now and save a lot of money today, really great offers for all.</p></div><p>Closing words.</p></article>
<section class="comments"><h3>Comments</h3><p>I really liked this article, it was very good and I learned a lot today.</p></section>
<aside><p>Related: other stories that you could read, with many words in it to look like content.</p></aside></div>
<form><label>Name</label><input name=q><p>Sign up for our letter, it is great and free for all of you.</p></form>
<footer><p>&copy; 2024 Site. All rights reserved.</p></footer><p unfinished"""


def test_page_with_all_kinds_of_boilerplate():
    assert mainblocks.main_text(PAGE).split("\n\n") == [
        "A title", "First paragraph of the article, long enough.", "Short.", "Point one", "Point two",
        "Another & text x <b> .", "Closing words."]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "plain < text & more"), (3, None, "<p>" * 3000),
                                   (4, "u", "<nav>menu</nav>"), (5, "u", "<p>" + "word " * 50_000 + "."), (6, "u", "</p></div>x &amp")],
                                  "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text) for r in mainblocks.extract(pages).collect()]
    assert got == [(1, ""), (2, ""), (3, "plain < text & more"), (3, ""), (4, ""), (5, "word " * 49_999 + "word ."), (6, "x &")]
    assert mainblocks.extract(pages.where("false")).count() == 0


ARTICLE = " ".join(f"This is sentence {i} of the article and it says a little more." for i in range(9))


@pytest.mark.parametrize("head", ["<head><title>T</title>{}", "<head><meta charset=utf-8><link rel=x href=y>{}", "<head>{}</head>"])
@pytest.mark.parametrize("start", ["<body>", "", "<body class=x>\n", "<!-- c -->"])
@pytest.mark.parametrize("inside", ["<div class=content><p>{}</p><p>{}</p></div>", "<article><p>{}</article><p>{}", "{}<p>{}"])
def test_a_head_without_end_tag_ends_where_the_body_starts(head, start, inside):
    body = start + inside.format(ARTICLE, "A short end.")
    assert mainblocks.main_text("<html>" + head.format(body)) == f"{ARTICLE}\n\nA short end."


def test_unclosed_hidden_elements_do_not_swallow_the_page():
    page = "<body><div>{}</div><article><p>%s</p></article></body>" % ARTICLE
    for tag in ("svg", "math", "select", "object", "video", "audio", "canvas", "noscript", "template"):
        for more in ("", f"<div><{tag}>x</{tag}></div>"):
            assert ARTICLE in mainblocks.main_text(page.format(f"<{tag}>") + more), tag
    assert ARTICLE in mainblocks.main_text(f"<body><svg><path><p>{ARTICLE}</p><svg></svg>")
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert mainblocks.main_text(page.format(f"<{tag}>")) == ""
    for tag in ("svg", "select", "video", "audio", "noscript", "template"):
        hidden = f"<p>{ARTICLE} <{tag}><div><b>hidden words</div></{tag}>end of it.</p>"
        if tag not in ("svg", "select"):
            assert mainblocks.main_text(hidden) == f"{ARTICLE} end of it."
    assert mainblocks.main_text(f"<p>{ARTICLE} <svg><text>hid</text><foreignObject><div>den</div></foreignObject></svg>end.") == f"{ARTICLE} end."
    assert mainblocks.main_text(f"<p>{ARTICLE} <select><option>a<option>b</select>end.") == f"{ARTICLE} end."


def test_text_of_formulas_and_fallbacks_stays():
    for tag in ("math", "object", "canvas"):
        assert mainblocks.main_text(f"<article><p>{ARTICLE} So <{tag}><mi>x</mi> = 2</{tag}> it is.</p>") == f"{ARTICLE} So x = 2 it is."


def test_minimum_cut_is_the_smallest():
    rng = np.random.default_rng(6)
    for _ in range(80):
        n = int(rng.integers(1, 9))
        scores = rng.normal(size=n).round(2).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(abs(s) for s, k in zip(scores, side) if (s > 0) != k and s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(mainblocks.content_side(scores, edges)) == pytest.approx(best)


# ---- pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    letterless = docs.limit(1).withColumn("doc_id", F.lit(5_000_000).cast("bigint")).withColumn("text", F.lit("123 !!"))
    now = docs.union(letterless)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF_ORACLE)
        if name != "bpe":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out = spark.createDataFrame(out.collect(), out.schema)
        counts.append(out.count())
        if name == "language_id":
            assert out.where("doc_id = 5000000").count() == 0 and counts[-1] == docs.count()
        if name == "simhash_dedup":
            groups = plain_groups([(r.doc_id, r.text) for r in now.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in groups.values()})
        if name == "pseudonyms":
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
            assert out.where(F.col("text").rlike(r"@mail[0-9]\.example")).count() == 0
        now = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "pseudonyms", "source_mix", "bpe"]
    assert counts[-1] == counts[-2] == corpus_pipeline.run(spark, SF_ORACLE).count()


def test_pipeline_on_an_empty_table(spark):
    now = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF_ORACLE)
        assert out.count() == 0
        now = spark.createDataFrame([], out.schema)


SHARED_NAMES = ("search-results", "social-science", "legal", "discussion", "menu-planning", "notice-board-history", "banner",
                "widget", "related-work", "toc", "share")
PLAIN_NAMES = ("comments", "comment-thread", "ad", "ad-slot-300", "cookie-law-info", "sidebar", "newsletter-cta", "nav", "site-nav",
               "footer", "promo-box")


def named_page(name, inside, kind):
    """A page whose part of class ``name`` stands inside or behind the article: prose or a list of links."""
    whole = " ".join(f"sentence {i} of the part tells more about rivers." for i in range(8))
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(6))
    part = f'<div class="{name}"><h2>A part</h2><p>{whole}</p><p>{whole}</p></div>' if kind == "prose" \
        else f'<div class="{name}"><ul>{links}</ul></div>'
    body = f"<h1>Title</h1><p>{ARTICLE}</p>"
    return f"<body><article>{body}{part}<p>{ARTICLE}</p></article></body>" if inside \
        else f"<body><article>{body}</article>{part}</body>", whole


def test_names_that_articles_use_too():
    """Precision and recall of parts, by names that articles and boilerplate share and names of boilerplate alone."""
    right = wrong = missed = 0
    for names, shared in ((SHARED_NAMES, True), (PLAIN_NAMES, False)):
        for name in names:
            for inside in (True, False):
                for kind in ("prose", "links"):
                    page, whole = named_page(name, inside, kind)
                    text = mainblocks.main_text(page)
                    assert ARTICLE in text and "Title" in text
                    kept = (whole if kind == "prose" else "Link number 3") in text
                    wanted = shared and inside and kind == "prose"
                    right, wrong, missed = right + (kept and wanted), wrong + (kept and not wanted), missed + (wanted and not kept)
                    if kept and wanted:
                        assert text.count(whole) == 2 and "A part" in text
    assert (right, wrong, missed) == (len(SHARED_NAMES), 0, 0)


def test_deep_and_broken_pages_take_linear_time_and_memory():
    for many in ("<font>x ", "<a ", "<div>w ", "<svg>", "<p>", "<b></i>"):
        start = time.perf_counter()
        mainblocks.main_text(f"<p>{ARTICLE}</p>" + many * 20_000)
        assert time.perf_counter() - start < 10, many
    tracemalloc.start()
    mainblocks.main_text("<font>x " * 20_000)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_comment_without_an_end_is_dropped():
    assert mainblocks.main_text(f"<p>{ARTICLE}</p><!-- so > it <b> goes") == ARTICLE
    assert mainblocks.main_text(f"<p>{ARTICLE}</p><!-- so") == ARTICLE


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, f"<p>{ARTICLE}</p>", "x", 2, "y", "z")], "page_id int, html string, _html string, `a.b` int, text string, `c``d` string")
    got = mainblocks.extract(df)
    assert got.columns == ["page_id", "_html", "a.b", "c`d", "text", "n_chars"]
    assert tuple(got.first()) == (1, "x", 2, "z", ARTICLE, len(ARTICLE))

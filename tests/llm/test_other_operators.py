"""Operators on pages and vectors, the queries and the pipeline."""

import itertools
import math
import re
import string
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vellumite.llm import hnsw, html, language, neardup, queries, toxicity, urls

DATA = "/root/testdata/sf0.001"
WORDS = "word " * 40


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>hi", "hi"),
        ("<nav><a>x</a></nav><article><h1>T</h1><p>A &amp; b\n c&nbsp;d<br>e<p>f</article><footer>&copy; y</footer>", "T\n\nA & b c d e\n\nf"),
        ("<article><p>a<aside>ad</aside>b</p><form><p>x</form><section class='comments'><p>y</p></section><p>c</p></article><p>z", "a\n\nb\n\nc"),
        (f"<div class='menu'><a>Home</a></div><div id=content><p>{WORDS}</p><p>Short.</p><p>{WORDS}</p></div><div class=sidebar>x</div><div id='comments'><p>{WORDS}</p></div>", "\n\n".join([WORDS.strip(), "Short.", WORDS.strip()])),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><main><p>yes</main>", "yes"),
        ("<div class=ad>never closed<article><p>yes</p></article>", "yes"),
        ("<article></article>", ""),
        ('<article><p title="a>hello</p><p data-x=don\'t>there</p><p title="a > b" class=x>you</p></article>', "hello\n\nthere\n\nyou"),
        ('<article><p title="open>one</p><p><a href="y">two</a></p></article>', "one\n\ntwo"),
        ("<article><p>a <math><mi>x</mi></math> b</p><noscript><p>c</p></noscript><object><p>d</p></object></article>", "a x b\n\nc\n\nd"),
        ('<article><p class="share-price">1.5</p><p class="note related">see</p><p class="ad">buy</p><div class="share-buttons">x</div><div class="post-comments big">y</div><p>z</p></article>', "1.5\n\nsee\n\nz"),
        (f"<p>{WORDS}</p><nav><a>x</a></nav><p>Short closing remark.</p>", f"{WORDS.strip()}\n\nShort closing remark."),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


class Reader(HTMLParser):
    """The blocks of articles, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.blocks, self.now = 0, 0, [], ""

    def close_block(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        if tag == "br":
            self.now += " "
        elif tag not in ("b", "i", "a", "em", "span"):
            self.close_block()

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style")
        if tag not in ("b", "i", "a", "em", "span"):
            self.close_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.now += data


def test_main_text_is_what_another_parser_reads(spark):
    """The query's rows of the given pages, all of which mark an article without asides in it."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.line_block_text(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        reader = Reader()
        reader.feed(pages[r["page_id"]]["html"])
        reader.close_block()
        assert r["text"] == "\n\n".join(reader.blocks) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_lines_of_links_dive_in_a_marked_article():
    links = "".join(f"<p><a href=x>A story much like this one, {k}</a></p>" for k in range(4))
    assert html.extract(f"<article><p>{WORDS}</p><div class=xyz>{links}</div><p>End.</p></article>") == f"{WORDS.strip()}\n\nEnd."
    assert html.extract(f"<article><p>{WORDS}</p><p><a href=x>One link.</a></p><p>Of.</p><p>To.</p><p>In.</p></article>").split("\n\n")[1:] == ["One link.", "Of.", "To.", "In."]


@pytest.mark.parametrize("closing", ["word " * 40, "Short end."])
@pytest.mark.parametrize("page", ["{nav}<div id=body><p>{long}</p><div class=ad>Buy</div><p>{end}</p></div>{nav}", "{nav}<p>{long}</p><div class=ad>Buy</div><p>{end}</p>", "{nav}<div id=body><div><p>{long}</p></div>{nav}<div><p>{long}</p></div>{nav}<p>{end}</p></div>"])
def test_asides_do_not_part_an_unmarked_text(page, closing):
    nav = "".join(f"<div><a href=x>Page {k}</a></div>" for k in range(4))
    text = html.extract(page.format(nav=nav, long="word " * 400, end=closing))
    assert text.split("\n\n") == [x.strip() for x in ["word " * 400] * page.count("{long}") + [closing]]


def test_main_text_of_tables(spark):
    rows = [(1, "u", "<p>" + "long " * 200_000, "t"), (2, None, None, None), (2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(pages, ["page_id", "url"]).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 999_999), (2, 0), (2, 0)]
    assert html.main_text(pages.limit(0), ["page_id"]).collect() == []


def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    for k in range(0, 120, 4):
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, 16)) * 0.12
    x[200:220] = x[200]
    rows = [(k, [float(v) for v in x[k]], k % 3) for k in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [float("inf")] + [1.0] * 15, 0), (304, [None] + [1.0] * 15, 0), (305, rows[0][1], None), (306, [1.0, 2.0], 0), (7, rows[7][1], 1)]
    return rows


def test_near_duplicates(spark):
    rows = vectors()
    good = {i: (np.array(v), label) for i, v, label in rows if label is not None and v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, la) in good.items():
        for j, (b, lb) in good.items():
            if i != j and la == lb and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links[i] += 1
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neardup.near_duplicates(table, neardup.Parameters(tile=40, strip=16)).collect()
    assert len(got) == len(rows) and sum(links.values()) > 100
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], root(i), root(i) == i)
    # tiles that are empty
    few = neardup.near_duplicates(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(6)], "vec_id long, embedding array<double>, label int"), neardup.Parameters(tile=1)).collect()
    assert [(r["n_links"], r["component_id"]) for r in few] == [(5, 0)] * 6
    assert neardup.near_duplicates(table.limit(0)).collect() == []


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24)) * np.exp(rng.normal(size=(200, 1)) * 5)
    codes, scale, error, norm = neardup.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(unit @ unit.T - near) <= error[:, None] * norm + error + 1e-12).all()


def test_hnsw(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    p = hnsw.Parameters(shard=64, beam=48, block=16)
    got = {}
    for r in hnsw.nearest(table, table.where("vec_id % 5 = 0"), p).collect():
        got.setdefault(r["query_id"], []).append(r)
    good = {i: np.array(v) for i, v, _ in rows if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    hit = total = 0
    for i in (i for i in good if i % 5 == 0):
        score = {j: good[i] @ v / (np.linalg.norm(good[i]) * np.linalg.norm(v)) for j, v in good.items() if j != i}
        mine = sorted(got[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in mine)
        best = sorted(score.values(), reverse=True)[:5]
        hit += sum(r["score"] >= best[-1] - 1e-12 for r in mine)
        total += 5
    assert hit / total >= 0.9
    assert set(got) == {i for i in good if i % 5 == 0}
    few = table.where("vec_id < 3")
    assert hnsw.nearest(few, few, p).count() == 6
    same = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(200)] + [(900, [2.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    ties = {}
    for r in hnsw.nearest(same, same.where("vec_id % 50 = 0"), hnsw.Parameters(shard=30)).orderBy("rank").collect():
        ties.setdefault(r["query_id"], []).append(r["vec_id"])
    assert ties == {q: [k for k in range(6) if k != q][:5] for q in (0, 50, 100, 150)} | {900: [0, 1, 2, 3, 4]}
    assert hnsw.nearest(table.limit(0), table.limit(0), p).collect() == []


def test_hnsw_recall_of_the_query(spark):
    """The query's rows against brute force on the original vectors."""
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    good = [r for r in rows if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in good]), np.array([r["embedding"] for r in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.hnsw_search(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    hits = []
    for k in np.flatnonzero(ids % 50 == 0):
        near = x @ x[k]
        near[k] = -9
        hits += [s >= np.sort(near)[-5] - 1e-9 for s in got[ids[k]]]
    assert len(hits) == 5 * len(got) and np.mean(hits) >= 0.9


def test_urls(spark):
    rows = [(1, "http://a.ORG/x", "h"), (2, "https://b.example.org/es/1?q", "h"), (3, "https://example.org/en/12", "h"), (4, "x://example.org/en/2#f", "h"), (5, "http://m.com/de/", "h"), (6, "http://m.com/fr/", "h"), (7, None, "h"), (8, "no scheme", "h"), (9, "http://evil.net", "h"), (10, "http://notexample.org/es/", "h"), (10, "http://notexample.org/es/", "h"), (11, "http://org", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, bound string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(pages, ["page_id"]).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("b.example.org", "/es/1", "example.org/es/", "block")
    assert got[3][2:] == ("example.org/en/1", "block") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7][:3] == ("", "", None) == got[8][:3] and got[9][:3] == ("evil.net", "", None)
    assert got[10][2:] == ("org/", "allow") and got[11][2] is None
    assert urls.judge(pages.limit(0), ["page_id"]).collect() == []


@pytest.mark.parametrize("host,site,domain,suffix", [("a.b.co.uk", "a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk", "co.uk"), ("x.example.org:8080", "x.example.org", "example.org", "org"), ("me:pw@example.com.", "example.com", "example.com", "com"), ("10.0.0.1:80", "10.0.0.1", "10.0.0.1", "10.0.0.1"), ("localhost", "localhost", "localhost", "localhost"), ("", "", "", ""), ("www.com.de", "www.com.de", "www.com.de", "com.de")])
def test_registered_domains(spark, host, site, domain, suffix):
    df = spark.createDataFrame([(host,)], "host string").select(urls.site(F.col("host")).alias("s"))
    d, x = urls.domain_and_suffix(F.col("s"))
    assert tuple(df.select("s", d, x).first()) == (site, domain, suffix)


def test_hosts_below_a_country_do_not_pool(spark):
    rows = [(k, f"http://bad.co.uk/de/{k}") for k in range(60)] + [(100 + k, f"http://good.co.uk/fr/{k}") for k in range(60)] + [(300, "http://new.bad.co.uk/"), (301, "http://good.co.uk:81/en/")]
    rules = (("block", "uk", "/de/"), ("allow", "uk", "/fr/"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), ["page_id"], rules).collect()}
    assert (got[300], got[301]) == ("block", "allow")


def test_bad_hosts_are_blocked_and_good_ones_are_not(spark):
    rows = [(k, f"http://bad.com/de/{k}") for k in range(60)] + [(100 + k, f"http://good.com/fr/{k}") for k in range(60)] + [(300, "http://bad.com/en/"), (301, "http://good.com/en/"), (302, "http://new.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, ["page_id"]).collect()}
    assert (got[300], got[301], got[302]) == ("block", "allow", "allow")


def test_url_plan_has_no_python(spark):
    plan = queries.url_filter(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def first_of_groups(texts, width, percent):
    """The smallest id of each group of linked texts, by all pairs."""
    sets, parent = {i: shingles(t, width) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            u, v = sorted((root(a), root(b)))
            parent[v] = u
    return {i for i in texts if root(i) == i}


def test_pipeline_stages_are_their_brute_force_versions(spark):
    """Each stage on what its predecessor kept, against plain Python; run() against the stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, labels = docs.columns, spark.read.parquet(f"{DATA}/labels.parquet")
    (_, by_language), (_, by_toxicity), (_, by_copies), (_, packed) = corpus_pipeline.STAGES
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = by_language(spark, docs, DATA)
    assert kept.columns == names
    judge = language.Classifier(language.learn(docs), language.Parameters())
    before, now = texts(docs), texts(kept)
    assert now == {i: t for i, t in before.items() if judge.predict(t or "")[2]} and len(now) > 0.9 * len(before)

    kept, docs = by_toxicity(spark, kept, DATA), kept
    assert kept.columns == names
    p = toxicity.Parameters()
    model = toxicity.train(docs, labels, p)
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def score(text):
        _, hashes, _ = next(toxicity.features(pa.array([text]), p))
        times = Counter(hashes.tolist())
        g = model.bias + sum(w for h, n in times.items() if h in weights for w, least in zip(weights[h], toxicity.LEVELS, strict=True) if n >= least)
        return 1 / (1 + math.exp(-max(-30, min(30, g))))

    before, now = now, texts(kept)
    assert now == {i: t for i, t in before.items() if score(t) < p.threshold} and len(now) > 0.8 * len(before)

    kept = by_copies(spark, kept, DATA)
    assert kept.columns == names
    before, now = now, texts(kept)
    assert now == {i: before[i] for i in first_of_groups(before, 5, 80)} and len(now) < len(before)

    library, full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in now.items():
        full[i] = [*library.encode(t or "", add_special_tokens=False).ids, 2]
    pieces, spans = packed(spark, kept, DATA).collect(), {}
    for x in pieces:
        ids = full[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert x["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and x["doc_tokens"] == len(full[x["doc_id"]])
        spans.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sum(x["length"] for x in pieces) == sum(map(len, full.values()))
    used = [sum(n for _, n in sorted(x)) for _, x in sorted(spans.items())]
    assert used[:-1] == [4096] * (len(used) - 1) and all(a == sum(n for _, n in sorted(x)[:k]) for x in spans.values() for k, (a, _) in enumerate(sorted(x)))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()} == set(now)


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in queries.toxicity_pu(spark, sf_dir).where("held_out").collect() if labels.get(r["doc_id"]) is not None]
    found, flagged = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert len(found) > 100 and np.mean(found) >= 0.85 and np.mean(flagged) <= 0.04


def test_pipeline_stages_pass_odd_rows_and_names(spark):
    rows = [(k, f"plain words {k} of a text that goes on {k}", "en", 0.5, "x") for k in range(20)] + [(3, "plain words 3 of a text that goes on 3", "en", 0.5, "x"), (50, None, None, None, None), (51, "", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, accepted string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "score", "accepted"]
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(20))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
    odd = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, "", "c"), (3, "word " * 30_000, "d")], "doc_id long, text string, ids string"), DATA).collect()
    assert sorted((r["doc_id"], r["length"]) for r in odd if r["doc_id"] < 3) == [(1, 1), (1, 1), (2, 1)] and sum(r["length"] for r in odd) == 30_004
    gone = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame([(1, None, 0.5), (2, "", 0.5)], "doc_id long, text string, score double"), DATA)
    assert sorted(r["doc_id"] for r in gone.collect()) == [1, 2]

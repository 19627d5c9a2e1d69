"""Page text, quality rules, the classifier, the registered SQL and the pipeline."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linktide.llm import html_text, ordinal, quality_rules

FOLDER = "/root/testdata/sf0.001"
WORDS = "people often find that long sentences with many ordinary words carry the story of an article further".split()


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


A, B, C = prose(1), prose(2), prose(3, 60)
PAGES = {
    "article": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Big  news</h1>"
        f"<p>{A}<p>Short.</p><script>if (a < b) '</p>'</script><p>{B} &amp; &eacute;&#233;<br>end</p></article>"
        f"<aside>{C}</aside><footer>&copy; us</footer></body>",
        f"Big news\n{A}\nShort.\n{B} & éé end",
    ),
    "plain layout": (
        f"<body><div id=top-menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class='content'><h1>Title</h1>"
        f"<p>{A}</p><p>{B}</p><ul><li>first point<li>second point</ul><p>{C}</p></div>"
        f"<div class='sidebar widget'><p>{A}</p></div><div id=comments><p>{B}</p></div>"
        f"<div class=cookie-notice>{C}</div><div>Copyright</div></body>",
        f"Title\n{A}\n{B}\nfirst point\nsecond point\n{C}",
    ),
    "comments inside": (
        f"<main><article><header><span>by me</span><h1>Head</h1></header><p>{A}</p><div class=\"advert\"><p>{B}</p></div>"
        f"<form><label>Name</label><input><button>Go</button></form><section class='reader-comments'><article><p>{C}</p></article>"
        f"</section><footer>tags</footer></article></main>",
        f"Head\n{A}",
    ),
    "unclosed": (f"<article><p><b>{A}<p>x <i>y</i>z<div>{B}", f"{A}\nx yz\n{B}"),
    "has-sidebar": (f"<body class=menu-open><div class='main has-sidebar'><p>{A}</p><p>{C}</p></div></body>", f"{A}\n{C}"),
    "null": (None, ""),
    "empty": ("", ""),
    "no content": ("<html><nav>menu</nav><script>x</script></html>", ""),
    "bare": ("just &lt;text&gt;\n here", "just <text> here"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert html_text.main_text(html) == want


def test_long_page_is_read_whole():
    blocks = [prose(i, 30) for i in range(3000)]
    assert html_text.main_text("<article>" + "".join(f"<p>{b}</p>" for b in blocks)) == "\n".join(blocks)
    assert html_text.main_text("<div>" * 5000 + A) == A


def test_extract(spark):
    rows = [(i, "u", h, "mine") for i, (h, _) in enumerate([*PAGES.values(), PAGES["article"], (None, "")])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, TEXT string")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i, (_, want) in enumerate(PAGES.values()):
        assert out[i].text == want and out[i].n_chars == len(want)
    assert html_text.extract(pages).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_every_given_page_keeps_its_article(spark):
    """The given pages have one article of headings and paragraphs, from which the text follows directly."""
    import html
    import re

    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


def brute_repeats(words, n=5):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    seen = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(n)})


def test_measures(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e f", "a b c d e " * 2, "x " * 40, "a\nb\na\n \n \na", "é*# <|>$%&",
             "w " * 30_000, "a\r\nb\x0bc\x0cd"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = docs.select("doc_id", "text", *quality_rules.measures().values())
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        text = r.text or ""
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
                len(lines) - len(set(lines)), brute_repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, text[:40]


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, share) for n in (1, 10, 500, 5000) for share in (0.01, 0.05, 0.3) for k in range(0, int(n * share) + 1, 7)]
    for share in {c[2] for c in cases}:
        rows = [(k, n) for k, n, s in cases if s == share]
        df = spark.createDataFrame(rows, "k bigint, n bigint")
        tail = quality_rules.binomial_tail(F.col("k"), F.col("n"), share).alias("p")
        for r in df.select("k", "n", tail).collect():
            exact = math.fsum(
                math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(share)
                         + (r.n - i) * math.log1p(-share))
                for i in range(r.k + 1)
            )
            assert r.p == pytest.approx(exact if r.k < r.n * share else 1.0, rel=1e-9)


def _measured(spark, n, bad):
    """``n`` documents a stratum, the share ``bad`` of them full of symbols."""
    return spark.range(2 * n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < n, "a").otherwise("b").alias("stratum"),
        F.lit(50).cast("bigint").alias("n_words"), F.lit(250).cast("bigint").alias("word_chars"),
        F.when(F.rand(4) < bad, 60).otherwise(1).cast("bigint").alias("n_symbols"), F.lit(5).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_dup_lines"), F.lit(0).cast("bigint").alias("n_repeat_words"), F.lit(9).alias("Kept"),
    ).cache()


def test_cutoffs_keep_the_promise(spark):
    measured = _measured(spark, 3000, 0.2)
    good = measured.select("doc_id", F.when(F.col("n_symbols") < 50, 1).otherwise(0).alias("quality"))
    judged = quality_rules.judge(measured, good.where("doc_id < 3000"), "stratum")
    seen = {(r.stratum, r.n_symbols > 50, r.kept) for r in judged.collect()}
    assert seen == {("a", False, True), ("a", True, False), ("b", False, True), ("b", True, True)}
    assert judged.columns.count("kept") == 1 and "Kept" not in judged.columns
    all_good = measured.select("doc_id", F.lit(1).alias("quality"))  # a rule that refuses a fifth of the good is unsafe
    assert quality_rules.judge(measured, all_good, "stratum").where("not kept").count() == 0
    few = good.where("doc_id < 200")
    assert quality_rules.judge(measured, few, "stratum").where("not kept").count() == 0
    nothing = quality_rules.judge(measured.limit(0), good, "stratum")
    assert nothing.count() == 0 and nothing.columns[-2:] == ["base_failed", "kept"]
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 0)], "doc_id bigint, quality int")
    assert quality_rules.judge(measured, nulls, "stratum").count() == 6000


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    grades = ordinal.graded(labels)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.train(docs, grades.where(~held))
    rated = ordinal.rate(docs, model).join(grades.where(held), "doc_id").collect()
    right = [(r.tail >= 0.5) == (r.grade == 2) for r in rated]
    assert len(right) > 60 and np.mean(right) > 0.85
    mean = lambda g: np.mean([r.expected_grade for r in rated if r.grade == g])
    assert mean(0) < mean(2) and mean(1) < mean(2)
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rated)


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    strength = rng.normal(size=40)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(1500)]
    latent = np.array([strength[r].sum() for r in rows]) + rng.logistic(size=1500) * 0.3
    grades = np.digitize(latent, np.quantile(latent, [0.3, 0.6, 0.9]))
    used, weights, thresholds = ordinal.fit_ordinal(rows, grades, 4)
    assert (np.diff(thresholds) > 0).all()
    full = np.zeros(ordinal.FEATURES)
    full[used] = weights
    model = ordinal.Ordinal(full, thresholds)
    scores = np.array([model.score(r) for r in rows])
    assert np.corrcoef(scores, latent)[0, 1] > 0.9
    assert np.allclose(np.diff(np.concatenate([np.zeros((1500, 1)), model.cumulative(scores)], axis=1)) >= 0, True)


def test_classifier_edges(spark):
    schema = "doc_id bigint, text string, grade string"
    docs = spark.createDataFrame([(1, "good text " * 30, "x"), (2, None, "y"), (None, "", "z"), (4, "a " * 50_000, "x"), (1, "again", "x")], schema)
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (2, 0, 0), (4, 1, 1), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int"
    )
    assert {(r.doc_id, r.grade) for r in ordinal.graded(labels).collect()} == {(1, 2), (2, 1), (4, 0)}
    rated = ordinal.rate(docs, ordinal.train(docs, ordinal.graded(labels)))
    assert rated.count() == 5 and rated.columns == ["doc_id", "text", "grade", "expected_grade", "tail"]
    assert ordinal.train(docs, ordinal.graded(labels.limit(0))) is None
    assert ordinal.select_good(docs, labels.limit(0)).count() == 5
    assert ordinal.select_good(docs.limit(0), labels).columns == docs.columns


def test_registered_queries_match_their_sql(spark):
    from checks.run import compare, connect
    from linktide.llm.queries import ORACLES, QUERIES

    con = connect(FOLDER)
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, FOLDER), con, sql).startswith("ok"), name
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from linktide.llm import exact, shingles

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
        had, has = ids(given), ids(docs)
        assert set(has) <= set(had)
        if name != "packed":
            assert docs.columns == columns
        if name == "quality":
            rated = ordinal.rate(given, ordinal.train(given, ordinal.graded(spark.read.parquet(f"{FOLDER}/labels.parquet"))))
            assert has == ids(rated.where("tail >= 0.5")) and sum(has.values()) < before
        if name == "exact_copies":
            groups = {}
            for r in given.collect():
                groups.setdefault("".join(c for c in r.text if c not in " \t\n\x0b\f\r"), []).append((-len(r.text), r.doc_id))
            assert has == Counter(min(g)[1] for g in groups.values())
        if name == "near_copies":
            grams = {r.doc_id: set(shingles.shingle_set(r.text.encode()).tolist()) for r in given.collect()}
            root = {d: d for d in grams}
            holders = {}
            for d, mine in grams.items():
                for g in mine:
                    holders.setdefault(g, []).append(d)
            shared = Counter(pair for ds in holders.values() for pair in itertools.combinations(sorted(ds), 2))

            def find(d):
                while root[d] != d:
                    d = root[d]
                return d

            for (a, b), both in shared.items():
                if both >= 0.8 * len(grams[a] | grams[b]):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
            assert set(has) == {d for d in grams if find(d) == d}
        if name == "mixture":
            assert max(has.values()) <= 3
        if name == "packed":
            assert has == had
    assert exact.mark_copies(spark.read.parquet(str(tmp_path / "2"))).where("not kept").count() == 0
    final = corpus_pipeline.run(spark, FOLDER)
    assert Counter(r.doc_id for r in final.collect()) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0, name


LONG = "Long sentences with many ordinary words carry the story of this article further along. " * 3


@pytest.mark.parametrize(
    "html,want",
    [
        # end tags of inline elements inside clutter do not close it
        (f"<article><p>{LONG}</p><span class='ad'>BUY <span>now</span> LEAK</span><p>{LONG}</p></article>", [LONG, LONG]),
        (f"<article><p>{LONG}</p><a class='share'><div><a>s</a>X</div>Y</a><p>{LONG}</p></article>", [LONG, LONG]),
        # the class of an article tells its subject; a negated hint is none
        (f"<article class='post category-social'><p>{LONG}</p></article>", [LONG]),
        (f"<article class='post tag-search'><p>{LONG}</p></article>", [LONG]),
        (f"<div class='content-with-sidebar'><p>{LONG}</p></div>", [LONG]),
        (f"<div class='sidebar'><p>menu</p></div><div class='no-sidebar'><p>{LONG}</p></div>", [LONG]),
        (f"<article><div class='post-header'><h1>Title</h1><span>by me</span></div><p>{LONG}</p></article>", ["Title", LONG]),
        # an element left open takes the page, so tags alone decide
        (f"<nav><a href=/>home</a><article><h1>T</h1><p>{LONG}</p></article>", ["T", LONG]),
        # teasers are articles, the text is not
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article>Teaser one</article><article>Teaser two</article>", [LONG, LONG]),
        (f"<article><p>super<wbr>cali {LONG}</p></article>", [f"supercali {LONG}"]),
        ("<nav>only</nav><script>x</script>", []),
    ],
)
def test_page_text_of_ordinary_pages(html, want):
    assert html_text.main_text(f"<html><body>{html}</body></html>") == "\n".join(w.strip() for w in want)


def test_stray_end_tags_are_cheap():
    begun = time.time()
    assert html_text.main_text("<body>" + "<div>" * 20_000 + f"<p>{LONG}</p>" + "</x>" * 20_000) == LONG.strip()
    assert time.time() - begun < 5

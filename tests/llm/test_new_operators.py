"""Divergences, centroids and main texts against plain versions, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from brindle.llm import centroids, divergence, extract


def clashing(df):
    return df.withColumns({c: F.lit(k) for k, c in enumerate(["id", "term", "n", "p", "block", "at", "cluster", "vector", "part", "rank", "value", "item"])}).repartition(3)


# Divergences


def plain_audit(rows, least, top):
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    terms = lambda t: [m.group().translate({c: c + 32 for c in range(65, 91)}) for m in re.finditer("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        held[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(apart(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            marked = [(-apart(own[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(marked)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdéß日Z") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for k in range(260):
        source = f"s{rng.randrange(9)}" if k % 3 else "hot"
        rows.append((rng.choice(["en", "fr"]), source, " ".join(rng.choice(words[: 40 + 8 * rng.randrange(10)]) + rng.choice(["", ",", "7x", "\u0000"]) for _ in range(rng.randrange(40)))))
    rows += [(None, None, None), (None, "a", ""), ("en", "empty", None), ("xx", "one", "a b c"), ("en", "", "A a B"), rows[0], rows[0], ("fr", "long", "word " * 60_000 + "x" * 3000)]
    return rows


@pytest.mark.parametrize("source_block", [32, 2])
def test_audit(spark, corpus, monkeypatch, source_block):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", source_block)
    monkeypatch.setattr(divergence, "TERM_BLOCKS", 3)
    docs = clashing(spark.createDataFrame(corpus, "lang string, source string, text string"))
    got = sorted(map(tuple, divergence.audit(docs, least_docs=4, top=5).collect()))
    assert got == plain_audit(corpus, 4, 5) and len({r[1] for r in got}) > 9
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_plans_are_small(spark, corpus):
    """counts are not made anew for each side that needs them; the driver's plan has few reads."""
    docs = spark.createDataFrame(corpus, "lang string, source string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    plan = divergence.audit(docs, least_docs=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 5


def test_terms_across_slabs(monkeypatch):
    text = ("Ab cd " * 50 + "e" * 200 + " f").encode()
    whole = [w for words in divergence._words(text) for w in words]
    monkeypatch.setattr(divergence, "SLAB", 16)
    assert [w for words in divergence._words(text) for w in words] == whole == text.lower().split()


# Centroids


def plain_clusters(rows, clusters, rounds, dims, scale):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in order[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[near(q)[1]].append(q)
        centres = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(centres)]
    found = [(i, near(q)[1], near(q)[0]) for i, q in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), tuple(centres[k])) for i, k, d in found), key=repr)


@pytest.mark.parametrize(("chunk", "width"), [(16_384, 2), (50, 3), (7, 1)])
def test_clusters(spark, monkeypatch, chunk, width):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(k, [rng.gauss(0, 0.2) + (k % 3) for _ in range(8)]) for k in range(200)]
    rows += [(200, rows[0][1]), (5, rows[5][1]), (None, rows[7][1]), (201, None), (202, [1.0] * 7), (203, [float("nan")] * 8), (204, [float("-inf")] + [0.0] * 7), (205, [None] + [0.0] * 7), (206, [-1e6] * 8), (207, [])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = centroids.clustered(df, clusters=6, rounds=3, dims=8, scale=64, width=width)
    got = sorted(((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in found.collect()), key=repr)
    assert got == plain_clusters(rows, 6, 3, 8, 64)
    assert centroids.clustered(df.limit(0), dims=8).count() == 0
    few = centroids.clustered(df.where("vec_id in (1, 2)"), dims=8)
    assert sorted(r.distance for r in few.collect()) == [0, 0] and few.select("cluster").distinct().count() == 2


def test_too_large_components_are_told(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(df, dims=4).collect()


# Main texts

ARTICLE = "<h1>The title &amp; more</h1><p>One <b>bold</b>\n  word, and a long first paragraph of the text.<br>After a break.<p>Short.<ul><li>An item of prose that says a thing</li><li>Another item, quite as long as the first</ul><blockquote>Quoted.</blockquote><table><tr><td>cell one<td>cell two</table>"
LINES = ["The title & more", "One bold word, and a long first paragraph of the text. After a break.", "Short.", "An item of prose that says a thing", "Another item, quite as long as the first", "Quoted.", "cell one", "cell two"]
CHROME = [
    "<nav><ul><li><a href=/>Home</a><li><a href=/x>Somewhere else entirely, a long link text for a menu</a></ul></nav>",
    "<header><div>A site of many words about everything there is</div></header>",
    "<div class='cookie-notice'>We use cookies so that you have a better time with all of our pages.</div>",
    "<div class=\"ad\">Buy this now, it is the very best that money can buy, and more.</div>",
    "<aside><h2>Related</h2><p>A long paragraph in a sidebar that tells of other things to read.</p></aside>",
    "<form><label>Your name and address and more</label><input><textarea>text</textarea></form>",
    "<script>var t = '<p>not a text of any kind</p>';</script><style>p { margin: 0 }</style>",
    "<section id=\"comments\"><article class=comment><p>First! I read all of this long text and I liked it very much indeed.</p></article></section>",
    "<footer>&copy; all rights and more words than one needs in a footer</footer>",
    "<ul class=list><li><a href=1>One more link of several words</a><li><a href=2>Two more links of several words</a><li><a href=3>Three</a></ul>",
    "<!-- a comment of markup <p>with a tag</p> -->",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content><div class=body>{}</div></div>"])
@pytest.mark.parametrize("seed", range(4))
def test_main_texts_of_pages(wrap, seed):
    rng = random.Random(seed)
    around = rng.sample(CHROME, len(CHROME))
    page = "<!DOCTYPE html><html><head><title>Not this</title></head><body>" + "".join(around[:6]) + wrap.format(ARTICLE) + "".join(around[6:]) + "</body></html>"
    assert extract.main_text(page).split("\n") == LINES


def test_main_texts_of_odd_pages(spark):
    long = "word " * 100_000
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain  text\n only"), (4, "u", "<p>unclosed <b>and bold"), (5, "u", f"<article><p>{long}<p>end</article>"), (6, "u", "<nav>only a menu</nav>"), (7, "u", "<article><h1>T</h1><p>a &lt; b &eacute; &#x65E5; &am</p></article></div></p>"), (7, "u", "<p>again</p>"), (None, "u", "<div>x</div>"), (8, "u", "<div class=ad><article><p>The advert was left open before this text.</p></article>")]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = sorted(((r.id or 0, r.url, r.text, r.n_chars) for r in extract.main_texts(df).collect()), key=repr)
    texts = {1: "", 2: "", 3: "plain text only", 4: "unclosed and bold", 5: long.strip() + "\nend", 6: "", 8: "The advert was left open before this text."}
    wanted = [(k, u if k != 2 else None, t, len(t)) for k, t in texts.items() for u in ["u"]] + [(7, "u", t, len(t)) for t in ("T\na < b é 日 &am", "again")] + [(0, "u", "x", 1)]
    assert got == sorted(wanted, key=repr)
    assert extract.main_texts(df.limit(0)).count() == 0

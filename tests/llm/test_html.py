import html as H
import re

import pytest

from pointloom.llm import html as X

SF = "/root/testdata/sf0.01"


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = {r.page_id: r for r in X.op7_main_text(spark, SF).collect()}
    for page, url, source in zip(pages.page_id, pages.url, pages.html):
        inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
        blocks = (re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert (got[page].text, got[page].n_chars, got[page].url) == (want, len(want), url)


def unmarked(source):
    return source.replace("<article>", "<div>").replace("</article>", "</div>")


def test_held_out_pages_without_marks(spark, weights, monkeypatch):
    """Learned from marked pages, right on others whose marks are taken away; constant weights are not."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    want = [X.extract(x, weights) for x in pages]
    assert [X.extract(unmarked(x), weights) for x in pages] == want
    assert not any("\xa9" in x for x in want)
    with monkeypatch.context() as m:
        m.setattr(X, "listed", lambda feature: False)
        own = X.learn([r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])
        assert [X.extract(unmarked(x), own) for x in pages[:300]] == want[:300]
        assert [X.extract(unmarked(x), {"": 1.0}) for x in pages[:300]].count("") == 0
        assert sum(X.extract(unmarked(x), {"": 1.0}) == y for x, y in zip(pages[:300], want)) < 30


@pytest.fixture(scope="module")
def weights(spark):
    return X.learn([r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])


def test_marked_page_without_its_surroundings(weights):
    page = """<html><head><title>x</title></head><body><header><a href=/>Home</a> Site name</header><div id="cookie-notice">We use cookies</div><nav><ul><li>One<li>Two</ul></nav>
    <main><article><header><h1>A &amp; B</h1></header><div class="advert">Buy now</div><p>First para&nbsp;with <b>bold</b> text
    and more.</p><ul><li>item one</li><li>item two</li></ul><form>Email <input><button>Go</button></form><p>Second.</p><script>var x = "<p>no</p>"</script></article></main>
    <section class="comments"><p>Nice post thanks a lot for it</p></section><aside>Related</aside><footer>(c)</footer></body></html>"""
    assert X.extract(page, weights) == "A & B\nFirst para with bold text and more.\nitem one\nitem two\nSecond."


def test_unmarked_page_by_score(weights):
    page = """<body><div id=menu><a>Home</a><a>About</a></div><div class="post"><h2>Title of the post</h2><p>First para with a number of words that is long enough.</p>
    <p>Second &lt;para&gt; here with words in it and more.</p></div><div id="comments"><p>Reader says something quite long here.</p></div><div class=x><a>l1</a> <a>l2</a></div></body>"""
    assert X.extract(page, weights) == "Title of the post\nFirst para with a number of words that is long enough.\nSecond <para> here with words in it and more."


def test_region_is_the_best_run():
    import random

    pick = random.Random(1)
    for _ in range(300):
        xs = [pick.uniform(-2, 1) for _ in range(pick.randint(0, 12))]
        a, b = X.region(xs)
        best = max([0.0, *(sum(xs[i:j]) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1))])
        assert sum(xs[a:b]) == pytest.approx(best)


@pytest.mark.parametrize("page", ["", None, "<", "<a '" * 20_000, "<div>" * 20_000, "<p>" * 20_000 + "a" * 20_000, "<!--", "<![CDATA[" * 5000, "<script>"])
def test_odd_pages_end(weights, page):
    assert isinstance(X.extract(page, weights), str)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>some words here</p>", "t"), (2, None, None, "t"), (1, "u", "<p>some words here</p>", "t")], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in X.extract_main_text(df).collect())
    assert got == [(1, "some words here", 15), (1, "some words here", 15), (2, "", 0)] and X.extract_main_text(df.limit(0)).count() == 0


def test_mark_is_no_rule(weights):
    text = "This is the text of the page and it goes on for a good while with many words in it. " * 4
    side = f"<body><div><article><p>Read this too</p></article></div><div><p>{text}</p><p>{text}</p></div></body>"
    assert text.strip() in X.extract(side, weights)


def test_learned_classes():
    """A class that no list has is cut out once labelled pages have shown it outside only."""
    pages = [f"<body><div class=qzx>Seldom read words {i}</div><article><p>Text of page {i} with some more words</p></article><div class=qzx>tail</div></body>" for i in range(40)]
    own = X.learn(pages)
    assert own[".qzx"] < X.CUT < own["div"] + 1 and own["p"] > 0 and own[""] > 0
    page = "<body><div class=qzx>Many words that are not read by anyone at all</div><div><p>The text</p><p>of it</p></div></body>"
    assert X.extract(page, own) == "The text\nof it"
    assert X.learn([]).keys() == {""}


def test_omitted_end_tags_at_any_depth(weights):
    text = "The text of the page has a number of words in it and is long enough."
    rows = "<tr><td>x<td><p>y" * 200
    assert X.extract(f"<body><aside><table>{rows}</table></aside><article><p>{text}</p></article></body>", weights) == text
    deep = "<article><div>" + "<span>" * 200 + f"<p>{text}</p></article><div><p>Not this one.</p></div>"
    assert X.extract(deep, weights) == text


@pytest.mark.parametrize("raw", ['<svg viewBox="0 0 1 1"/>', "<math/>", "<iframe src='x' />", "<iframe>", "<svg>", "<canvas>", "<object/>" * 3])
def test_raw_elements_without_end(weights, raw):
    text = "The text of the page has a number of words in it and is long enough."
    assert X.extract(f"<article><p>{text}</p>{raw}<p>{text}</p></article>", weights) == f"{text}\n{text}"
    assert X.extract(raw * 20_000, weights) == ""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest

from logyield.llm import html

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style></head><body>
<header class="masthead"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, today.</div>
<div id="cookie-notice"><p>We use cookies to make this long sentence look like text of an article, don't we?</p></div>
<main><article><h1>A &amp; B</h1><p>First   <b>bold</b> text&nbsp;with &lt;tags&gt; and<br>a break.</p>
<div class="advert"><p>A long advert inside of the article that nobody wants to read at all, honestly, not even once.</p></div>
<p>Short.</p><script>var t = "</p><p>no</p>";</script><blockquote>Quoted words.</blockquote>
<ul><li>A point of the article that is long enough.</li></ul>
<section class="comments"><p>First! A reader comment that is quite long and has many words in it, too.</p></section></article></main>
<aside><p>Related things that are long enough to look like a paragraph of text, but are not.</p></aside>
<form><label>Name</label><input value="x"><button>Send</button><select><option>No</option></select></form>
<footer>&copy; someone</footer></body></html>"""
TEXT = "\n".join(
    ["A & B", "First bold text with <tags> and a break.", "Short.", "Quoted words.", "A point of the article that is long enough."]
)


def test_page():
    assert html.main_text(PAGE) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<nav>x</nav>", ""), ("<article><p>a<p>b</article>", "a\nb"),
        ("<article><p><b>one<br><p>two</p></article>", "one\ntwo"), ("<article><p>cut off <b", "cut off"),
        ("<article><p>1 < 2 &amp &am; &#233;</p></article>", "1 < 2 & &am; é"),
        ("<article><p title='a>b'>x</p><!-- <p>y</p> --><style>z", "x"),
        ("<ARTICLE><P CLASS=body>Upper</P></ARTICLE>", "Upper"), ("<article><p>\t \n</p></article>", ""),
        ("<article><header><h1>Head</h1></header><p>Text.</p><footer>by me</footer></article>", "Head\nText."),
        ("<div role=main><p>Text here.</p></div><div role=navigation><p>Menu here.</p></div>", "Text here."),
    ],
)
def test_small_pages(page, text):
    assert html.main_text(page) == text


STORY = "".join(f"<p>Paragraph {i} of the story, long enough to count.</p>" for i in range(4))
LINES = "\n".join(f"Paragraph {i} of the story, long enough to count." for i in range(4))


@pytest.mark.parametrize(
    "wrapped",
    [
        '<html class="has-menu"><body class="home has-sidebar">{}</body></html>', '<div id=page class="comments-open">{}</div>',
        '<div class="read more">{}</div>', '<div class="popular"><section id="search-legal">{}</section></div>',
        '<main><div class="related">{}</div></main>', '<div class="sidebar-left"><main>{}</main></div>',
        '<div class="sidebar-left"><div role="main">{}</div></div>',
    ],
)
@pytest.mark.parametrize("story", ["<article>{}</article>", '<div class="entry">{}</div>'])
def test_words_around_the_article(wrapped, story):
    others = '<nav>Menu</nav><div class="ad">Buy this.</div><section class="comments"><p>A reader comment, with some words in it.</p></section>'
    assert html.main_text(wrapped.format(others + story.format(STORY))) == LINES


def test_words_around_other_articles():
    card = "<article><h3>Another story</h3><p>Some words about another story that is told elsewhere.</p></article>"
    comment = '<article class="comment"><p>A reader comment, with some words in it, and a few more.</p></article>'
    for page in (
        f'<body class="more"><article>{STORY}</article><div class="related">{card}</div>{comment}',
        f'<div class="more"><main>{STORY}<div class="related">{card}</div></main>{comment}</div>',
        f'<div class="more"><article>{STORY}</article><div class="related">{card * 3}</div></div>',
    ):
        assert html.main_text(page) == LINES
    post = '<div class="post comments-open" id="p{}"><article><p>{}</p></article></div>'
    texts = ["A short post of one line, no more.", "A longer post, which has a few words more than the others on this page."]
    assert html.main_text("".join(post.format(i, t) for i, t in enumerate(texts))) == "\n".join(texts)


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>t</title><meta name=x><body>", "<head><title>t</title><link href=x><script>s</script>",
        "<head><style>z</style></html><head>", "<body><select><option>No<option>No", "<body><form><button>No</form>",
        "<body><select><optgroup label=x><option>No</option>", "<body><datalist><option>No", "<body><button>No",
        "<body><object data=x>", "<body><video src=x><source src=y>", "<body><audio src=x>", "<body><canvas id=c>", "<body><map><area>",
        "<body><video>", "<body><object><object><video><canvas><select><option>No",
        "<body><select><option>No</option></select><select><option>No", "<body><object><p><object><p>No</p></object></p>",
    ],
)
def test_silent_elements_without_end_tags(before):
    closed = "<video><p>Not supported by your browser, which is a pity.</p></video><select><option>x<option>y</select>"
    assert html.main_text(f"{before}<article>{STORY}{closed}</article>") == LINES
    assert html.main_text(f"<div>{before}</div><article>{STORY}{closed}</article></body></html>") == LINES


def test_text_ends_the_head():
    assert html.main_text("<head><title>t</title> <meta><b>Bold</b> words, more than enough of them to make up a paragraph of text.") == (
        "Bold words, more than enough of them to make up a paragraph of text."
    )
    assert html.main_text("<head>\n<title>t</title>\n</head><main>x <video><p>no</p></video>y</main>").replace("\n", " ") == "x y"


def test_cut_is_minimal():
    dice = random.Random(2)
    weights = html.Weights(neighbour=3.0, sibling=1.5)
    tags = ["<nav>{}</nav>", "<p>{}</p>", "<div class=ad>{}</div>", "<li><a>{}</a></li>", "<h2>{}</h2>", "<div>{}</div>", "{}<hr>"]
    for _ in range(60):
        page = "".join(dice.choice(tags).format("word " * dice.randint(1, 60)) for _ in range(dice.randint(1, 8)))
        blocks = html.Reader().read(page)
        costs = [round(100 * html.odds(b, weights)) for b in blocks]
        edges, last = [], {}
        for i, block in enumerate(blocks):
            if i:
                edges.append((i - 1, i, round(100 * weights.neighbour / (1 + html.distance(blocks[i - 1].chain, block.chain)))))
            parent = block.chain[-2][0] if len(block.chain) > 1 else 0
            if parent in last:
                edges.append((last[parent], i, round(100 * weights.sibling)))
            last[parent] = i

        def price(labels):
            alone = sum(max(0, c) if not x else max(0, -c) for c, x in zip(costs, labels))
            return alone + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(price(x) for x in itertools.product([False, True], repeat=len(blocks)))
        assert price(html.label(blocks, weights)) == best


def test_long_page():
    body = "".join(f"<p>Paragraph {i} of a very long page.</p><div class=ad>x</div>" for i in range(3000))
    text = html.main_text(f"<nav><a>m</a></nav><article>{body}</article>")
    assert text.split("\n") == [f"Paragraph {i} of a very long page." for i in range(3000)]


def test_tables(spark):
    rows = [(1, "u", PAGE, "clash"), (None, None, None, "clash"), (1, "u", PAGE, "clash")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", TEXT, len(TEXT)), (None, None, "", 0), (1, "u", TEXT, len(TEXT))], key=repr)
    blocks = html.labelled_blocks(pages.limit(1)).collect()
    assert "\n".join(b.text for b in sorted(blocks, key=lambda b: b.block) if b.content) == TEXT
    assert html.extract(pages.limit(0)).collect() == []


WORDS = "Words of a story that go on for a while, until the sentence is over."


@pytest.mark.parametrize(
    "page, text",
    [
        # Parts of a story with words that name boilerplate elsewhere.
        (f'<article>{STORY}<div class="more"><p>{WORDS}</p></div></article>', f"{LINES}\n{WORDS}"),
        (f'<div class="story">{STORY}<p class="legal">{WORDS}</p>{STORY}</div>', f"{LINES}\n{WORDS}\n{LINES}"),
        (f'<article><p class="byline">By a writer, for all readers.</p>{STORY}</article>', f"By a writer, for all readers.\n{LINES}"),
        (f'<article>{STORY}<p class="popular meta">{WORDS}</p></article>', f"{LINES}\n{WORDS}"),
        # The same words on what is no part of it.
        (f'<article>{STORY}<ul class="tags"><li><a>one</a><li><a>two</a></ul></article>', LINES),
        (f'<article>{STORY}</article><div class="more"><a>Another story</a><a>One more</a></div>', LINES),
        (f'<div class="popular"><ul><li><a>Read this</a></ul></div><main>{STORY}</main><div class="legal">All rights reserved.</div>', LINES),
        # Words that name boilerplate and nothing else, between paragraphs.
        (f'<article>{STORY}<p class="ad">{WORDS * 4}</p>{STORY}</article>', f"{LINES}\n{LINES}"),
        (f'<article>{STORY}<div class="cookie notice"><p>{WORDS * 4}</p></div>{STORY}</article>', f"{LINES}\n{LINES}"),
        # A page without any element that says what it is.
        (f"<div><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul></div><div><h1>Title</h1>{STORY}</div>", f"Title\n{LINES}"),
    ],
)
@pytest.mark.parametrize("trained", [False, True])
def test_pages_with_expected_texts(page, text, trained):
    assert html.main_text(page, TRAINED if trained else html.Weights()) == text


def counted(pages):
    counts = np.zeros(html.CELLS, np.int64)
    for page in pages:
        for block in html.Reader().read(page):
            if (at := html.cell(block, html.Weights())) is not None:
                counts[at] += 1
    return counts


TRAINED = html.fitted(counted([PAGE, f"<nav><a>Menu</a></nav><article><h1>Title</h1>{STORY}</article><footer>End</footer>"]))


def test_the_cut_overrules_single_blocks():
    """A block whose own odds say boilerplate stays with the story around it, one whose odds say content goes with the menu."""
    page = f'<div class="story">{STORY}<p class="legal">A short one.</p>{STORY}</div>'
    blocks = html.Reader().read(page)
    assert [round(html.odds(b, html.Weights()), 1) < 0 for b in blocks] == [False] * 4 + [True] + [False] * 4
    assert html.label(blocks) == [True] * 9
    links = "".join("<div><a>Read on about this and that</a></div>" for _ in range(3))
    page = f"<section>{links}<div>A line of more than fifty letters, without a link in it.</div>{links}</section>"
    blocks = html.Reader().read(page)
    assert [html.odds(b, html.Weights()) > 0 for b in blocks] == [False] * 3 + [True] + [False] * 3
    assert html.label(blocks) == [False] * 7


def test_fit(spark):
    prior = html.Weights()
    assert html.fitted(np.zeros(html.CELLS)) == prior
    assert html.fitted(counted([f"<article>{STORY}</article>"])) == prior  # one label only
    pages = [PAGE, None, "", f"<nav><p>{WORDS}</p></nav><article><ul><li>{WORDS}</ul></article>"] * 3
    counts = counted([p or "" for p in pages])
    weights = html.fitted(counts)
    for name in html.FITTED:
        assert abs(getattr(html.fitted(counts * 1000), name) - getattr(weights, name)) < 1e-6
    frame = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(pages)], "page_id long, html string, cell string")
    got = html.fit(frame.repartition(4))
    assert all(abs(getattr(got, n) - getattr(weights, n)) < 1e-9 for n in html.FITTED)
    assert html.fit(frame.limit(0)) == prior

    # Gradient of the penalised loss, over blocks rather than cells: zero at the fit.
    def loss(w):
        total, sums = 0.0, [counts[: html.CELLS // 2].sum(), counts[html.CELLS // 2 :].sum()]
        for page in pages:
            for block in html.Reader().read(page or ""):
                around = html.standing(block)
                if around.worded or not (around.inside or around.named):
                    continue
                x = list(html.features(block, around, prior))
                x[6], x[7] = round(x[6] * html.STEPS) / html.STEPS, round(x[7] / 200 * html.STEPS) / html.STEPS * 200
                z = sum(getattr(w, n) * v for n, v in zip(html.FITTED, x)) * (-1 if around.named else 1)
                total += math.log1p(math.exp(-z)) / sums[not around.named] / 2
        away = [(getattr(w, n) - getattr(prior, n)) * (100 if n == "per_character" else 1) for n in html.FITTED]
        return total + 0.125 * sum(a * a for a in away)

    for name in html.FITTED:
        step = 1e-3 / (100 if name == "per_character" else 1)
        for sign in (-1, 1):
            assert loss(replace(weights, **{name: getattr(weights, name) + sign * step})) > loss(weights)

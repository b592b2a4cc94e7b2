"""Main text: the scan against brute force, labelled and unlabelled layouts, and hostile pages."""

import random
import time
from collections import Counter

import pytest

pytest.importorskip("attesta.llm")
from attesta.llm import html  # noqa: E402

NAV = "<nav><ul><li><a href=/>home page</a></li><li><a href=/b>other pages here</a></li></ul></nav>"
STORY = "<h1>Head  line</h1><p>One <b>two</b>&nbsp;three<br>four and some more words.<p>Five &lt;six&gt; seven eight nine ten.</p>"
TEXT = "Head line\n\nOne two three four and some more words.\n\nFive <six> seven eight nine ten."
LABELLED = [f"<html><head><title>T {k}</title></head><body>{NAV}<div class=ad>buy {k} of these now</div><article>{STORY}</article><footer>&copy; all rights {k} reserved</footer></body></html>" for k in range(20)]


@pytest.fixture(scope="module")
def weights():
    total = Counter()
    for page in LABELLED:
        total.update(html.count_labels(page))
    return html.weights_from(dict(total))


def test_best_run_is_the_best_of_all():
    r = random.Random(5)
    for _ in range(400):
        x = [r.randint(-3, 3) for _ in range(r.randint(0, 9))]
        sums = {(a, b): sum(x[a : b + 1]) for a in range(len(x)) for b in range(a, len(x))}
        best = max(sums.values(), default=0)
        a, b = html.best_run(x)
        assert (a, b) == (0, -1) if best <= 0 else sums[a, b] == best


def test_words_and_tags_are_scored_by_hand(weights):
    w = html.Weights({"p": -0.5, "/p": -0.5}, {".x": -2.0, "p": 1.0, "div": 0.0, ":p": -0.5})
    found = html.tokens("<div class=x>one<p>two three</p></div>four")
    assert html.word_scores(found, w) == ([-2.0, 0.0, -0.5, -0.5, -0.5, -2.0, 1.0], [1.0, 0.0, 1.0, -0.25, 1.0, 1.0, 1.0])


def test_layouts(weights):
    for page in LABELLED:
        assert html.main_text(page, weights) == TEXT
    plain = LABELLED[0].replace("article>", "div>").replace("nav>", "div>").replace("footer>", "div>").replace(" class=ad", "")
    assert html.main_text(plain, weights) == TEXT  # no label, no names
    for extra in ('<div class="ad">Buy this now please</div>', "<aside>On the side</aside>", "<form>Your name <button>send</button></form>", "<script>var a = '</p>';</script>", "<style>p{}</style>", '<div class="cookie-bar notice">We use cookies</div>', "<!-- a > comment -->"):
        assert html.main_text(f"<body>{NAV}<article>{STORY}{extra}<p>Eleven twelve thirteen fourteen fifteen.</p></article></body>", weights) == TEXT + "\n\nEleven twelve thirteen fourteen fifteen."
    comments = '<section class="comments">' + "<p>I disagree with all of that and say so at length.</p>" * 30 + "</section>"
    assert html.main_text(f"<body>{NAV}<article>{STORY}</article>{comments}</body>", weights) == TEXT


def test_loose_names_lose_no_text(weights):
    for attrs in ('class="share-story"', 'class="content has-sidebar"', "class=no-comments", "class='share-enabled ad-free'", 'class="overflow-hidden"', "hidden", "class=sidebar"):
        assert html.main_text(f"<body>{NAV}<div {attrs}><article>{STORY}</article></div></body>", weights) == TEXT, attrs
    assert html.main_text(f'<body>{NAV}<article>{STORY}<p class="related">Eleven twelve.</p></article></body>', weights) == TEXT + "\n\nEleven twelve."
    assert html.main_text(f'<body>{NAV}<article>{STORY}<p>See <a href=/x>this other page</a> too.</p></article></body>', weights) == TEXT + "\n\nSee this other page too."
    more = "<p>The story goes on in another element, with many more words than that.</p>"
    assert html.main_text(f"<body>{NAV}<article>{STORY}</article><article>{more}</article></body>", weights) == TEXT + "\n\nThe story goes on in another element, with many more words than that."
    assert html.main_text(f"<body><main>{STORY}<article><p>A teaser.</p></article>{more}</main></body>", weights).endswith("many more words than that.")


def test_prior_alone_and_odd_pages():
    prior = html.weights_from({})
    assert html.main_text(LABELLED[0], prior) == TEXT
    assert html.main_text("", prior) == "" and html.main_text("<p", prior) in ("", "<p") and html.main_text("just text", prior) == "just text"
    assert html.count_labels("<p>no label</p>") == Counter()
    assert html.main_text('<p title="a > b">one two three</p>', prior) == "one two three"
    assert html.main_text("<p>1 < 2 and 3 > 2</p>", prior) == "1 < 2 and 3 > 2"


def test_hostile_pages_take_linear_time(weights):
    for bad in ("<a " * 500_000, '<a ">" ' * 200_000 + "'", "<script>" * 150_000, "<!--" * 300_000, "<a '>" * 300_000, "<div>" * 100_000 + "x " * 1000 + "</div>" * 100_000, "<" * 1_500_000):
        began = time.process_time()
        html.main_text(bad, weights)
        assert time.process_time() - began < 5


def test_rows(spark):
    rows = [(k, f"u{k}", p, "x") for k, p in enumerate(LABELLED)] + [(100, None, None, None), (101, "v", "", "x"), (0, "u0", LABELLED[0], "x"), (None, "w", LABELLED[1], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or -1, r["url"] or "", r["text"]) for r in html.extract(pages, sample_pages=5).collect())
    assert got == sorted((r[0] or -1, r[1] or "", TEXT if r[2] else "") for r in rows)
    assert html.extract(pages.limit(0)).count() == 0

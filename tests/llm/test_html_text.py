"""Operator 7: main text of hand-made and generated pages."""

import random
import time

from ledgerline.llm import html_text

SENTENCES = "The quick brown fox jumps over the lazy dog near the river bank. " * 3


def page(body, around=""):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{color:red}}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Menu</a><li><a href=/b>Other</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside><p>{SENTENCES}</p></aside>{body}{around}
<div id="comments"><p>Reader: {SENTENCES}</p></div><form><p>Sign up {SENTENCES}</p></form><footer><p>{SENTENCES}</p></footer></body></html>"""


def test_article_without_its_surroundings():
    s = SENTENCES.strip()
    html = page(f"<div class='content'><h1>Head &amp; <i>line</i></h1><p>{s}</p><p>A&nbsp;B &lt;c&gt; &#233;<br>next\n\n  line</p><ul><li>one<li>two</ul><p>{s}</div>")
    assert html_text.main_text(html) == "\n".join(["Head & line", s, "A B <c> é next line", "one", "two", s])


def test_article_element_and_broken_markup():
    s = SENTENCES.strip()
    html = page(f"<article><h1>Title</h1><p><b>{s}<p>{s}</b></p><div class=ad>Buy</div><p>tail</article>")
    assert html_text.main_text(html) == "\n".join(["Title", s, s, "tail"])
    assert html_text.main_text(f"<body><div><p>{s}<p>unclosed <a href='x'>link") == f"{s}\nunclosed link"


def test_generated_pages():
    rng = random.Random(4)
    for _ in range(40):
        blocks = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(12, 60))) for _ in range(rng.randrange(3, 9))]
        body = "<div class=main-text>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div>"
        assert html_text.main_text(page(body)) == "\n".join(blocks)


def test_edge_rows(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "<p>   </p><!-- x", "c"), (4, "u", "plain < text & more", "c"), (4, "u", "plain < text & more", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert out == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "", 0)] + [(4, "u", "plain < text & more", 19)] * 2, key=str)
    assert html_text.extract(df.limit(0)).collect() == []


def test_very_long_and_deep_pages():
    long = "word " * 300_000
    assert html_text.main_text(f"<body><div><p>{long}</p></div></body>") == long.strip()
    assert html_text.main_text("<div>" * 20_000 + "deep text") == "deep text"
    assert html_text.main_text("<a " * 20_000) is not None and html_text.main_text("<a x='" * 20_000) is not None


def test_layout_wrappers_with_class_words():
    """A wrapper named after what stands beside the article keeps the article."""
    s = SENTENCES.strip()
    want = "\n".join(["Title", s, s])
    inner = f"<h1>Title</h1><p>{s}</p><p>{s}</p>"
    side = f"<div class='sidebar'><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><p>About us</p></div><div id=comments><p>Reader: {s}</p></div>"
    for name in ("content-sidebar-wrap", "page navbar-fixed", "search-results-page"):
        assert html_text.main_text(f"<body><div class='{name}'><main><article>{inner}</article></main>{side}</div></body>") == want
        assert html_text.main_text(f"<body><div class='{name}'><article>{inner}</article>{side}</div></body>") == want
    assert html_text.main_text(f"<body><div class='page navbar-fixed'><div class=content>{inner}<p>{s}</p></div>{side}</div></body>") == want + "\n" + s
    assert html_text.main_text(f"<body><main><div class='content-sidebar-wrap'><div>{inner}</div></div>{side}</main></body>") == want


def test_class_names_with_other_words():
    s = SENTENCES.strip()
    body = f"<h1>Title</h1><p class='ad-hoc'>{s}</p><div class='share-price'>The price rose to 12.</div><p>{s}</p><div class='ad-box'>Buy</div><p>before <span class='ad'>x</span>after</p>"
    for around in ("article", "div"):
        got = html_text.main_text(f"<body><{around}>{body}</{around}</body>").split("\n")
        assert [x for x in got if x != "The price rose to 12."] == ["Title", s, s, "before after"]
        assert around == "div" or "The price rose to 12." in got
    links = "<div class='related-xyz'><a href=/a>Another story here</a> <a href=/b>One more story</a></div>"
    assert html_text.main_text(f"<body><article><p>{s}</p>{links}</article></body>") == s
    # teasers in a sidebar are no article of the page, however it is named
    assert html_text.main_text(f"<body><article><p>{s}</p><p>{s}</p></article><div class=sidebar><article><p>{s}</p></article></div></body>") == f"{s}\n{s}"


def test_many_tags_that_close_nothing_cost_no_search():
    s = SENTENCES.strip()

    def seconds(n):
        html = f"<body><div>{'<span>' * n}{'</b>' * n}<p>{s}</p></div></body>"
        started = time.process_time()
        assert html_text.main_text(html) == s
        return time.process_time() - started

    seconds(100)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.01)

from helixframe.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>not this</p> --><div class="ad">Buy now, it is good.</div>
<div class="cookie-notice">We use cookies, you know.</div>
<article><h1>Head &amp; line</h1><p><b>First   part,<br>goes on.<p>Second <i>pa</i>rt&nbsp;here.</p><ul><li>one<li>two</ul>
<section class="comments"><p>Great post, thanks!</p></section><form><button>Send</button></form></article>
<aside>Related, things.</aside><footer>&copy; x, y.</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE).split("\n") == ["Head & line", "First part, goes on.", "Second part here.", "one", "two"]


def test_without_an_article_element():
    text = html_text.main_text(
        "<body><ul class=x><li><a href=1>Home</a><li><a href=2>About us</a></ul><div id=main-text><p>A long sentence, with commas, and more; it goes on.</p>"
        "<p>Another sentence, also with commas, that goes on.</p></div><div class='footer'>Imprint, contact.</div></body>"
    )
    assert text == "A long sentence, with commas, and more; it goes on.\nAnother sentence, also with commas, that goes on."


def test_odd_sources():
    for source in (None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<a title='x>y"):
        assert isinstance(html_text.main_text(source), str)
    assert html_text.main_text("<article><p>cut &am") == "cut &am"
    assert html_text.main_text("plain words, no tags.") == "plain words, no tags."
    assert len(html_text.main_text("<article>" + "<p>word, word.</p>" * 20000 + "</article>").split("\n")) == 20000


def test_frame(spark):
    df = spark.createDataFrame([(1, PAGE, "u"), (2, None, "v"), (2, None, "v")], "page_id long, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "text"] and got.count() == 3
    assert html_text.extract(df.limit(0)).count() == 0


BODY = "First part, goes on.\nSecond part, here it ends."


def paragraphs():
    return "".join(f"<p>{x}</p>" for x in BODY.split("\n"))


def test_wrappers_named_like_marks_keep_the_text():
    foot = "<footer>Imprint, contact.</footer>"
    for page in (
        f'<html class="js-menu login"><body class="no-sidebar">{paragraphs()}{foot}',
        f'<body class="has-banner sidebar"><div class="ad">Buy, now.</div><article>{paragraphs()}</article>{foot}',
        f'<div class="content-with-sidebar">{paragraphs()}<div class="sidebar">Links, more.</div></div>{foot}',
        f'<div class="banner-page">{paragraphs()}<div class="sidebar">Links, more.</div></div>{foot}',
        f'<article class="post tags-x">{paragraphs()}</article>{foot}',
        f'<div class="widget"><main>{paragraphs()}</main></div><p>{"Other words, many of them. " * 9}</p>',
        f'<div class="widget"><article>{paragraphs()}</article></div><div class="cookies">{"Other words, many. " * 2}</div>',
        f'<div title="hidden or not" data-state="hidden" data-role="menu">{paragraphs()}</div>',
    ):
        assert html_text.main_text(page) == BODY, page


def test_marks_still_hold():
    for page in (
        f'<article>{paragraphs()}<section class="comments"><article><p>{"Great post, thanks! " * 5}</p></article></section></article>',
        f'<main>{paragraphs()}</main><div class="related"><article><p>Another, short.</p></article></div>',
        f'<div>{paragraphs()}</div><div class="comments"><p>{"Great, thanks! " * 8}</p></div>',
        f"<div>{paragraphs()}</div><div hidden>Not, this.</div><div class='ad'>Buy, now.</div>",
        f"<div>{paragraphs()}</div><div hidden><article><p>Not, this.</p></article></div>",
    ):
        assert html_text.main_text(page) == BODY, page


def twin(source):
    """Path scores of a well-formed page by the standard parser and whole path strings."""
    import math
    from html.parser import HTMLParser

    found, stack = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append([tag, dict(attrs).get("class", "").split()[:1], 0])

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            text, at = " ".join(data.split()), [x for x in stack if x[0] != "a"]
            if text:
                found.append((["/".join([t] + c) for t, c, _ in at], text, any(x[0] == "a" for x in stack)))

    Reader().feed(source)
    outside = {"nav", "aside", "footer", "form"}

    def bad(path):
        return any(p.split("/")[0] in outside or p.endswith(("/ad", "/comments")) for p in path)

    def fused(blocks):
        if not blocks:
            return 0.0
        chars, marks = sum(len(t) for _, t, _ in blocks), sum(c in ".,;:!?" for _, t, _ in blocks for c in t)
        plain = sum(len(t) for _, t, a in blocks if not a) / chars
        return math.log1p(chars / len(blocks)) * math.log(1.5 + marks / len(blocks)) * plain

    paths = []
    for path, _, _ in found:
        if path not in paths:
            paths.append(path)
    raw = {tuple(p): fused([b for b in found if b[0] == p]) * (0.05 if bad(p) else 1) for p in paths}
    out = {}
    for i, p in enumerate(paths):
        top = bottom = 0.0
        for j, q in enumerate(paths):
            if abs(i - j) <= 2:
                same = next((k for k, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
                w = math.exp(-((i - j) ** 2) / 2) * 0.75 ** (len(p) + len(q) - 2 * same)
                top, bottom = top + w * raw[tuple(q)], bottom + w
        near = [b for b in found if b[0][: len(p) - 1] == p[:-1] and not bad(b[0])]
        around = fused(near) if any(x not in ("html", "body") for x in p[:-1]) else 0.0
        own = [b for b in found if b[0] == p]
        plain = sum(len(t) for _, t, a in own if not a) / sum(len(t) for _, t, _ in own)
        score = (top / bottom + 0.5 * around) * plain
        out[tuple(p)] = score * (0.05 if bad(p) else 1) * (20 if any(x.split("/")[0] in ("article", "main") for x in p) else 1)
    return "\n".join(t for p, t, _ in found if out[tuple(p)] >= 0.2 * max(out.values()) and out[tuple(p)] > 0)


def well_formed(rng, article):
    def text(n):
        return " ".join(rng.choice(["word", "other", "thing", "so"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    body = f"<nav><ul>{''.join(f'<li><a>{text(1)}</a></li>' for _ in range(5))}</ul></nav><div class='ad'><p>{text(9)}</p></div>"
    inner = f"<h1>{text(4)}</h1>"
    for _ in range(rng.randint(1, 6)):
        inner += rng.choice([f"<p>{text(rng.randint(3, 60))}</p>", f"<ul><li>{text(3)}</li><li>{text(12)}</li></ul>", f"<div><h2>{text(3)}</h2><p>{text(30)}</p></div>"])
    tag = "article" if article else "section"
    return f"<html><body>{body}<{tag}>{inner}</{tag}><div class='comments'><p>{text(5)}</p></div><footer>{text(6)}</footer></body></html>"


def test_against_a_plain_version():
    import random

    rng = random.Random(8)
    for k in range(200):
        page = well_formed(rng, k % 2)
        assert html_text.main_text(page) == twin(page), page


def test_scores_decide(monkeypatch):
    page = f"<body><div><p>{'A sentence, and another; it goes on. ' * 8}</p></div><div><a href=x>Menu one two</a></div></body>"
    assert "Menu" not in html_text.main_text(page)
    monkeypatch.setattr(html_text, "path_scores", lambda page, held: {b.path: 1.0 for b in page.blocks})
    assert "Menu" in html_text.main_text(page)


def given_pages(n):
    import pyarrow.parquet as pq

    return [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if x][:n]


def f1(got, want):
    from collections import Counter

    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_given_pages_without_containers_and_names():
    import re

    pages = given_pages(150)
    bare = [re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*')", "", re.sub(r"<(/?)(article|main|nav|footer|aside|header)\b", r"<\1div", p)) for p in pages]
    assert sum(f1(html_text.main_text(b), html_text.main_text(p)) for b, p in zip(bare, pages)) / len(pages) > 0.9


def test_deep_nesting_takes_linear_time():
    for source in ("<div>" * 100_000 + "x, y.", '<div class="ad">x, y.' * 100_000, "<blockquote>x, y.<p>" * 50_000):
        assert "x, y." in html_text.main_text(source)

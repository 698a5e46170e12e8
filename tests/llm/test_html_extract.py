"""Main text of hand-made pages and of generated pages with known articles."""

import random

from pagetrail.llm.html_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site"><a href="/">Site name</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">We use cookies, accept?</div>
<!-- a comment <p>no</p> --><div class="ad">Buy this now</div>{0}<aside class="sidebar"><p>Related reading</p></aside>
<form><label>Mail</label><input value="x"><button>Send</button></form><section id="comments"><article class="comment"><p>First reader says hi</p></article></section>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_article_without_boilerplate():
    body = '<article><header><h1>Head&shy;line &amp; more</h1><p class="by">By A</p></header><p>One\n  <b>two</b>&nbsp;three<br>four.<p>Five &lt;six&gt; &#x41;&eacute;.</p><div class="share">Share it</div><ul><li>i</li><li>ii</ul><script>x</script></article>'
    assert main_text(PAGE.format(body)) == "Head\xadline & more\n\nOne two three four.\n\nFive <six> Aé.\n\ni\n\nii"


def test_pages_without_article_element():
    body = '<div class="content"><h1>Title</h1><p>%s</p><div>Short one.</div><p>%s</p></div>' % ("long text " * 20, "more " * 30)
    assert main_text(PAGE.format(body)) == "Title\n\n" + ("long text " * 20).strip() + "\n\nShort one.\n\n" + ("more " * 30).strip()
    assert main_text(PAGE.format("<main><p>Only <i>this</i>.</p></main>")) == "Only this."
    assert main_text("plain &amp; simple") == "plain & simple"
    assert main_text(PAGE.format("")) == "" and main_text(None) == "" and main_text(" \n") == ""


def test_broken_markup():
    assert main_text('<article><p>a < b & c <a title="x>y" href=q>d</a><p>unclosed <b>bold<div>next') == "a < b & c d\n\nunclosed bold\n\nnext"
    assert main_text("<article><p>x<!-- never closed") == "x"
    assert main_text("<article><h1>H</h1><p><b>Bold.<br><p>Then.</p></article><footer>f") == "H\n\nBold.\n\nThen."
    assert main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a b\n\nc"
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end</article>") == "deep\n\nend"


def test_generated_articles(spark):
    g = random.Random(1)
    rows, want = [], {}
    for i in range(200):
        blocks = [" ".join(g.choice(["wort", "été", "a&b", "<", "x"]) for _ in range(g.randint(1, 60))) for _ in range(g.randint(1, 12))]
        tags = [g.choice(["p", "h2", "li", "blockquote", "pre"]) for _ in blocks]
        inner = "".join("<%s>%s</%s>" % (t, b.replace("&", "&amp;").replace("<", "&lt;"), t) for t, b in zip(tags, blocks))
        rows.append((i, None if i % 7 else "u", PAGE.format(f"<article>{inner}</article>"), "x"))
        want[i] = "\n\n".join(blocks)
    rows += [(None, "u", None, "x"), (500, "u", "", "x"), (3, None, rows[3][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(df).collect()
    assert len(out) == 203 and all(r.text == want.get(r.page_id, "") and r.n_chars == len(r.text) for r in out)
    assert extract(df.limit(0)).count() == 0


LONG = "A sentence of the article that is long enough to be its main text. " * 3


def test_boilerplate_inside_one_container_ends_nothing():
    assert main_text(f"<body><p>{LONG}</p><div class=ad>Buy</div><p>The end.</p></body>") == LONG.strip() + "\n\nThe end."
    assert main_text(f'<div id=c><div><p>{LONG}</p><div class="ad-box">Buy</div>The end.</div></div>') == LONG.strip() + "\n\nThe end."


def test_the_densest_window_decides_which_element_is_the_article():
    page = f'<main><h1>Head</h1><p>{LONG}</p><p>The end.</p><article class="teaser"><p>Read next</p></article></main><p>{LONG * 2}</p>'
    assert main_text(page) == "Head\n\n" + LONG.strip() + "\n\nThe end."
    assert main_text(f"<main><p>Read next</p><article><p>{LONG}</p></article></main>") == LONG.strip()
    assert main_text(f"<article><p>{LONG}</p></article><article><p>{LONG}</p><p>End</p></article>") == "\n\n".join([LONG.strip(), LONG.strip(), "End"])


def test_names_count_as_a_whole():
    kept = '<article><div id="related-work">Earlier papers.</div><div class="notice-of-copyright-law">The law.</div><div class="shared-memory">Memory.</div></article>'
    assert main_text(kept) == "Earlier papers.\n\nThe law.\n\nMemory."
    assert main_text('<article><p>x<div class="related-posts">a</div><div id="cookieNotice">b</div><div class="ad-slot-1">c</div><ul class=comment-list><li>d</ul></article>') == "x"


def test_hostile_pages_take_linear_time():
    import time

    pages = ['<a href="' * 100_000, "<a b=\"><a c='>" * 50_000, "<b><i>" * 50_000 + "</b>" * 50_000, "<div>" * 100_000 + "x" + "</p>" * 1000, "<div><p><b>" * 30_000 + "</i>" * 30_000]
    for page in pages:
        at = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - at < 10
    at = time.perf_counter()
    assert main_text(pages[0]) == "" and main_text("x<p>y" + pages[0]) == "x\n\ny"
    assert time.perf_counter() - at < 1
    assert main_text("<p>&#" + "9" * 10_000 + "; &#x" + "f" * 10_000 + "; &#0000000000065;") == "� � A"
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


def by_surge_and_dive(lines, window=3, share=8, enough=40):
    """The method said plainly: lines are (text, weight), None stands for an empty line."""
    weights = [0 if x is None else x[1] for x in lines]
    sums = [sum(weights[i : i + window]) for i in range(len(lines))]
    out, i = [], 0
    while i < len(lines):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and sums[j]:
            j += 1
        if max(sums[i:j]) >= min(max(sums) / share, enough):
            heavy = [k for k in range(i, j) if weights[k]]
            out += [lines[k][0] for k in range(heavy[0], heavy[-1] + 1) if lines[k] is not None]
        i = j
    return "\n\n".join(out)


def test_pages_without_marked_article_equal_surge_and_dive():
    g, differ = random.Random(5), 0
    for _ in range(500):
        page, lines = [], []
        for box in range(g.randint(1, 6)):
            if box:  # boilerplate between boxes sets them apart
                page.append(g.choice(["<nav><a href=x>menu entry</a></nav>", "<div class='ad'>Buy it</div>", "<aside>Side</aside>", "<form>Send</form>"]))
                lines += [None] * 3
            page.append("<div>")
            for _ in range(g.randint(1, 9)):
                words = " ".join(g.choice(["wort", "été", "ab", "longerword"]) for _ in range(g.choice([1, 1, 2, 5, 30])))
                if g.random() < 0.4:
                    page.append(f"<p><a href='/x'>{words}</a></p>")
                    lines.append((words, 0))
                else:
                    page.append(f"<p>{words}</p>")
                    lines.append((words, len(words)))
                if g.random() < 0.2:
                    page.append("<div class='share'>Share it</div>")  # inside one box: separates nothing
            page.append("</div>")
        got = main_text("<html><body>" + "".join(page) + "</body></html>")
        assert got == by_surge_and_dive(lines)
        differ += got != "\n\n".join(x[0] for x in lines if x)
    assert differ > 400  # the window sums decide

"""Main text of odd markup, and page differencing against a plain version."""

import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import common, html_text  # noqa: E402

KEPT = [
    '<div class="post header-note"><p>kept words</p></div>',
    '<div id="related-work"><p>kept words</p></div>',
    '<p class="side effects">kept words</p>',
    "<p><a title=don't>kept words</a></p>",
    "<p title=a'b class=x>kept words</p>",
    '<p title="a > b">kept words</p>',
    "<p data-x='<b>'>kept words</p>",
    '<div class="entry-header"><h1>kept words</h1></div>',
    "<header><h1>kept words</h1></header>",
]
LOST = ['<div class="ad">lost</div>', '<section id="comments"><p>lost</p></section>', "<aside>lost</aside>", "<form><p>lost</p></form>", "<script>var a = '</p>';</script>", "<div hidden>lost</div>", '<div class="box share">lost</div>']


@pytest.mark.parametrize("block", KEPT)
def test_article_text_stays(block):
    assert html_text.page_lines(f"<html><body><nav>menu</nav><article><p>first</p>{block}<p>last</p></article></body></html>") == (["first", "kept words", "last"], True)


@pytest.mark.parametrize("block", LOST)
def test_other_blocks_go(block):
    assert html_text.page_lines(f"<html><body><article><p>first</p>{block}<p>last</p></article><p>outside</p></body></html>") == (["first", "last"], True)


def test_unclosed_quote_ends_with_the_tag():
    lines, _ = html_text.page_lines('<article><p title="open>one</p><p>two</p></article>')
    assert lines == ["one", "two"]


def page(*lines):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_differencing(spark):
    common.prepare(spark)
    top, end = ["site name", "menu"], ["imprint"]
    rows = [
        (1, "http://a.example/x/1", page(*top, "one", "uno", *end)),
        (2, "http://a.example/x/1?ref=b", page(*top, "one", "uno", *end)),  # another address of the same text
        (3, "http://a.example/x/2", page(*top, "two", "dos", *end)),
        (4, "http://b.example/x/2", page(*top, "two", "dos", *end)),  # alone on its host
        (5, None, page("no address")),
        (6, "http://a.example/x/3", None),
        (7, "http://a.example/x/2", page(*top, "two", "dos", *end)),  # a row that repeats
        (7, "http://a.example/x/2", page(*top, "two", "dos", *end)),
        (8, "http://c.example/", "<article>" + "<p>word</p>" * 5000 + "</article>"),
    ]
    got = html_text.main_text(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, `lines` string, Html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "one\nuno"), (2, "one\nuno"), (3, "two\ndos"), (4, "site name\nmenu\ntwo\ndos\nimprint"), (5, "no address"), (6, ""), (7, "two\ndos"), (7, "two\ndos"), (8, "\n".join(["word"] * 5000))]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_by_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        at = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(at) == longest(a, b) and at == sorted(at) and all(a[i] in rest for i in at)


def test_teasers_and_open_menus():
    page = "<title>t</title><div id=content><h1>Title</h1><p>The whole body of the text stands here, outside.</p></div><article>Teaser card</article>"
    assert html_text.page_lines(page) == (["Title", "The whole body of the text stands here, outside.", "Teaser card"], False)
    assert html_text.page_lines("<nav><p>menu<article><p>text</p></article>") == (["text"], True)
    assert html_text.page_lines("<aside><article>teaser</article></aside><main><p>text</p></main><nav>x</nav>") == (["text"], True)
    assert html_text.page_lines("<menu><li>a<main>text</main><menu>b</menu>") == (["text"], True)


def test_differencing_decides_on_a_short_article(spark):
    """A menu that holds more than the article is known by the page beside it, though one line of it is made anew; so is an article that two pages print."""
    menu = "".join(f"<p>entry {i} of a long menu that stands on all pages</p>" for i in range(9))
    rows = [(i, f"http://a.example/{i}", f"<body><div>{menu}<p>seen {i}</p></div><article><p>short text {i}</p><p>more of it {i}</p><p>still {i}</p><p>and its end</p></article></body>") for i in range(4)]
    rows += [(9 + i, f"http://b.example/{i}", f"<body><p>unlike {i} * {i}</p><main><p>a text that is printed twice</p><p>its own line {i}</p></main><p>{'-' * 20} {i}</p></body>") for i in range(2)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"short text {i}\nmore of it {i}\nstill {i}\nand its end" for i in range(4)} | {9 + i: f"a text that is printed twice\nits own line {i}" for i in range(2)}


def test_all_pages_against_a_plain_version(spark, monkeypatch):
    """Pages with and without an article, in blocks of any length; those that repeat are beside themselves."""
    import random

    rng, word = random.Random(8), lambda: rng.choice(("site", "menu", "news", "about", "imprint", "a longer line of words", "end"))
    lines = lambda n: "".join(f"<p>{word()}</p>" for _ in range(rng.randint(0, n)))
    rows = [(i, f"http://{rng.choice('ab')}.example/{rng.randint(0, 3)}/{i % 40}", f"<body>{lines(8)}" + (f"<article>{lines(5)}</article>" if i % 3 else "") + f"{lines(3)}</body>") for i in range(90)]
    order, want = sorted(rows, key=lambda r: (r[1][7:16], r[1][16:], r[0])), {}
    parsed = []
    for _, url, body in order:
        blocks = html_text.page_blocks(body)
        parsed.append((url[7:16], url[16:], [line for _, line in blocks], [x for x, _ in blocks]))
    for at, (host, path, own, main) in enumerate(parsed):
        near = [{"step": k, "path": parsed[at + k][1], "hashes": parsed[at + k][2]} for k in range(-3, 4) if k and 0 <= at + k < len(parsed) and parsed[at + k][0] == host]
        want[order[at][0]] = "\n".join(own[i] for i in html_text.kept_lines(path, own, main, [len(x) for x in own], near))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for length in (4, 1024):
        monkeypatch.setattr(html_text, "BLOCK", length)
        assert {r.page_id: r.text for r in html_text.main_text(table).collect()} == want

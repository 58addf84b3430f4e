import random
import time

import pytest

from facetry.llm.html_extract import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">Buy now, it is cheap.</div><article><h1>Title &amp; more</h1><p><b>First, with   blanks.<br><p>Second &eacute; one, which is longer.</p>
<p>Short.</p><aside>Aside, with much text in it, and more.</aside><div class="comments"><p>A reader says, well, something.</p></div></article>
<form><p>Mail, please.</p></form><footer>&copy; x</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\nFirst, with blanks.\nSecond é one, which is longer.\nShort."


def test_page_without_semantic_elements():
    page = "<html><body><div id='menu'><a href=x>One</a> <a href=y>Two</a></div><div class='content'><h2>Head</h2><div class='text'><p>A sentence, long enough.</p><p>Another sentence, also long.</p></div></div><div class='sidebar'><p>Look, here.</p></div><div class='cookie-notice'>We use cookies, accept, please.</div></body></html>"
    assert main_text(page) == "Head\nA sentence, long enough.\nAnother sentence, also long."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>cut <b", "cut"), ("plain, no tags", "plain, no tags"), ("<article><p>a &lt;b&gt;</article>", "a <b>"), ("<script>x", ""), ("<article>one<br>two</article>", "one two"), ("<!-- <p>no</p> --><main><p>yes, it is.</p></main>", "yes, it is.")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages():
    assert main_text("<article>" + "<p>word, word.</p>" * 20000 + "</article>").count("\n") == 19999
    assert main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, n_chars long")
    rows = extract_pages(pages).orderBy("page_id").collect()
    assert [r["n_chars"] for r in rows] == [len(main_text(PAGE))] * 2 + [0]
    assert extract_pages(pages.limit(0)).count() == 0


LONG = "A sentence, long enough, and more of it. " * 8


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div><h1>T</h1><p>{LONG[:164]}</p><section><h2>Head</h2><p>{LONG}</p></section></div>", f"T\n{LONG[:164].strip()}\nHead\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p><ul><li>{LONG * 2}</li></ul></div>", f"{LONG.strip()}\n{(LONG * 2).strip()}"),
        (f"<div class='content has-sidebar'><p>{LONG}</p><div class='sidebar'><p>Look, here.</p></div></div>", LONG.strip()),
        (f"<div class='content has-sidebar'><p>{LONG}</p></div><p>All rights.</p>", LONG.strip()),
    ],
)
def test_selected_text_stays(page, text):
    assert main_text(page) == text


NAMED = [
    (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG.strip()),
    (f"<article class='comments sidebar' id='ad'><p>{LONG}</p></article><p>Footer words.</p>", LONG.strip()),
    (f"<body><form action='x.aspx'><div class='menu'><a href=x>One</a></div><div><h1>T</h1><p>{LONG}</p></div><input></form></body>", f"T\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><form><p>Your mail, please.</p></form></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><p class='notice-period'>Three months, at least.</p></article>", f"{LONG.strip()}\nThree months, at least."),
    (f"<article><p>{LONG}</p><div class='cookie-notice-box'>We use cookies.</div></article>", LONG.strip()),
    (f"<div class='text'><p>{LONG}</p><p><a href=x>This sentence is a link, mostly</a>, but not all.</p><p>{LONG}</p><ul><li>One, here.</li><li>Two, there.</li></ul></div>", f"{LONG.strip()}\nThis sentence is a link, mostly, but not all.\n{LONG.strip()}\nOne, here.\nTwo, there."),
    (f"<div class='text'><p>{LONG}</p><ul><li><a href=x>Next page</a></li><li><a href=y>Last page</a></li></ul></div>", LONG.strip()),
]


@pytest.mark.parametrize("page,text", NAMED)
def test_names_and_forms_are_weighed(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("piece", ["<div>text, here. ", "<a ", '<a "', "<ul><li>x ", "</script", "<a '>'", "<form>x ", "<table><tr><td>x, y. ", "<b></i>"])
def test_time_grows_with_the_length(piece):
    """Ten thousand unclosed elements of any kind take a moment, and twice as many no more
    than some times that."""
    began = time.perf_counter()
    main_text(piece * 10_000)
    assert time.perf_counter() - began < 10
    if piece.startswith("<div"):
        assert main_text(piece * 10_000) == "\n".join(["text, here."] * 10_000)


def _tree(draw, words):
    """A page as a tree of ``(name, attributes, children or text)`` and its main text, told
    by a walk over the tree."""
    sentence = lambda n: " ".join(draw.choice(words) for _ in range(n)).capitalize() + ", and so on."
    article = [("h1", "", sentence(4))]
    for _ in range(draw.randint(2, 6)):
        article.append(draw.choice([("p", "", sentence(draw.randint(12, 60))), ("blockquote", "", [("p", "", sentence(20))]), ("p", "", sentence(30))]))
    inner = [("div", "class='ad'", sentence(8)), ("aside", "", sentence(10)), ("script", "", "if (a < b) { x('</p>') }"), ("form", "", [("p", "", sentence(3))]), ("section", "id='comments'", [("p", "", sentence(15))])]
    body = list(article)
    for extra in inner:
        if draw.random() < 0.5:
            body.insert(draw.randint(1, len(body)), extra)
    name, attributes = draw.choice([("article", "class='post no-sidebar'"), ("main", ""), ("div", "class='content with-comments'")])
    menu = ("ul", "", [("li", "", [("a", "href=x", draw.choice(words))]) for _ in range(6)])
    around = [("nav", "", [menu]), ("header", "", sentence(5)), (name, attributes, body), ("div", "class='sidebar-left'", [("p", "", sentence(9))]), ("footer", "", sentence(12))]
    tree = ("body", "", [("form", "id=aspnet", around)] if draw.random() < 0.3 else around)

    def read(node):
        if node in article:
            return [x[2] for x in node[2]] if isinstance(node[2], list) else [node[2]]
        return [x for child in node[2] for x in read(child)] if isinstance(node[2], list) else []

    return tree, "\n".join(read(tree))


def _markup(node, draw):
    name, attributes, inside = node
    inner = inside if isinstance(inside, str) else "".join(_markup(x, draw) for x in inside)
    if isinstance(inside, str) and name != "script":
        inner = inner.replace(" and ", draw.choice([" and ", "  and\n", " <b>and</b> ", " &#97;nd "]))
    close = "" if name in ("p", "li") and draw.random() < 0.5 else f"</{name}>"
    return f"<{name} {attributes}>{inner}{close}{draw.choice(['', chr(10), '<!-- x -->'])}"


def test_pages_by_a_tree_reading(words):
    draw = random.Random(17)
    for _ in range(300):
        tree, text = _tree(draw, words)
        assert main_text(_markup(tree, draw)) == text

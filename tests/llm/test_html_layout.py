import html
import random
import re
import time

import pytest

from tallywire.llm.html_layout import page_texts, render

CASES = {
    "": "",
    "plain  text": "plain text",
    "a<br>b<br/>c": "a\nb\nc",
    "a<br><br>b": "a\n\nb",
    "<p>one<p>two</p>three": "one\n\ntwo\n\nthree",
    "<div>one</div><div>two</div>three": "one\ntwo\nthree",
    "<b>a</b><i>b</i> c <u> d</u>": "ab c d",
    "<h1>T</h1>x": "T\n\nx",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>a</li><li>b<p>more</p></li></ol>": "9. a\n10. b\n\n    more",
    "<dl><dt>t<dd>d</dl>": "t\n    d",
    "<pre> a\n  b\n\nc </pre>": " a\n  b\n\nc",
    "x &lt;p&gt; &amp; &eacute;": "x <p> & é",
    "<script>'</p>'</script><style>p{}</style>x<!-- no -->y": "xy",
    "<p hidden>a</p><div style='DISPLAY : none'>b</div><i style=visibility:hidden>c</i>d": "d",
    "<head><title>no</title></head><body>yes": "yes",
    "5 < 6 and <3": "5 < 6 and <3",
    "</p></div>stray</b>": "stray",
    "<select><option>a<option selected>b</select>": "b",
    "<textarea> a\n b</textarea>": " a\n b",
    "<blockquote>a<br>b</blockquote>c": "  a\n  b\n\nc",
    "<input value=no><img alt=no>x": "x",
    "a<p>b</div>c": "a\n\nbc",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<template>no</template><noscript>no</noscript>x": "x",
    "<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>": "a   bbb\ncc  d",
    "<table><caption>C<tr><th>x<th>y<tbody><tr><td colspan=2>wide one<tr><td>p<td>q</table>z": (
        "C\nx  y\nwide one\np  q\n\nz"
    ),
    "<table><tr><td>a<br>b<td>1</table>": "a  1\nb",
    "<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>": "a        b\n\nin  ner",
    "<table><td>no row</table>": "no row",
    "<table><tr><td>日本<td>x<tr><td>a<td>y</table>": "日本  x\na     y",
    "<!DOCTYPE html><html><body><p>x</body></html>": "x",
    "<a href='x>y'>t</a>": "t",
    "<p>unclosed <b>bold": "unclosed bold",
}


MALFORMED = {
    "<p title=don't>One</p><p title=can't>Two</p>": "One\n\nTwo",
    """<a href="x"">link</a> visible <a href="y"">two</a>""": "link visible two",
    """<a href="x"y"z>link</a> <b '>it's</b>""": "link it's",
    "<a href = 'x>y' title=a'b\">t</a> 'u'": "t 'u'",
    """<a href="x>never closed</a> more""": "never closed more",
    "<p =x='>a</p>b": "a\n\nb",
    "<a href=>x</a><i class= hidden>y</i>": "xy",
    "<i\nclass='a'hidden>no</i><br/>yes": "yes",
}


@pytest.mark.parametrize("page", MALFORMED)
def test_stray_quotes_hide_no_text(page):
    assert render(page) == MALFORMED[page]


SPANS = {
    "<tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e": "a  b\n   c\nd  e",
    "<tr><td>a<td rowspan=2>bb<td>c<tr><td>d<td>e": "a  bb  c\nd      e",
    "<tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>x<td>y<td>z": "a     b\n      c\nx  y  z",
    "<tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e": "a  b\n   c\nd  e",
    "<thead><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d": "a  b\nc  d",
    "<tr><td rowspan=3>a<td>b<tr><td><tr><td>c": "a  b\n   c",
    "<tr><td rowspan=x>a<td>b<tr><td>c": "a  b\nc",
}


@pytest.mark.parametrize("rows", SPANS)
def test_cells_over_several_rows(rows):
    assert render(f"<table>{rows}</table>") == SPANS[rows]


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert render(page) == CASES[page]


VISIBILITY = {
    "<details>no<summary>S</summary>no<p>no</details>z": "S\nz",
    "<details open><summary>S</summary>yes</details>": "S\nyes",
    "<details>no</details>z": "z",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>": "yes",
    "<div style='display:none'>no<b style='display:block;visibility:visible'>no</b></div>z": "z",
    "<style>.a{display:none}</style><p class='b a'>no</p><p class=b>yes": "yes",
    "<style>/* p{display:none} */ #x, i.n {color:red;DISPLAY : none}</style><b id=x>no</b><i class=n>no</i><b class=n>yes": "yes",
    "<style>@media print{p{display:none}} @import 'x'; .h{visibility:hidden}</style><p>yes<b class=h>no</b>": "yes",
    "<style>.a .b{display:none} .b:hover{display:none}</style><p class=b>yes": "yes",
    "<style>.a{display:none}.b{display:block}</style><p class='a b'>yes<p class=a>no": "yes",
    "<style>p{display:none}.b{display:block}</style><p class=b>yes<p>no": "yes",
    "<style>.a{display:none!important}</style><p class=a style='display:block'>no</p>z": "z",
    "<style>.a{display:none}</style><p class=a style='display:block'>yes": "yes",
    "<p style='x-display:none'>yes<p hidden style='display:block'>yes": "yes\n\nyes",
    "<p style='display:none;display:block'>yes": "yes",
    "<style>p{display:none": "",
    "<ol><li>a<li value=7>b<li>c<li value=x>d</ol>": "1. a\n7. b\n8. c\n9. d",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<ol reversed start=5><li>a<li>b</ol>": "5. a\n4. b",
    "<ol><li style='visibility:hidden'>no<li>b</ol>": "2. b",
    "a</p>b": "a\n\nb",
}


@pytest.mark.parametrize("page", VISIBILITY)
def test_what_is_hidden_and_numbered(page):
    assert render(page) == VISIBILITY[page]


def test_words_of_random_trees_by_plain_inheritance():
    """Random trees with every way of hiding, against a walk that knows how each was made."""
    rng = random.Random(2)
    sheet = "<style>.n{display:none} .h{visibility:hidden} .v{visibility:visible}</style>"
    # Attributes; whether the element has a place; what it makes of the visibility it inherits.
    ways = [
        ("", True, None), (" class=x", True, None), (" hidden", False, None),
        (" class='x n'", False, None), (" class=h", True, False), (" class='v x'", True, True),
        (" style='visibility : hidden'", True, False), (" style=visibility:visible", True, True),
        (" class=h style=visibility:visible", True, True), (" class=n style=display:block", True, None),
    ]
    count = iter(range(10**9))

    def grow(depth, placed, visible):
        out, words = [], []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                word = f"w{next(count)}"
                out.append(f" {word} ")
                words += [word] if placed and visible else []
            else:
                more, here, turned = rng.choice(ways)
                inner, kept = grow(depth - 1, placed and here, visible if turned is None else turned)
                tag = rng.choice(["div", "span", "section", "b"])
                out.append(f"<{tag}{more}>{inner}</{tag}>")
                words += kept
        return "".join(out), words

    for _ in range(200):
        body, want = grow(6, True, True)
        assert re.findall(r"w\d+", render(sheet + body)) == want


@pytest.mark.parametrize("part", ["<div>", "<p><b>", "<li>", "<blockquote>", "</i><section>x", "<a b='c' ", "<dd>x "])
def test_time_grows_with_the_page(part):
    begun = time.process_time()
    assert render(part * 100_000 + "<div>end").endswith("end")
    assert time.process_time() - begun < 8


def test_every_visible_word_stays():
    """Random pages: the words shown are those outside hidden parts, in order."""
    rng = random.Random(1)
    for _ in range(300):
        parts, want, open_ = [], [], []
        for k in range(rng.randint(1, 60)):
            step = rng.random()
            if step < 0.4:
                word = f"w{k}é"
                parts.append(rng.choice([" ", "\n", ""]).join([" ", html.escape(word), " "]))
                if not any(open_):
                    want.append(word)
            elif step < 0.7:
                hide = rng.random() < 0.15
                open_.append(hide)
                parts.append(f"<div{' hidden' if hide else rng.choice(['', ' class=a'])}>")
            elif open_:
                open_.pop()
                parts.append("</div>")
        assert re.findall(r"w\d+é", render("".join(parts))) == want


def test_deep_and_long_pages():
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<table><tr><td>" * 300 + "x") == "x"
    assert render("<ul><li>" * 200 + "x").strip().endswith("x")
    assert len(render("<p>" + "word " * 300_000)) == 5 * 300_000 - 1
    assert render("<" * 20_000) == "<" * 20_000
    render("<a " * 20_000)


def test_pages(spark):
    rows = [(1, "<p>a", "x"), (2, None, "x"), (None, "", "x"), (1, "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(page_texts(pages).collect(), key=repr)
    assert [(r.page_id, r.text) for r in got] == [(1, "a"), (1, "a"), (2, ""), (None, "")]
    assert page_texts(pages.limit(0)).count() == 0

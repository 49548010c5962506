import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_text
from corpusloom.llm.catalog import QUERIES

CASES = {
    "": "",
    "plain": "plain",
    "<p>a<p>b<br>c": "a\n\nb\nc",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>x": "- one\n- two\n  - in\n- three\n\nx",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<li><p>first</p><p>second</p></li>": "- first\n\n  second",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>after": "a     bbb\ncccc  d\n\nafter",
    "<table><tr><td colspan=2>wide cell<td>z<tr><td>1<td>22<td>3</table>": "wide cell  z\n1  22      3",
    "<table><tr><td>中文<td>x<tr><td>abc<td>y</table>": "中文  x\nabc   y",
    "<table><tr><td>one<br>two<td>x<tr><td><table><tr><td>in<td>ner</table><td>y</table>": "one      x\ntwo\nin  ner  y",
    "<td>no table": "no table",
    "a < b & c &amp; d &#228;&nbsp;x": "a < b & c & d ä\xa0x",
    "<head><title>t</title><style>p{}</style></head><body>seen": "seen",
    "<title>t</title>late <meta charset=x><script>if(a<b)'</p>'</script>text": "late text",
    "<div style='color:red; display : none'>no<p>no</div>yes<span hidden>no</span>!": "yes!",
    "<div style=visibility:hidden>no</div><input type=hidden value=no><input value=yes>": "yes",
    "<details><summary>s</summary>no<p>no</details>t": "s\nt",
    "<details open><summary>s</summary>yes</details>": "s\nyes",
    "<pre>  a\n   b</pre>c": "  a\n   b\n\nc",
    "x<pre>\n\ty</pre>": "x\n\n\ty",
    "<dl><dt>T<dd>D<dd>E</dl>": "T\n  D\n  E",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<b>x</b><i>y</i>\n z<div>w</div>": "xy z\nw",
    "a<!-- x > y --!>b<!doctype html>c<![CDATA[d]]>": "abcd",
    "<p>open <b>bold": "open bold",
    "</p>stray</div> ends": "stray ends",
    "<a href='>'>quote</a> <img alt=pic>": "quote pic",
    "<select><option>a<option>b</select>": "a\nb",
    "cut <a href=": "cut",
    "<textarea> k <b> </textarea>": " k <b>",
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_layout(page):
    assert html_text.visible_text(page) == CASES[page]


STRAY_QUOTES = {
    '<p><a href="x"">first</a> second <b class="y">third</b> <i id="k">fourth</i> fifth</p> sixth': "first second third fourth fifth\n\nsixth",
    '<p "><b>first</b> second</p><p>third</p>': "first second\n\nthird",
    "<a title=don't href=x>first</a> second <i>it's end</i>": "first second it's end",
    "<a href='x''>one</a> two's": "one two's",
    "<a href=x\">one</a> two": "one two",
    '<p a"b=c>one</p>"two"': 'one\n\n"two"',
    '<p =">one</p>two': "one\n\ntwo",
    '<p a= "x > y" b>one</p>': "one",
    "<p a=>one</p>'two'": "one\n\n'two'",
    '<a title="a"hidden>no</a>yes': "yes",
    "<img alt=it's/>'s": "it's/'s",
    '<b/"/>one</b> "two"': 'one "two"',
}


@pytest.mark.parametrize("page", STRAY_QUOTES, ids=range(len(STRAY_QUOTES)))
def test_stray_quotes_swallow_no_text(page):
    assert html_text.visible_text(page) == STRAY_QUOTES[page]


def test_many_quotes_take_time_in_proportion():
    assert html_text.visible_text("<p " + "\" ' = a= " * 100_000 + ">text") == "text"


def test_deep_long_and_broken_pages():
    assert html_text.visible_text("<div>" * 100_000 + "deep") == "deep"
    assert html_text.visible_text("<p>x" * 20_000).count("x") == 20_000
    assert html_text.visible_text("<" * 10_000) == "<" * 10_000
    assert html_text.visible_text("</b>" * 50_000 + "<i>" * 50_000 + "t") == "t"


def test_columns_and_nulls(spark):
    rows = [(1, None, "old"), (2, "", "old"), (3, "<p>a<p>b", "old"), (3, "<p>a<p>b", "old")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("n_lines", F.lit("old"))
    got = sorted((r.page_id, r.text, r.n_lines) for r in html_text.extract(df).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "a\n\nb", 3), (3, "a\n\nb", 3)]
    assert html_text.extract(df.limit(0)).count() == 0
    renamed = df.drop("text").withColumnRenamed("html", "text")
    assert sorted(r.text for r in html_text.extract(renamed, "text").collect()) == ["", "", "a\n\nb", "a\n\nb"]


def test_query(spark, sf_dir):
    rows = QUERIES["op2_html_layout"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert "<p>" not in r.text and "p{margin" not in r.text and r.text


def test_numbers_of_list_items():
    text = html_text.visible_text
    assert text("<ol start=3><li>a<li value=9>b<li>c</ol>") == "3. a\n9. b\n10. c"
    assert text("<ol reversed><li>a<li>b<li value=x>c</ol>") == "3. a\n2. b\n1. c"
    assert text("<ol reversed start=1><li>a<li>b</ol><ul><li value=4>c</ul>") == "1. a\n0. b\n\n- c"


SPANS = {
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>aa<td rowspan=2>b<td>c<tr><td>d<td>e</table>": "aa  b  c\nd      e",
    "<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td>d<tr><td>x<td>y<td>z</table>": "a     b\n      c\n      d\nx  y  z",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>": "a  b\n   c\n   d",
    "<table><thead><tr><th rowspan=9>h<th>i</thead><tbody><tr><td>1<td>2</table>": "h  i\n1  2",
    "<table><tr><td rowspan=2>a<td>b<tr></tr><tr><td>c</table>": "a  b\nc",
    "<table><tr><td colspan=1000>a<td>b<tr><td>c</table>": "a    b\nc",  # a column for c, one for the rest of the span
    "<table><tr><td rowspan=x>a<td colspan=-1>b<tr><td>c</table>": "a  b\nc",
    "<table><tr><td>a<br>b<td rowspan=2>x<br>y<br>z<tr><td>c</table>": "a  x\nb  y\n   z\nc",
    "<table></table>after": "after",
}


@pytest.mark.parametrize("page", SPANS, ids=range(len(SPANS)))
def test_spans_keep_columns_aligned(page):
    assert html_text.visible_text(page) == SPANS[page]


VISIBILITY = {
    "<p style=visibility:hidden>no <b style='visibility: visible'>yes</b> no</p>end": "yes\n\nend",
    "<p style='visibility:hidden;display:none'><b style=visibility:visible>no</b></p>end": "end",
    "<i style='backface-visibility:hidden'>yes</i><i style='visibility:hidden;visibility:visible'>!</i>": "yes!",
    "<ol><li>a<li style=visibility:hidden>no<br>no<img alt=no><li>c</ol>": "1. a\n3. c",
    "<table><tr><td>a<td style=visibility:hidden>no<td>b<tr style=visibility:collapse><td>no<tr><td>c<td>dd<td>e</table>": "a      b\nc  dd  e",
    "<table style=visibility:hidden><tr><td>no<td style=visibility:visible>yes<tr><td>no</table>": "  yes",
    "<pre style=visibility:hidden>no\nno</pre>end": "end",
}


@pytest.mark.parametrize("page", VISIBILITY, ids=range(len(VISIBILITY)))
def test_visibility_is_handed_down(page):
    assert html_text.visible_text(page) == VISIBILITY[page]


def grid_lines(rows):
    """Plain layout of one-line cells (text, wide, high): a slot for every row and column, then columns
    that no cell begins or ends at taken out and widths from cells of one column."""
    slots, cells, edges = set(), [], {0}
    for y, row in enumerate(rows):
        x = 0
        for text, wide, high in row:
            while (y, x) in slots:
                x += 1
            slots |= {(y + b, x + a) for a in range(wide) for b in range(high or len(rows) - y)}
            cells.append((y, x, x + wide, text))
            edges |= {x, x + wide}
            x += wide
    at = {c: i for i, c in enumerate(sorted(edges))}
    cells = [(y, at[a], at[b], text) for y, a, b, text in cells]
    width = [max([len(t) for _, a, b, t in cells if (a, b) == (i, i + 1)], default=0) for i in range(len(edges) - 1)]
    for _, a, b, text in cells:
        width[b - 1] += max(0, len(text) - sum(width[a:b]) - 2 * (b - a - 1)) if b > a + 1 else 0
    lines = [[" "] * (sum(width) + 2 * len(width)) for _ in rows]
    for y, a, _, text in cells:
        begin = sum(width[:a]) + 2 * a
        lines[y][begin : begin + len(text)] = text
    return ["".join(line).rstrip() for line, row in zip(lines, rows) if row]


def overlaps(rows):
    """Whether cells of a table lie upon each other (an error of the page)."""
    slots = set()
    for y, row in enumerate(rows):
        x = 0
        for _, wide, high in row:
            while (y, x) in slots:
                x += 1
            own = {(y + b, x + a) for a in range(wide) for b in range(high or len(rows) - y)}
            if own & slots:
                return True
            slots |= own
            x += wide
    return False


def test_tables_against_a_grid_of_slots():
    rnd, tried = random.Random(11), 0
    for _ in range(400):
        rows = [
            [("x" * rnd.randrange(1, 9), rnd.choice([1, 1, 1, 2, 3]), rnd.choice([1, 1, 1, 2, 3, 0])) for _ in range(rnd.randrange(5))]
            for _ in range(rnd.randrange(1, 6))
        ]
        if not overlaps(rows):
            page = "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in row) for row in rows)
            tried += any(rows)
            assert html_text._table(rows) == grid_lines(rows)
            want = "\n".join(grid_lines(rows)).strip("\n")
            assert html_text.visible_text(f"<table>{page}</table>") == want
    assert tried > 100


def test_wide_spans_cost_no_more_than_their_cells():
    page = "<table><tr>" + "<td colspan=1000>a" * 20_000 + "</table>"
    assert html_text.visible_text(page) == "  ".join("a" * 20_000)

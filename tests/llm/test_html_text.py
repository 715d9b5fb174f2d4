import html.parser
import random
import time

from colweave.llm.html_text import Tags, extract, render


def test_layout():
    assert render("<p>One<p>Two <b>bold</b>text  here<br>next") == "One\n\nTwo boldtext here\nnext"
    assert render("<div>a</div><div>b</div>c") == "a\nb\nc"
    assert render("<ul><li>x<li>y<ol start=3><li>i<li>j</ol></ul>") == "- x\n- y\n 3. i\n 4. j"
    assert render("<h1>T</h1>x &amp; y&nbsp;z") == "T\n\nx & y z"
    assert render("<pre>a\n  b\n\nc</pre>d") == "a\n  b\n\nc\n\nd"
    assert render("<dl><dt>k<dd>v<dt>l<dd>w</dl>") == "k\n  v\nl\n  w"


def test_tables_are_aligned():
    page = "<table><caption>Cap</caption><tr><th>name<th>n<tr><td>longer name<td>1</tr><td>x<td>22</table>after"
    assert render(page) == "Cap\nname         n\nlonger name  1\nx            22\n\nafter"
    assert render("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>") == "wide  c\na  b  d"
    assert render("<table><tr><td>o<table><tr><td>in</table><td>p</table>") == "o   p\nin"


def test_what_is_hidden():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><script>var t="</p>";</script>
    <p hidden>h</p><p style="color:red; display : none">d</p><div class="hidden">seen</div><template>t</template><noscript>n</noscript>
    <!-- c --><p title="a > b">quoted</p><input value=x></body></html>"""
    assert render(page) == "seen\n\nquoted"


def test_comments_end_as_they_do_in_browsers():
    for page, want in {"a<!-->b<p>c": "ab\n\nc", "a<!--->b": "ab", "a<!-- x --!>b": "ab", "a<!---->b": "ab", "a<!-- > -- ->x-->b": "ab", "a<!-- <!-- x -->b": "ab", "a<!-- open <p>b": "a", "a</>b</ c>d": "abd", "a<!doctype x>b<?php y?>c": "abc", "a<!-- x --!": "a", "a <!b": "a <!b"}.items():
        assert render(page) == want, page


def test_buttons_and_ruby():
    assert render("<ruby>k<rp>(</rp><rt>a</rt><rp>)</rp></ruby><ruby>k<rp>(<rt>a<rp>)</ruby>") == "kaka"
    assert render("<input type=submit value='Go &amp; see'><input value=no><input type=RESET value=x hidden><input type=button>") == "Go & see"


def plain_tags(page):
    """Comments and tags by the letter of Tags' docstring, a character at a time, without anything remembered."""
    out, at = [], 0
    while at < len(page):
        if page[at] != "<":
            at += 1
            continue
        rest = page[at:]
        if rest.startswith("<!--"):
            ends = [at + 5] if rest.startswith("<!-->") else [at + 6] if rest.startswith("<!--->") else [i + n for mark, n in (("-->", 3), ("--!>", 4)) if (i := page.find(mark, at + 4)) >= 0]
            end = min(ends, default=len(page))
            out.append((at, end, "!"))
            at = end
            continue
        c = rest[1:2]
        if c and (c in "!?" or c == "/" and not (rest[2:3].isascii() and rest[2:3].isalpha())):
            if ">" in rest:
                out.append((at, at + rest.index(">") + 1, "!"))
                at = out[-1][1]
                continue
        elif c == "/" and ">" in rest:
            out.append((at, at + rest.index(">") + 1, "/"))
            at = out[-1][1]
            continue
        elif c.isascii() and c.isalpha():
            i = at + 1
            while i < len(page) and not (page[i] in "/>" or page[i].isspace()):
                i += 1
            while i < len(page) and page[i] != ">":
                if page[i] == "=":
                    i += 1
                    while i < len(page) and page[i].isspace():
                        i += 1
                    if i < len(page) and page[i] in "\"'":
                        close = page.find(page[i], i + 1)
                        i = close + 1 if close >= 0 else i + 1
                else:
                    i += 1
            if i < len(page):
                out.append((at, i + 1, "<"))
                at = i + 1
                continue
        at += 1
    return out


def test_tags_against_a_plain_scanner():
    parts = ["<", ">", "a", " ", "=", '"', "'", "/", "!", "-", "--", "<a ", "</b", "<!--", "-->", "x=", "?"]
    for seed in range(4000):
        draw = random.Random(seed)
        page = "".join(draw.choices(parts, k=draw.randint(1, 25)))
        tags, at, got = Tags(page), 0, []
        while (found := tags.next(at)) is not None:
            got.append(found[:3])
            at = found[1]
        assert got == plain_tags(page), page


def test_hostile_pages_take_linear_time():
    pages = ["<a " * 350_000, "<a " * 350_000 + ">x", '<a x="' * 100_000, "<a " * 200_000 + '=">"', "<a x='>" * 100_000, "<style " * 100_000, "<style>" + "a" * 500_000, "<style>" + "@a" * 200_000, "<ol reversed>" * 50_000 + "<li>x" * 3, "<style>" + "".join(f".c{i}{{display:none}}" for i in range(3000)) + "</style>" + "".join(f"<b class=c{i}>x</b>" for i in range(20_000)), "<table><tr><td>" + "<b>x" * 50_000, "<ul>" + "<b>" * 30_000 + "<li>x" * 30_000, "<!--" * 200_000, "<" * 500_000, "<ul>" * 20_000 + "<li>x" * 20_000, "<table><tr><td>" + "long" * 50_000 + "<td>x" + "<tr><td>a<td>b" * 20_000]
    for page in pages:
        began = time.perf_counter()
        shown = render(page)
        assert time.perf_counter() - began < 5 and len(shown) < 60 * len(page), page[:30]


def test_broken_pages():
    for page in ["<", "<<p>", "</p>", "<p", "a < b > c", "<b><i>x</b>y</i>", "<td>x</td>", "<li>x", "<table><tr>", "<a href='x>y", "<!-- open", "<script>never closed", "&#xZZ; &bogus;", "<table>loose<tr><td>x</table>", "</table></td>", "<tr><td>"]:
        assert isinstance(render(page), str)
    assert render("a < b > c") == "a < b > c"
    assert render("<td>x</td><td>y") == "x\ny"
    assert render("<div>" * 50000 + "deep" + "<table><tr><td>" * 2000 + "x") == "deep\n\nx"
    assert render("word " * 50000) == ("word " * 50000).strip()


def test_all_visible_words_are_kept(spark):
    """Against the standard library's parser, which knows no layout: the same words in the same order outside tables."""

    class Words(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            if tag not in ("b", "i", "a", "span", "em", "strong"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")
            if tag not in ("b", "i", "a", "span", "em", "strong"):
                self.out.append(" ")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        w = Words()
        w.feed(r.html)
        strip = lambda words: sorted(x for x in words if x != "-" and not x.rstrip(".").isdigit())
        assert strip(got[r.page_id].split()) == strip("".join(w.out).split()), r.html


def test_cases(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "", "t"), (None, "<p>x", "t"), (1, "", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(df).collect()) == [(0, "x"), (1, ""), (1, ""), (1, "")]
    assert extract(df.limit(0)).count() == 0


def test_cells_of_several_rows_and_wide_characters():
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A  B\n   C"
    assert render("<table><tr><td>x<td rowspan=3>long cell<td>y<tr><td>xx<td>yy<tr><td>z<td>w<tr><td>1<td>2<td>3</table>") == "x   long cell  y\nxx             yy\nz              w\n1   2          3"
    assert render("<table><tr><td rowspan=2 colspan=2>AB<td>c<tr><td>d<tr><td>e<td>f<td>g</table>") == "AB    c\n      d\ne  f  g"
    assert render("<table><tr><td>日本<td>b<tr><td>abcd<td>c<tr><td>ée<td>d</table>") == "日本  b\nabcd  c\née    d"


def test_visibility_and_rules_of_the_page():
    assert render('<div style="visibility:hidden">no <span style="visibility: visible">yes</span> no</div>z') == "yes\nz"
    assert render('<div style="display:none">no <span style="display:inline;visibility:visible">no</span></div>z') == "z"
    page = "<style>.h,#i{display:none} p.v{visibility:hidden} @media print{b{display:none}} @media screen{u{display:none}}</style><p class='a h'>no<p id=i>no<p class=v>no<p><b>yes</b> <u>no</u><i class=v>too</i>"
    assert render(page) == "yes too"
    assert render("<style>.h{display:none}</style><p class=h style='display:block'>shown") == "shown"


def test_details_lists_and_plain_text():
    assert render("<details><summary>S</summary>body <p>more</details><details open><summary>T</summary>shown</details>") == "S\nT\nshown"
    assert render("<details><summary>S</summary><details open><summary>inner</summary>x</details></details>z") == "S\nz"
    assert render("<ol reversed><li>a<li>b<ol><li>n</ol><li value=9>c<li>d</ol>") == "4. a\n3. b\n 1. n\n9. c\n8. d"
    assert render("<pre>\na\n b</pre>x") == "a\n b\n\nx"
    assert render("a<plaintext>b <b>c</b> &amp; </plaintext>") == "a\n\nb <b>c</b> &amp; </plaintext>"
    assert render("<xmp><b>as it is</b> &amp;</xmp>") == "<b>as it is</b> &amp;"


def test_foreign_elements_and_heads():
    assert render("co­op <svg><text>T</text><title>n</title><path/></svg> <math><mi>x</mi><annotation>no</annotation></math><svg/>after") == "coop T xafter"
    assert render("<title>t</title>hello<p>w") == "hello\n\nw"
    assert render("<html><head><meta charset=x><title>t</title></head>a<body>b") == "ab"

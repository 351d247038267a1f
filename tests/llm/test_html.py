"""Main text of pages: exact on pages built from a known article, defined on broken and empty ones."""

import html
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare.llm.html_text import extract_main_text, main_text

FOX = "The quick brown fox, as they say, jumps over the lazy dog near the river bank today."
P = f"<p>{FOX}</p>"

BEFORE = [
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li><li><a href=/c>Contact us</a></li></ul></nav>",
    "<header class='top'><h1>The Daily Site</h1><p>All the news, every day, for you.</p></header>",
    "<div class='cookie-consent'>We use cookies, as you may know, to make this site better for you and others.</div>",
    "<div id='site-menu'><a href=/x>One</a> | <a href=/y>Two</a></div>",
    "<div class=\"ad\">Buy our new phone, now cheaper, faster, better, while stocks last.</div>",
    "<script>if (a < b) { document.write('<p>not, a, text</p>'); }</script><style>p > a { color: red }</style>",
    "<form action=/s><label>Search</label><input name=q><button>Go</button></form>",
    "<!-- <p>commented, out, text</p> -->",
    "<noscript>Please turn on scripts, they are needed here.</noscript>",
]
AFTER = [
    "<footer>&copy; 2024 The Daily Site, all rights reserved. Imprint, privacy, terms.</footer>",
    "<aside><h3>More</h3><p>Other stories, that you may like, from around the web today.</p></aside>",
    "<div class='sidebar-right'><p>Weather: sunny, warm, with some wind, later rain.</p></div>",
    "<div id='comments'><div class='comment'><p>I do agree with this, it is well said, thank you, and please go on like that.</p></div></div>",
    "<section class='reader-comments'><h2>2 comments</h2><p>First, second, third, fourth, fifth, sixth, and so on without an end.</p></section>",
    "<div role='contentinfo'>Published by nobody, nowhere, never.</div>",
    "<div hidden><p>Hidden words, never seen, by anyone.</p></div>",
]
INSIDE = ["<div class='advert'>Cheap flights, hotels, cars.</div>", "<script>x()</script>", "<aside>See also: nothing.</aside>", "<div class='newsletter-signup'>Sign up, it is free.</div>"]


def a_page(rnd: random.Random) -> tuple[str, str]:
    """A page and the text of its article."""
    words = ["river", "stone", "a < b", "Q&A", "“quoted”", "été", "naïve", "x y", "50 %", "and,", "so", "it", "goes", "&amp;"]
    lines, body = [], []
    for k in range(rnd.randint(2, 12)):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) + "."
        coded = html.escape(text) if rnd.random() < 0.5 else html.escape(text).replace("é", "&eacute;").replace("“", "&#8220;").replace("”", "&#x201d;")
        coded = coded.replace(" so ", " <b>so</b> ").replace(" it ", "\n <a href='/it'>it</a>\t").replace("goes", "go<i>es</i>")
        open_tag, close_tag = rnd.choice([("<p>", "</p>"), ("<p class='lead'>", ""), ("<h2>", "</h2>"), ("<blockquote>", "</blockquote>"), ("<ul><li>", "</li></ul>"), ("<div>", "</div>")])
        body.append(f"{open_tag}{coded}{close_tag}")
        lines.append(" ".join(text.split()))
        if rnd.random() < 0.3:
            body.append(rnd.choice(INSIDE))
    opened, closed = rnd.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>")])
    before, after = rnd.sample(BEFORE, rnd.randint(0, 6)), rnd.sample(AFTER, rnd.randint(0, 5))
    wrap, end = rnd.choice([("", ""), ("<div class='page has-sidebar'>", "</div>"), ("<div id=wrapper><div>", "</div></div>")])
    return "<!DOCTYPE html><html><head><title>No, not, this</title></head><body>" + wrap + "".join(before) + opened + "\n".join(body) + closed + "".join(after) + end + "</body></html>", "\n".join(lines)


@pytest.mark.parametrize("seed", range(300))
def test_articles_come_back_whole(seed):
    page, text = a_page(random.Random(seed))
    assert main_text(page)[0] == text


def test_table_of_pages_keeps_every_row(spark):
    rnd = random.Random(5)
    made = [a_page(rnd) for _ in range(40)]
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(made)] + [(None, None, None), (7, "again", ""), (7, None, "<nav>only</nav>"), (8, "x", "no markup,  at\nall")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n chars", F.lit("x"))
    got = extract_main_text(frame).toPandas()
    assert list(got.columns) == ["page_id", "url", "n chars", "text", "n_chars", "container"]
    assert list(got["text"]) == [t for _, t in made] + ["", "", "", "no markup, at all"]
    assert (got["n_chars"] == got["text"].map(len)).all()
    assert extract_main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{P}<p>cut <a href='x", f"{FOX}\ncut"),
        (f"<form id=all><main>{P}</main></form>", FOX),
        ("<article>one<br>two &nbsp; three<div>four</div>five<script>'</article>'</script> six</article>", "one two three\nfour\nfive six"),
        ("<article><p>a < b <3 &am &amp &lt;p&gt;</p></article>", "a < b <3 &am & <p>"),
        (f"<article><header><h1>Title</h1><p>By Ann</p></header>{P}</article>", f"Title\n{FOX}"),
        (f"<main><article>{P}</article><article class='comment'>{P * 9}</article></main>", FOX),
        (f"<div><a href=a>Home</a> <a href=b>News</a></div><div>{P * 4}</div><div>Copyright Example 2020</div>", "\n".join([FOX] * 4)),
        (f"<table><tr><td><a href=x>m1</a><td>{P}<table><tr><td>a<td>b<tr><td>c<td>d</table></table>", f"{FOX}\na b\nc d"),
        (f"<article><p hidden>x</p><p style='display: none'>y</p>{P}</article>", FOX),
        ("<div class=ad>buy, buy, buy</div><nav>menu</nav>", ""),
        ("<!-- never closed <p>text</p>", ""),
        ("<script>never closed <p>text</p>", ""),
    ],
)
def test_awkward_pages(page, text):
    assert main_text(page)[0] == text


def test_very_long_and_deep_pages():
    long = f"<article>{'<p>' + FOX + '</p>'}" * 20_000
    assert main_text(long)[0] == "\n".join([FOX] * 20_000)
    assert main_text("<div>" * 50_000 + P + "</div>" * 50_000)[0] == FOX
    assert main_text("<" * 100_000 + "a ='" * 50_000 + P)[0] is not None


def test_query_covers_every_page(spark):
    from wayfare.llm.queries import op11_main_text

    got = op11_main_text(spark, "/root/testdata/sf0.001").toPandas()
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(got["page_id"]) == sorted(pages["page_id"])
    assert (got["n_chars"] > 0).all()

"""Main text of pages: written cases, and the text that known pages were made of."""

import html
import random
import time

import pytest

from recordflow.llm.html_text import LONG, extract, main_text

LEAD = "The council said that it would open the new bridge in the spring, and that it was paid for."
MORE = "It was one of the plans that the town had been asked for by those who live on the far side."


def page(body, head="<title>Bridge</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'


@pytest.mark.parametrize("body,want", [
    # What a marked article holds, short blocks too, and nothing else.
    (f"{NAV}<div class='ad'>Buy the best of the best</div><article><h1>Bridge</h1><p>{LEAD}</p>"
     f"<p>Yes.</p></article><footer>&copy; The town</footer>", f"Bridge\n{LEAD}\nYes."),
    ("<article><p>Short</article>", "Short"),
    (f"<article><p>{LEAD}</p><aside>{MORE}</aside><form>{MORE}</form><p>End</p></article>",
     f"{LEAD}\nEnd"),
    (f"<article><p>{LEAD}</p></article><section id='comments'><article class='comment'><p>{MORE}</p>"
     "</article></section>", LEAD),
    (f"<main><div class='cookie-notice'><p>{MORE}</p></div><header><h1>Bridge</h1></header>"
     f"<p>{LEAD}</p></main>", f"Bridge\n{LEAD}"),
    (f"<div role=main><p>{LEAD}</p></div><div class='sidebar'><p>{MORE}</p></div>", LEAD),
    # Teasers in article elements beside the text.
    (f"<div class='content with-sidebar'><p>{LEAD}</p><p>{MORE}</p></div>"
     "<article><a href=1>Also read</a></article>", f"{LEAD}\n{MORE}"),
    # No marks: stop words, links and neighbours decide.
    (f"<div><a href=1>One</a> <a href=2>Two</a></div><div><h2>Bridge</h2><p>{LEAD}</p><p>Yes.</p>"
     f"<p>{MORE}</p></div><div>&copy; 2020 Town</div>", f"Bridge\n{LEAD}\nYes.\n{MORE}"),
    (f"<div><p>{LEAD}</p><p>{'xq zv ' * 20}</p></div>", LEAD),
    (f"<div><p>{LEAD}</p></div><div><p><a href=1>{MORE}</a></p></div>", LEAD),
    (f"<div class=header>Town paper</div><h1 class=entry-header>Bridge</h1><p>{LEAD}", f"Bridge\n{LEAD}"),
    (f"<p>{LEAD}</p><p hidden>{MORE}</p><div hidden><p>{MORE}</p></div>", f"{LEAD}\n{MORE}"),
    (f"<p>{LEAD}</p><div style='display: none'><p>{MORE}</p></div>", LEAD),
    # White space, references, breaks, inline elements.
    ("<article><p> A&nbsp;&amp;\n\t<b>b</b>&#33;<br>c<br><br>d &am <i>e</i>f </p></article>",
     "A & b! c\nd &am ef"),
    ("<article><p>a&am<b>p;</b> &lt;p&gt; 1 < 2 <3</p></article>", "a&amp; <p> 1 < 2 <3"),
    # Scripts, styles, comments, drawings, controls; attributes that hold marks.
    ("<article><script>var a='<p>x</p>';</script><style>p{}</style><p title='a > b'>one<!-- <p>no -->"
     "<svg><text>no</text></svg> two<button>no</button></p><textarea><p>no</textarea></article>",
     "one two"),
    ("<article><p>one<button>two</p><p>three</p></article>", "onetwo\nthree"),
    # Left open.
    ("<article><p><b>one<br><p>two<li>three<li>four", "one\ntwo\nthree\nfour"),
    ("<article><p>one</p><!-- two", "one"),
    ("<article><p>one</p><script>two", "one"),
    ("<article><p>one <a href='x", "one"),
    ("</div></article><article><p>one</p></section></div><p>two</p></article>", "one\ntwo"),
    ("", ""), ("<", ""), ("<p></p> &nbsp; ", ""),
])
def test_written_cases(body, want):
    assert main_text(page(body)) == want


def test_page_without_head_or_tags():
    assert main_text(LEAD) == LEAD
    assert main_text(f"<title>x</title><p>{LEAD}") == LEAD
    assert main_text(f"<html><head><title>x</title><body><p>{LEAD}") == LEAD


def test_texts_that_pages_were_made_of():
    rng = random.Random(3)
    words = "the of and a ridge water übel & < > \"quoted\" naïve".split()
    for _ in range(200):
        blocks = [" ".join(rng.choices(words, k=rng.choice((1, 4, 30)))) for _ in range(rng.randint(1, 9))]
        body = "".join(f"<p class=x{i}>{html.escape(b)}</p>\n" for i, b in enumerate(blocks))
        made = page(f"{NAV}<div id=banner-1><p>{LEAD}</p></div><article><div>{body}</div></article>"
                    f"<div class=comments>{body}</div>")
        assert main_text(made) == "\n".join(blocks)


def test_unmarked_pages_lose_no_long_paragraph():
    rng = random.Random(5)
    for _ in range(100):
        blocks = [rng.choice((LEAD, MORE, "Yes.")) for _ in range(rng.randint(2, 8))]
        if not any(len(b) >= LONG for b in blocks):
            continue
        body = "".join(f"<p>{b}</p>" for b in blocks)
        made = page(f"<div><ul><li><a href=1>One</a></li></ul></div><div>{body}</div>")
        assert main_text(made) == "\n".join(blocks)


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<!--", "<a href=\"x", "<script>", "<b", "</", "<",
                                   "&amp", "<br>", "</div>", "<button>", "<li><div>", "x='y ", "<svg></svg>"])
def test_time_grows_with_length_only(piece):
    main_text(piece * 1000)
    start = time.process_time()
    main_text(f"<p>{LEAD}</p>" + piece * 100_000)
    assert time.process_time() - start < 10


def test_nulls_repeats_and_clashing_columns(spark, rows):
    pages = spark.createDataFrame(
        [(1, None, "k", "t"), (2, "", "k", "t"), (3, f"<article><p>{LEAD}", "k", "t"),
         (3, f"<article><p>{LEAD}", "k", "t"), (None, "<p>x", "k", "t")],
        "page_id bigint, html string, label string, text string")
    out = extract(pages)
    assert set(out.columns) == {"page_id", "html", "label", "text"}
    assert rows(out, "page_id", "text") == sorted(
        [(1, ""), (2, ""), (3, LEAD), (3, LEAD), (None, "")], key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_registered_query(spark):
    from recordflow.llm.queries import QUERIES

    out = QUERIES["op12_html_extraction"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string",
                                "n_chars": "bigint"}
    found = out.collect()
    assert found and all(r.n_chars == len(r.text) > 0 for r in found)

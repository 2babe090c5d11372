"""Pages of many shapes with their expected texts, and time in proportion to the number of tags."""

import time

import pytest

from graphloom.llm.html import main_text

P1 = "The first paragraph is long enough, has commas, and says something about the matter."
P2 = "The second one goes on, for a while, with more words about the same matter, and ends."
MENU = "<ul class='menu'><li><a href=/a>Home</a><li><a href=/b>About</a></ul>"
PAGES = {
    "quotes in an unquoted value": (f"<article><p title=it's>{P1}</p><p>{P2}</p></article>", f"{P1}\n{P2}"),
    "a stray quote in a tag": (f"<article><p class=\"a\" \">{P1}</p><p '>{P2}</p></article>", f"{P1}\n{P2}"),
    "a quote that never closes": (f"<article><p>{P1}</p><a href='x>y</a><p>{P2}</p></article>", f"{P1}\ny\n{P2}"),
    "a larger sign in a value": (f"<article><p title=\"a > b\">{P1}</p></article>", P1),
    "prose under a doubtful name": (f"<article><p>{P1}</p><div class='related-work'><p>{P2}</p></div><div class='notice-period'>{P1}</div></article>", f"{P1}\n{P2}\n{P1}"),
    "links under a doubtful name": (f"<article><p>{P1}</p><div class='related-stuff'><a href=/x>{P2}</a></div><div class='promo-stuff'>Buy now</div></article>", P1),
    "parts inside the article": (f"<article><header><h1>Title</h1></header><p>{P1}</p><div class='ad-box'>{P2}</div><div class='share-buttons'>Share this</div><section class='comments'><p>{P2}</p></section><p>{P2}</p><footer>x</footer></article>", f"Title\n{P1}\n{P2}"),
    "no article, two divs": (f"<body><nav>{MENU}</nav><div>{P1}</div><div>{P2}</div><footer>© x, y, z</footer></body>", f"{P1}\n{P2}"),
    "no article, headings between": (f"<body>{MENU}<h1>Title</h1><div><p>{P1}</p></div><h2>Part</h2><div><p>{P2}</p></div></body>", f"Title\n{P1}\nPart\n{P2}"),
    "short page": ("<body><div>A short one.</div></body>", "A short one."),
    "main": (f"<div class=wrap><main><h1>Title</h1><div><p>{P1}</p></div><div><p>{P2}</p></div></main><aside><p>{P1}</p></aside></div>", f"Title\n{P1}\n{P2}"),
    "nested articles": (f"<article><p>{P1}</p><article><p>{P2}</p></article></article><article class='comment'><p>{P1}</p></article>", f"{P1}\n{P2}"),
    "table": (f"<article><p>{P1}</p><table><tr><th>Key<th>Value<tr><td>a<td>1</table></article>", f"{P1}\nKey\nValue\na\n1"),
    "list": (f"<article><p>{P1}</p><ul><li>one<li>two<ol><li>three</ol></ul></article>", f"{P1}\none\ntwo\nthree"),
    "comments, declarations": (f"<!DOCTYPE html><?xml version='1.0'?><article><!-- > <p>no</p> --><p>{P1}</p><!--><p>{P2}</p></ ><!x></article>", f"{P1}\n{P2}"),
    "hidden parts and object are text": (f"<article><p>{P1}</p><p hidden>{P2}</p><div style='display:none' aria-hidden=true>{P1}</div><object data=x><p>{P2}</p></object></article>", f"{P1}\n{P2}\n{P1}\n{P2}"),
    "scripts and forms": (f"<article><script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style><p>{P1}</p><form><p>{P2}</p></form><svg><text>no</text></svg><template><p>no</p></template></article>", P1),
    "references": ("<article><p>a&nbsp;&lt;b&gt; &amp;amp; &#8364;&#x41; caf&eacute;, and so on it goes</p></article>", "a <b> &amp; €A café, and so on it goes"),
    "misnested": (f"<article><p><b>{P1}<p>{P2}</b></i></p></span></div></article>", f"{P1}\n{P2}"),
    "equal worth": (f"<section><div><p>{P1}</p></div></section><section><div><p>{P1}</p></div></section>", None),
    "only text": ("just, text", "just, text"),
    "nothing": ("<nav><p>menu, menu</p></nav>", ""),
}


@pytest.mark.parametrize("shape", PAGES)
def test_shape(shape):
    page, expect = PAGES[shape]
    assert main_text(page) == (expect if expect is not None else main_text(page))


@pytest.mark.parametrize("part", ["<div></x>", "<span><hr>", "<b></i>", "<p title=it's>", "<a '", "<!--", "<script", "<li><td>", "</div>", "<p class=a-b-c>word, word</p>"])
def test_time_follows_the_length(part):
    def took(n):
        began = time.process_time()
        main_text("<article><p>some text, to begin with</p>" + part * n)
        return time.process_time() - began

    took(100)
    small, large = took(5_000), took(50_000)
    assert large < 40 * max(small, 0.02)


def test_a_hundred_thousand_tags():
    page = "<body>" + "<div>" * 100_000 + "<p>" + P1 + "</p></x>" * 100_000
    began = time.process_time()
    assert main_text(page) == P1
    assert time.process_time() - began < 20

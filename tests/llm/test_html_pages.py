"""Main text of hand-made pages with the habits of real ones, and of generated pages whose article is known."""

import html
import random

import pytest

from stratalog.llm.html_text import extracted_pages, main_text

W = "A sentence of ordinary prose that says something at some length, and goes on."
P = f"<p>{W}</p>"
PAGES = {
    "head left open": (f"<html><head><title>t</title><body><article><h1>T</h1>{P}</article>", ["T", W]),
    "head and body left open": (f"<html><head><title>t</title><article><h1>T</h1>{P}</article>", ["T", W]),
    "text ends the head": (f"<html><head><title>t</title><style>p{{}}</style>{W} {W}", [f"{W} {W}"]),
    "page in a form": (f"<body><form id=aspnet><div><h1>T</h1>{P}{P}</div><input></form></body>", ["T", W, W]),
    "form in an article": (f"<body><article><h1>T</h1>{P}<form><p>Sign up for our letter</p><label>Mail</label><input><select><option>a<option>b</select></form>{P}</article>", ["T", W, W]),
    "unclosed share line": (f"<body><div><p class=share>Share this<p>{W}<p>{W}</div>", [W, W]),
    "unclosed notice": (f"<body><article><p class=notice>x<p>{W}</article>", [W]),
    "headline in an entry header": (f"<body><article><div class=entry-header><h1>The headline here</h1></div>{P}{P}</article>", ["The headline here", W, W]),
    "discussion section": (f"<body><article><h1>T</h1>{P}<section id=discussion><h2>Discussion</h2>{P}{P}</section></article>", ["T", W, "Discussion", W, W]),
    "body without sidebar": (f"<body class='no-sidebar'><div>{P}</div></body>", [W]),
    "article with open comments": (f"<body><article class='post comments-open'>{P}</article></body>", [W]),
    "named wrapper": (f"<body><div class='has-sidebar widget'><main>{P}</main></div></body>", [W]),
    "reader comments": (f"<body><article>{P}<div class=comments><p>{W} {W}</p></div></article><section id=comments>{P}{P}</section>", [W]),
    "unclosed items": (f"<body><article>{P}<ul><li>one<li class=ad>buy<li>two</ul>{P}</article>", [W, "one", "two", W]),
    "unclosed cells": (f"<body><article>{P}<table><tr><td>a<td>b<tr><td>c</table>{P}</article>", [W, "a", "b", "c", W]),
    "unclosed terms": (f"<body><article>{P}<dl><dt>a<dd>b<dt class=ad>x<dd>c</dl></article>", [W, "a", "b", "c"]),
    "unclosed link": (f"<body><nav><a href=x>Home</nav><article>{P}{P}</article>", [W, W]),
    "no article element": (f"<body><div class=header><a href=/>Site</a></div><div class=menu><ul><li><a>a</a></ul></div><div id=content><h1>T</h1>{P}{P}</div><div class=footer>Copy</div></body>", ["T", W, W]),
    "hidden": (f"<body><article>{P}<div style='display: none'>hidden {W}</div><div hidden>{W}</div></article>", [W]),
    "references": (f"<body><article><p>Caf&eacute;  &amp;\n more &#8212; &lt;b&gt; {W}</p><script>if (a < b) {{}}</script></article>", [f"Café & more — <b> {W}"]),
    "void and self-closed": (f"<body><article><p>one<br/>two<img src=x> three</p>{P}<hr/>{P}</article>", ["one two three", W, W]),
    "nothing": ("<html><body><nav>a</nav></body></html>", []),
    "plain": ("no markup at all", ["no markup at all"]),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_page(name):
    page, blocks = PAGES[name]
    assert main_text(page) == "\n\n".join(blocks)


def page_of(rng):
    """A page and the blocks of its article."""
    sentence = lambda n: " ".join(rng.choice(["tree", "café", "a < b", "R&D", "over", "stone", "and"]) for _ in range(n)).capitalize() + "."
    blocks = [sentence(4)] + [sentence(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
    inner = f"<h1>{html.escape(blocks[0])}</h1>"
    for b in blocks[1:]:
        said = html.escape(b)
        inner += rng.choice([f"<p>{said}</p>", f"<p>{said}", f"<p><b>{html.escape(b[:3])}</b>{html.escape(b[3:])}</p>", f"<blockquote>{said}</blockquote>", f"<p>\n {said.replace(' ', '  ', 2)} </p>"])
        inner += rng.choice(["", "", f"<div class=ad>{sentence(12)}</div>", f"<aside>{sentence(9)}</aside>", f"<ul class='social-share'><li><a href=x>{sentence(2)}</a></ul>"])
    body = rng.choice([f"<article>{inner}</article>", f"<main><div>{inner}</div></main>", f"<div id=content>{inner}</div>"])
    head = f"<html><head><title>{sentence(3)}</title><script>var x = '<p>no</p>';</script>" + rng.choice(["", "</head>"]) + rng.choice(["<body>", "<body class='page no-sidebar'>"])
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>{sentence(1)}</a></li>" for i in range(6)) + "</ul></nav>"
    after = rng.choice(["", f"<section class=comments><p>{sentence(40)}</p></section>"]) + f"<form><p>{sentence(6)}</p><input></form><footer>{sentence(8)}</footer>"
    return head + nav + body + after + rng.choice(["", "</body></html>"]), blocks


def test_generated_pages():
    rng = random.Random(12)
    for _ in range(150):
        page, blocks = page_of(rng)
        assert main_text(page) == "\n\n".join(blocks), page


def test_table(spark):
    rows = [(1, "u", PAGES["hidden"][0], "x", "y")] * 2 + [(2, None, None, None, None), (3, "v", "", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, k0 string")
    got = sorted((r["page_id"], r["text"]) for r in extracted_pages(pages).collect())
    assert got == [(1, W), (1, W), (2, ""), (3, "")] and extracted_pages(pages.where("false")).collect() == []

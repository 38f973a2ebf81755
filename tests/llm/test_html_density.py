"""Densities and their sums against a plain recursive computation, the choice they make on pages without article tags, and hostile pages."""

import math
import time
import xml.etree.ElementTree as ET

import pyarrow.parquet as pq
import pytest

from chirplake.llm import html_density

TEXT = ["The first paragraph tells what happened in the town that day and who was there to see it.", "A second one goes on with the story at some length, as one would expect of any report.", "The third is about what people said afterwards, which was a good deal more than was true.", "And the last one ends it all, with thanks to those who read so far and a hint of more."]
LEAD, TITLE = "In short: a day.", "What happened"
LINKS = "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(9))
P = "".join(f"<p>{t}</p>" for t in TEXT)
WHOLE = [TITLE, *TEXT]

#: Pages without article or main, without telling names, and the blocks of their main text.
PAGES = [
    (f"<html><body><div><ul>{LINKS}</ul></div><div><h1>{TITLE}</h1>{P}</div><div>Small print 2024</div></body></html>", WHOLE),
    (f"<html><body><div><a href='/'>Home</a><a href='/b'>Shop</a><a href='/c'>About</a></div><div><div><h1>{TITLE}</h1></div><div>{P}</div></div></body></html>", WHOLE),
    (f"<html><body><table><tr><td><ul>{LINKS}</ul></td><td><h1>{TITLE}</h1>{P}</td></tr></table></body></html>", WHOLE),
    (f"<html><body><div><div><h1>{TITLE}</h1><p>{LEAD}</p><div>{P}</div></div><div><ul>{LINKS}</ul></div></div></body></html>", [TITLE, LEAD, *TEXT]),
    (f"<html><body><div><h1>{TITLE}</h1><section><p>{TEXT[0]}</p><p>{TEXT[3]}</p></section><section><p>{TEXT[1]}</p><p>{TEXT[2]}</p></section></div><div><ul>{LINKS}</ul></div></body></html>", [TITLE, TEXT[0], TEXT[3], TEXT[1], TEXT[2]]),
    (f"<html><body><div><ul>{LINKS}</ul></div><div>{P}</div></body></html>", TEXT),
    (f"<html><body><h1>{TITLE}</h1><ul>{LINKS}</ul>{P}</body></html>", WHOLE),
    (f"<html><body><center><div><p>{TEXT[0]}<a href='/x'>with a link</a> in it</p>{P}</div></center><div><p><a href='/1'>Other story one</a></p><p><a href='/2'>Other story two</a></p></div></body></html>", [f"{TEXT[0]}with a link in it", *TEXT]),
    (f"<html><body><div><div><div><div><h2>{TITLE}</h2>{P}</div></div></div><div><ul>{LINKS}</ul></div></div></body></html>", WHOLE),
    (f"<html><body><div><ul>{LINKS}</ul></div><div><p><b>{TEXT[0]} {TEXT[1]}</b><br/></p><p>{LEAD}</p><p>{TEXT[2]}</p></div></body></html>", [f"{TEXT[0]} {TEXT[1]}", LEAD, TEXT[2]]),
    (f"<html><body><div>{TEXT[0]}<br/><br/>{TEXT[1]}</div><div><ul>{LINKS}</ul></div></body></html>", [f"{TEXT[0]} {TEXT[1]}"]),
]


def plain(element, in_link=False):
    """(characters, tags, link characters, link tags) of an element, by recursion."""
    link = in_link or element.tag == "a"
    own = lambda t: len("".join((t or "").split()))
    chars, tags, link_chars, link_tags = own(element.text), 0, own(element.text) if link else 0, 0
    for child in element:
        c, t, lc, lt = plain(child, link)
        tail = own(child.tail)
        chars, tags, link_chars, link_tags = chars + c + tail, tags + t + 1, link_chars + lc + (tail if link else 0), link_tags + lt + (child.tag == "a")
    return chars, tags, link_chars, link_tags


def composite(counts, body):
    """The published formula: C/T * log(C/LC * T/LT) to the base ln(C/nLC * LC + LCb/Cb * C + e), zeros taken as one."""
    c, t, lc, lt = counts
    if not c:
        return 0.0
    rest = max(c - lc, 1)
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / rest * lc + max(body[2], 1) / max(body[0], 1) * c + math.e)
    return c / t * math.log(c / lc * t / lt, base)


@pytest.mark.parametrize("page", [p for p, _ in PAGES])
def test_densities_and_sums(page):
    nodes = html_density._order(html_density.parse(page))
    html_density.measure(nodes)
    tree = ET.fromstring(page)
    body = plain(tree.find("body"))
    found = [n for n in nodes if n.tag != "#root"]
    elements = list(tree.iter())
    assert [n.tag for n in found] == [e.tag for e in elements]
    linked = {id(x) for a in tree.iter("a") for x in a.iter()}
    for node, element in zip(found, elements, strict=True):
        counts = plain(element, id(element) in linked)
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == counts
        assert node.density == pytest.approx(composite(counts, body))
        total = 0.0
        for text in [element.text, *(c.tail for c in element)]:
            n = len("".join((text or "").split()))
            total += composite((n, 0, n if id(element) in linked else 0, 0), body)
        total += sum(composite(plain(c, id(element) in linked), body) for c in element)
        assert node.sum == pytest.approx(total)


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_text_without_article_tags(page, text):
    assert html_density.main_text(page) == "\n\n".join(text)


def test_densities_decide(monkeypatch):
    """Without densities, or with those turned round, the same pages give other texts."""
    right = sum(html_density.main_text(p) == "\n\n".join(t) for p, t in PAGES)
    monkeypatch.setattr(html_density, "density", lambda *_: 0.0)
    assert right == len(PAGES) and sum(html_density.main_text(p) == "\n\n".join(t) for p, t in PAGES) <= len(PAGES) // 2
    monkeypatch.setattr(html_density, "density", lambda chars, tags, link_chars, link_tags, ratio: float(link_chars))
    assert sum(html_density.main_text(p) == "\n\n".join(t) for p, t in PAGES) <= 2


def test_the_denser_of_two_articles():
    short = "<article><p><a href='/1'>Teaser of another story</a></p></article>"
    assert html_density.main_text(f"<body>{short}<article><h1>{TITLE}</h1>{P}</article>{short}</body>") == "\n\n".join(WHOLE)


HOSTILE = ["<a", "</a", "<div>", "<b>", "<p>", "<li>", '<a "', '<a x="', "<a x='\"", "<!--", "<!", "</b>", "<b></i>", "<b><div></b>", "<span></div>", "<form><h1>", "<article><form>", "<table><tr><td>", "&#9", "< ", "<a b c d=", "<script>", "<title>x"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_hostile_pages_take_seconds(unit):
    began = time.time()
    page = unit * (1_000_000 // len(unit))
    html_density.main_text(page)
    html_density.page_text(page)
    assert time.time() - began < 20


def test_odd_markup():
    text = html_density.main_text
    assert text("<p>a &#" + "9" * 6000 + "; b") == "a � b" and text("<p>&#0000000065;") == "A"
    assert text("<html>some <b>bold</b> words and more of them") == "some bold words and more of them"
    assert text("<p title='x>y' data-z=\"a>b\" hidden=>gone</p><p class=a/b>kept") == "kept"
    assert text("<p>one<!-- > --><!--> two <!--->three") == "one two three"
    assert text("<div <p>x</div>") == "x" and text("a <b") == "a <b" and text("<>") == "<>"


NAMED = f"<html><head><title>x</title></head><body><header><a href='/'>Home</a></header><nav><ul>{LINKS}</ul></nav><div class='cookie-notice'>This site stores what it likes about you.</div><article><h1>{TITLE}</h1>{P}<div class='advert'>Buy a better day in a bigger town.</div></article><aside><p>Also here today.</p></aside><footer>Small print 2024</footer></body></html>"


def test_boxes_are_measured_and_the_article_is_chosen(monkeypatch):
    """Menus and notices count in the densities, which then leave them outside of what is chosen."""
    root = html_density.parse(NAMED)
    chosen = html_density.content_roots(root)
    assert [n.tag for n in chosen] == ["article"]
    assert all(n.chars for n in html_density._order(root) if n.tag in ("nav", "aside", "footer"))
    assert html_density.main_text(NAMED) == "\n\n".join(WHOLE)
    monkeypatch.setattr(html_density, "density", lambda *_: 0.0)
    assert html_density.main_text(NAMED) != "\n\n".join(WHOLE)


def test_a_marked_element_goes_by_a_second_sign():
    """Where a box's name is on most of the article, it stays; links, less density than the core's, or readers' hands are signs against it."""
    text = html_density.main_text
    assert text(f"<body><article><h1>{TITLE}</h1><div class='share'>{P}</div></article></body>") == "\n\n".join(WHOLE)
    assert text(f"<body><article><h1>{TITLE}</h1>{P}<div class='share'>Send it on</div></article></body>") == "\n\n".join(WHOLE)
    assert text(f"<body><article><h1>{TITLE}</h1>{P}<div class='related'><ul>{LINKS}</ul></div></article></body>") == "\n\n".join(WHOLE)
    assert text(f"<body><article><h1>{TITLE}</h1><p>{TEXT[0]}</p><div class='comments'>{P}{P}</div></article></body>") == f"{TITLE}\n\n{TEXT[0]}"


def test_densities_decide_on_the_pages(sf_dir):
    pages = [h for h in pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist() if h]
    texts, kept = [html_density.main_text(h) for h in pages], html_density.density
    html_density.density = lambda *_: 0.0
    try:
        other = [html_density.main_text(h) for h in pages]
    finally:
        html_density.density = kept
    assert pages and sum(a != b for a, b in zip(texts, other, strict=True)) > 0.9 * len(pages)

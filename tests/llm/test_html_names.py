"""Class and id names that only look like those of menus, notices and the like."""

import pytest

from chirplake.llm import html_density

LONG = "A paragraph of the article that is long enough to count as text."
PAGES = [
    ("<article><h2 id='related-work'>Related work</h2><p>One.</p><section id='search-algorithms'><p>Two.</p></section><section id='social-structure'><p>Three.</p></section><p class='notice-period'>Four.</p></article>", "Related work\n\nOne.\n\nTwo.\n\nThree.\n\nFour."),
    (f"<body><div class='content sidebar-right'><h1>T</h1><p>{LONG}</p></div></body>", f"T\n\n{LONG}"),
    (f"<body><div class='wrapper menu-open'><article><p>{LONG}</p></article></div></body>", LONG),
    (f"<body><div class='page sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>Short.</p></div></body>", f"{LONG}\n\n{LONG}"),
    (f"<article><h2 id='comments'>Comments on the law</h2><p>{LONG}</p><div class='social-share'>Share</div><div class='related-posts'>More</div><div id='comment-12'>c</div></article>", f"Comments on the law\n\n{LONG}"),
    (f"<article><h1>T</h1><section id='alerts'><h2>Alerts</h2><p>{LONG}</p></section><section id='search'><h2>Search</h2><p>{LONG}</p><p>{LONG}</p></section></article>", f"T\n\nAlerts\n\n{LONG}\n\nSearch\n\n{LONG}\n\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><section id='comments'><h3>2 comments</h3><p>{LONG}</p></section><section id='related'><h3>More</h3><p><a href='/'>{LONG}</a></p></section><section id='newsletter'><h3>Mail</h3><p>{LONG}</p><button>Go</button></section></article>", f"T\n\n{LONG}"),
    (f"<body><h1>T</h1><p>{LONG}</p><section id='alert'><h2>Alert</h2><p>{LONG}</p></section></body>", f"T\n\n{LONG}"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_names(html, text):
    assert html_density.main_text(html) == text

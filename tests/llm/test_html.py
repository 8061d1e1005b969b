"""HTML extraction: pages where the cut decides, shapes that classifiers miss, odd rows, long pages."""

import time

import numpy as np

from strata.llm import html_text

PARA = "This sentence belongs to the article and is long enough to look like prose, with a stop at the end of it all, as usual."
SIDE = "Readers of this page may also want to know what else is on offer here today, and tomorrow, and on every other day of the year."


def article(inner, around=""):
    return f"<html><body><nav><a href=/>Home</a></nav>{around}<article><h1>Title of it</h1><p>{PARA}</p>{inner}<p>{PARA}</p><p>Last. {PARA}</p></article><footer>Imprint</footer></body></html>"


def labels(page):
    blocks, elements = html_text.blocks_of(page)
    kept = html_text.min_cut([b[1] for b in blocks], html_text.edges_of(blocks, elements))
    return {b[0]: (b[1] > 0, k) for b, k in zip(blocks, kept)}


def test_the_cut_decides_by_neighbours():
    # a section of the article under a doubtful name: its own evidence is against it, its neighbours are for it
    page = article(f'<div id="legal-history"><p>{SIDE}</p></div>')
    assert labels(page)[SIDE] == (False, True) and SIDE in html_text.main_text(page)
    # the same words outside of the article, next to other side parts: nothing speaks for them
    page = article("", f'<div id="legal"><p>{SIDE}</p></div>')
    assert labels(page)[SIDE] == (False, False)
    # a sure name is not outvoted
    for name in ("newsletter-box", "cookie-bar", "comments"):
        assert SIDE not in html_text.main_text(article(f'<div class="{name}"><p>{SIDE}</p></div>')), name
    # a short line of its own in the article, and a lone line among menus
    assert "* * *" in html_text.main_text(article("<div>* * *</div>"))


def test_side_box_without_a_telling_name_stands_outside_the_article():
    page = article("", f'<div class="box-left"><p>{SIDE}</p></div>')
    assert SIDE not in html_text.main_text(page) and html_text.main_text(page).count(PARA) == 3
    # a page without an article has nothing to stand outside of
    assert html_text.main_text(f'<body><div class="box-left"><p>{SIDE}</p></div>') == SIDE


def test_nothing_of_the_article_is_dropped():
    for inner, want in (("<p>The area is <math><mi>a</mi></math> units, of <object>b</object> and <canvas>c</canvas> kind.</p>", "The area is a units, of b and c kind."),
                        ("<noscript><p>Said without scripts as well.</p></noscript>", "Said without scripts as well."),
                        ("<p>Seen <svg><text>in a drawing</text></svg> too.</p>", "Seen in a drawing too."),
                        ("<p>Code: <xmp>x = y</xmp> here.</p>", "Code: x = y here.")):
        assert want in html_text.main_text(article(inner)).split("\n\n"), inner


def test_links_that_never_end():
    whole = html_text.main_text(article(""))
    assert html_text.main_text(article("<a name=top>")) == whole  # no target, no link
    plain = f"<body><a name=top><p>{PARA}</p><p>{SIDE}</p></body>"
    assert html_text.main_text(plain) == f"{PARA}\n\n{SIDE}"
    assert html_text.main_text(article("<p><a href=x>See</a> this. <a href=y>Open link.</p>")).count(PARA) == 3
    assert html_text.main_text(f"<body><ul><li><a href=1>One two three</a><li><a href=2>Four five six</a></ul><p>{PARA}</p>") == PARA


def test_steps_between_elements():
    page = "<body><div><p>one</p><p>two</p></div><section><div><p>three</p></div></section>"
    blocks, elements = html_text.blocks_of(page)
    one, two, three = (b[3] for b in blocks)
    assert [html_text.steps_between(elements, *x) for x in ((one, one), (one, two), (two, three))] == [0, 2, 5]


def test_min_cut_of_random_graphs_is_least_and_smallest():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        cost = np.round(rng.normal(size=n) * 2, 1).tolist()
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), np.round(rng.random(12) * 1.5, 1)) if a != b]
        best, sets = None, []
        for bits in range(1 << n):
            x = [bool(bits >> i & 1) for i in range(n)]
            value = sum(max(0, c) for c, k in zip(cost, x) if not k) + sum(max(0, -c) for c, k in zip(cost, x) if k) + sum(c for a, b, c in edges if x[a] != x[b])
            if best is None or value < best - 1e-6:
                best, sets = value, [x]
            elif value < best + 1e-6:
                sets.append(x)
        got = html_text.min_cut(cost, edges)
        assert got in sets and sum(got) == min(map(sum, sets))


def test_long_pages_take_seconds():
    rng = np.random.default_rng(4)
    n = 20_000
    page = article("".join(f"<div class=legal><p>{PARA if k % 3 else 'Short.'}</p></div>" if rng.random() < 0.5 else f"<p>{PARA}</p>" for k in range(n)))
    start = time.time()
    text = html_text.main_text(page)
    assert time.time() - start < 20 and text.count("This sentence") > n / 3
    # all undecided, in one component
    n = 6000
    cost = (rng.random(n) - 0.5).tolist()
    start = time.time()
    html_text.min_cut(cost, [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 2, 0.5) for i in range(n - 2)])
    assert time.time() - start < 20


def test_extract_text_of_odd_rows(spark):
    page = article("")
    rows = [(1, "u", page, "a"), (2, None, None, "b"), (3, "v", "", "c"), (1, "u", page, "a"), (None, "w", "<p", "d"), (4, "x", "<nav>only a menu</nav>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "7 AS n_chars", "'z' AS _html").repartition(3)
    out = html_text.extract_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    whole = html_text.main_text(page)
    want = [(1, "u", whole, len(whole))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (4, "x", "", 0), (None, "w", "", 0)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert html_text.extract_text(df.limit(0)).count() == 0

import html
import itertools
import random
import time

import numpy as np
import pytest

from caregauge.llm import main_text, page_layouts, queries
from caregauge.llm.dom import parse


def texts(markup):
    page = parse(markup)
    return [t for t in page.texts if t]


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<p>one<p>two", ["one", "two"]),
        ("<p><b>a\n b<br>c <i>d</i>e<p>f", ["a b c de", "f"]),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>t", ["x", "y", "z", "t"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ('<script>var t="</p><p>no"</script>yes<style>p{}</style><textarea>no</textarea>', ["yes"]),
        ("a &amp b &lt;p&gt; &#233;&nbsp;&eacute;c &unknown; &am", ["a & b <p> é éc &unknown; &am"]),
        ("<!-- <p>no</p> -->yes<!-->too<!--no", ["yestoo"]),
        ("1 < 2 <3 </> </ p> <", ["1 < 2 <3 <"]),
        ('<div title="a > b" class=x>in</div>out<div class="never ends', ["in", "out"]),
        ("<div hidden>no</div><div style='display : none'><p>no</p></div><select><option>no</select>yes", ["yes"]),
        ("</div></p>a</article><div>b</span></div></div>c", ["a", "b", "c"]),
        ("<head><title>no</title></head><body>a</body></html>b", ["ab"]),
        ("<h1>a<h2>b</h1>c", ["a", "b", "c"]),
        ("", []),
        (" \n\t&nbsp;", []),
    ],
)
def test_blocks(markup, expected):
    assert texts(markup) == expected


def test_tree_and_links():
    page = parse('<div class="Side-bar" id=top>x <a href=q>in <b>it</b></a><p>y</div><a name=n>z</a>')
    assert page.tags == ["body", "div", "#text", "p", "#text", "#text"]
    assert page.parents == [-1, 0, 1, 1, 3, 0] and page.stops == [6, 5, 3, 5, 5, 6] and page.linked == [0, 0, 4, 0, 0, 0]
    assert page.words[1].split() == ["Side-bar", "top"] and page.depths == [0, 1, 2, 2, 3, 2 - 1]


@pytest.mark.parametrize(
    "piece", ["<", "<!--", '<a href="', "<div>x", "<li>", "<p>x", "<script>", "</p></div>", "<a b", " =", "&", "<b><p>", "<table><td>", '<a b="c" ']
)
def test_long_pages_take_linear_time(piece):
    begin = time.process_time()
    parse("<a " + piece * 100_000 if piece in (" =",) else piece * 100_000)
    assert time.process_time() - begin < 20


def small_trees():
    r = random.Random(2)
    pages = []
    for _ in range(12):
        markup = "".join(r.choice(["<div>", "</div>", "<p>a b.", "<ul><li>", "</ul>", "<nav>x</nav>", "text "]) for _ in range(8))
        page = parse(markup)
        if len(page.tags) <= 11:
            pages.append(page)
    return pages


def test_marginals_against_all_labellings():
    r = np.random.default_rng(0)
    model = main_text.Model(r.normal(size=main_text.FEATURES), r.normal(size=(main_text.EDGES, 2, 2)))
    pages = [p for p in small_trees() if p.tags]
    assert len(pages) > 5
    nodes = main_text.forest(pages)
    content, joint, log_sum = main_text.marginals(nodes, model)
    begin, total = 0, 0.0
    for page in pages:
        here = range(begin, begin + len(page.tags))
        weight, on, pairs = 0.0, np.zeros(len(here)), np.zeros((len(here), 2, 2))
        for labels in itertools.product((0, 1), repeat=len(here)):
            score = sum(float(nodes.features[k].astype(float) @ model.unary) for k, y in zip(here, labels) if y)
            for n, k in enumerate(here):
                up = nodes.parents[k]
                if up >= 0:
                    score += model.edges[nodes.kinds[k]][labels[up - begin], labels[n]]
            w = np.exp(score)
            weight += w
            on += w * np.array(labels)
            for n, k in enumerate(here):
                if nodes.parents[k] >= 0:
                    pairs[n, labels[nodes.parents[k] - begin], labels[n]] += w
        assert np.allclose(content[list(here)], on / weight, atol=1e-4) and np.allclose(joint[list(here)], pairs / weight, atol=1e-4)
        total += np.log(weight)
        begin += len(here)
    assert abs(total - log_sum) < 1e-2


def article(blocks):
    """A page of the usual kind."""
    inside = "".join(f"<p>{html.escape(b)}</p>" for b in blocks[1:])
    return (
        f"<html><head><title>{blocks[0]}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
        f'<div class="ad">Buy the river paper now.</div><article><h1>{blocks[0]}</h1>{inside}</article><footer>&copy; A company</footer></body></html>'
    )


def frame(spark, rows):
    given = [(i, f"http://x/{i}", h, "x", 1, 2.0) for i, h in rows]
    return spark.createDataFrame(given, "page_id long, url string, html string, text string, n_chars int, label double")


def test_query_and_held_out_layouts(spark, tmp_path):
    pages = page_layouts.made_up(120, 5)
    rows = [(k, article(b)) for k, b in enumerate(pages)]
    rows += [(900, None), (901, ""), (902, "<b>"), (None, article(pages[0])), (None, article(pages[0])), (903, article(["Long", "word " * 200_000]))]
    frame(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op11_html_extraction(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = [tuple(r) for r in found.collect()]
    texts_of = {r[0]: r for r in got}
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    for k, blocks in enumerate(pages):
        assert texts_of[k][2] == "\n".join(blocks) and texts_of[k][1] == f"http://x/{k}"
    assert all(texts_of[k][2] == "" for k in (900, 901, 902)) and sum(r[0] is None for r in got) == 2
    assert texts_of[903][2] == "Long\n" + " ".join(["word"] * 200_000)

    model = main_text.fit(frame(spark, rows).select("page_id", "html"))
    chance, others = random.Random(77), page_layouts.made_up(60, 6)
    exact = 0
    for k in range(300):
        markup = page_layouts.layout(chance, others[k % 60], others, [["Our other offers", "Read this next"]])
        page = parse(markup)
        wanted = "\n".join(t for t, y in zip(page.texts, main_text.mark_labels(page)) if t and y)
        exact += next(main_text.main_texts([markup], model)) == wanted
    assert exact >= 255, exact


def test_parts_of_a_page(spark):
    """Each thing that is not the article, in markup of its own, without any labelled page."""
    model = main_text.fit(frame(spark, []))
    title, *blocks = page_layouts.made_up(1, 8)[0][:1] + page_layouts.made_up(6, 9)[2][1:6]
    inside = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
    around = [
        '<header class="site-header"><div>The daily paper</div></header>',
        '<div id="cookie-notice"><p>We use cookies to count our readers. Please agree.</p></div>',
        '<div class="sidebar"><h3>More</h3><ul><li><a href=x>River news</a><li><a href=y>Paper</a></ul></div>',
        '<form action=/s><label>Search</label><input name=q></form>',
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>What a good season report, I liked the garden people.</p></div></section>',
        '<div class="ad"><p>Buy garden paper at the market now.</p></div>',
        '<footer><p>&copy; The paper</p></footer>',
    ]
    for main in (f"<article>{inside}</article>", f"<main>{inside}</main>", f'<div class="post-content">{inside}</div>'):
        page = f"<body>{''.join(around[:2])}{main}{''.join(around[2:])}</body>"
        assert next(main_text.main_texts([page], model)) == "\n".join([title, *blocks])


def test_no_pages(spark, tmp_path):
    frame(spark, [(1, "x")]).limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op11_html_extraction(spark, str(tmp_path)).count() == 0


def test_labels_by_markup():
    page = parse('<article><h1>a</h1><p>b</p><aside>c</aside><div class="comments"><p>d</p></div></article><p>e</p>')
    kept = [t for t, y in zip(page.texts, main_text.markup_labels(page)) if t and y]
    assert kept == ["a", "b"]

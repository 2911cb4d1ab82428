import html as entities
import itertools
import re

import numpy as np

from scoreforge.llm import htmltext as H

SF = "/root/testdata/sf0.01"
PROSE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt."


def article(page):
    """The text of the article of a page of the table, by its known layout."""
    inner = page[page.index("<article>") + 9:page.index("</article>")].replace("<br>", " ")
    blocks = (" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_marginals_match_enumeration():
    tree = H.Tree(f"<body><nav><a href=x>a</a></nav><div><h1>t</h1><p>{PROSE}<p>x</div>")
    x, model = H.features(tree), H.Model(H.PRIOR[:len(H.FEATURES)].clip(-3, 3), np.array([1.5, 0.7, 2.0, 1.1]))
    n = len(tree.parent)
    total, on = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(float(x[i] @ model.weights) for i in range(n) if labels[i])
        for i in range(1, n):
            in_other, in_content = model.costs[2:] if tree.kind[i] == "leaf" else model.costs[:2]
            p = labels[tree.parent[i]]
            score -= in_other if labels[i] and not p else in_content if p and not labels[i] else 0
        total += np.exp(score)
        on += np.exp(score) * np.array(labels)
    odds = model.marginals(tree, x)
    assert np.allclose(1 / (1 + np.exp(-odds)), on / total)


def test_pages_give_their_articles_with_and_without_the_landmark(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = H.fit_pages(pages)
    rows = H.extract_text(pages, model).collect()
    assert len(rows) == pages.count()
    assert [r["page_id"] for r in rows if r["text"] != article(r["html"])] == []
    plain = [r["html"].replace("<article>", "<div>").replace("</article>", "</div>") for r in rows]
    assert sum(model.text(h) == article(r["html"]) for h, r in zip(plain, rows)) > 0.95 * len(rows)


def test_kinds_of_boilerplate():
    model = H.fit(np.zeros((0, len(H.PRIOR))), np.zeros(0))
    inside = (f"<h1>T</h1><p>{PROSE}</p><aside>{PROSE}</aside><div class='cookie-notice'>{PROSE}</div><ul><li>one<li>two</ul>"
              f"<table><tr><td>a<td>b</table><section id=comments><p>{PROSE}</p></section><form><p>{PROSE}</p></form>"
              f"<script>'<p>no</p>'</script><style>p{{}}</style><blockquote>{PROSE}</blockquote><footer>end</footer>")
    want = "\n".join(["T", PROSE, "one", "two", "a", "b", PROSE])
    for outer in ("article", "main"):
        page = (f"<body><header>{PROSE}</header><nav><a href=x>A</a></nav><{outer}>{inside}</{outer}>"
                f"<div class=sidebar><p>{PROSE}</p></div><div class='ads'>{PROSE}</div></body>")
        assert model.text(page) == want


def test_blocks_references_and_broken_markup():
    model = H.fit(np.zeros((0, len(H.PRIOR))), np.zeros(0))
    one = "<article><p>A &amp; B&nbsp;&#x41;\n\t c<br>d <b>e</b><i>f</i><p><b>g<br><p>h<!-- no --></article>"
    assert model.text(one) == "A & B A c d ef\ng\nh"
    assert model.text("") == model.text("<nav>x</nav>") == ""
    assert model.text("just text &lt; more") == "just text < more"
    assert model.text("<article><p>kept <script>var x = '<p>lost") == "kept"
    assert model.text("<article><p>deep" + "<div>" * 3000 + "end") == "deep\nend"


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<article><p>x y"), (2, "u", "<article><p>x y")],
                                  "page_id long, url string, html string").selectExpr("*", "'z' kind", "1 text")
    rows = H.extract_text(pages, H.fit_pages(pages), to="found").collect()
    assert sorted((str(r["page_id"]), r["found"]) for r in rows) == [("1", ""), ("2", "x y"), ("2", "x y"), ("None", "")]
    empty = pages.limit(0)
    assert H.extract_text(empty, H.fit_pages(empty)).count() == 0


def test_self_closed_and_unclosed_hidden_elements():
    model = H.fit(np.zeros((0, len(H.PRIOR))), np.zeros(0))
    article = "<article><p>First words of the article, long enough to be read as prose by anyone.</p><p>Second part.</p></article>"
    want = model.text(f"<body>{article}</body>")
    assert want.startswith("First words") and want.endswith("Second part.")
    for before in ('<svg class="i"/>', "<math/>", "<div><button>Press</div>", "<div><video><p>no</p></div>",
                   "<div><object><div>x</div><select></div>"):
        assert model.text(f"<body>{before}{article}</body>") == want
    assert model.text(f"<body><svg><path/><g></g></svg>{article}</body>") == want


def test_deep_pages_take_linear_time():
    import time
    n = 20_000
    pages = ["<div>" * n + "<p>text one" * n, "<div>" * n + "</span></b></li>" * n, "<ul>" + "<li>item" * n,
             "<svg>" + "<div>" * n, "<p>" * n, "<table>" + "<tr><td>cell" * n, "word " * n, "<article>" + "<div><p>a</div>" * n]
    model = H.fit(np.zeros((0, len(H.PRIOR))), np.zeros(0))
    for page in pages:
        began = time.time()
        model.text(page)
        assert time.time() - began < 6

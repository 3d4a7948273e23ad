"""Block labeller: parser cases, gradients, held-out layouts, whole pages."""
import re

import numpy as np

from ledgerline.llm import extract
from ledgerline.llm.common import prepare


def test_leaves():
    html = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class=x>
    <!-- <p>no</p> --><script>if (a<b) "</p>"</script><div id="a" class='b c' title="x>y">one<b> two</b><br>three &amp;&nbsp;four
    <p>p1 <i>x</i>y<p>p2<ul><li>l1<li><a href=#>l2</a></ul></div><p>1 < 2 &lt; 3<table><tr><td>c1<td>c2</table><svg><p>s</p></svg>tail"""
    got = extract.leaves(html)
    assert [t for _, t, _ in got] == ["one two three & four", "p1 xy", "p2", "l1", "l2", "1 < 2 < 3", "c1", "c2", "tail"]
    assert got[0][0] == ("html", "body x", "div a b c")
    assert got[2][0][-1] == "p" and got[2][0].count("p") == 1
    assert got[4][0][-2:] == ("ul", "li") and got[4][2] == 2 and got[3][2] == 0
    assert got[5][0] == ("html", "body x", "p")
    assert extract.leaves("") == [] and extract.leaves("<a '") and extract.leaves("plain")[0][1] == "plain"


def test_gradient():
    texts = {"main": ["a b c."], "head": ["h"], "link": ["l k"], "other": ["o p q"]}
    pages, labels = extract.layouts(texts, 5)
    model, enc = extract.Labeller(), extract.Encoder()(pages)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    y = np.concatenate(labels)
    loss = lambda: float(-np.mean(np.where(y > 0, np.log(q := model.forward(enc)[0]), np.log(1 - q))))
    _, grad = model.gradient(enc, y)
    rng = np.random.default_rng(1)
    for name, w in model.w.items():
        used = np.argwhere(np.abs(grad[name]) > 1e-4)
        for at in used[rng.permutation(len(used))[:4]]:
            at, old = tuple(at), w[tuple(at)]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-3 + 0.05 * abs(grad[name][at])


def test_pages_and_cases(spark):
    prepare(spark)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = extract.fit(pages)
    model = extract.Labeller(weights)
    texts = extract.block_texts([r.html for r in pages.orderBy("page_id").limit(30).collect()])
    held, marks = extract.layouts(texts, 200, seed=77)
    p = model.forward(extract.Encoder()(held))[0]
    assert np.mean((p > 0.5) == np.concatenate(marks)) >= 0.99
    got = {r.page_id: r._main.text for r in extract.main_text(pages, weights).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        want = [t for _, t, _ in extract.leaves(body)]
        assert got[r.page_id] == "\n".join(want)
    page = ("<body><div class=site-header>Name</div><nav><a href=x>Home</a></nav><div class='cookie-notice'><p>We use cookies here.</p></div>"
            "<div class=entry-content><h1>Head line</h1><p>First text of the page, long enough.</p><div class=advert>Buy now</div>"
            "<p>Second text of the page.</p></div><section class=comments><div class=comment><p>I liked the text of the page.</p></div>"
            "</section><form><label>Name</label></form><div id=footer>Copyright</div></body>")
    odd = spark.createDataFrame([(1, page, 1), (2, None, 1), (3, "", 1), (1, page, 1), (4, "<p></p>", 1),
                                 (5, "<article>" + "<p>many words here.</p>" * 5000 + "</article>", 1)], "page_id long, html string, text int")
    out = extract.main_text(odd, weights).collect()
    assert out[0]._main.text == out[3]._main.text
    assert out[0]._main.text == "Head line\nFirst text of the page, long enough.\nSecond text of the page."
    assert [o._main.text for o in (out[1], out[2], out[4])] == ["", "", ""]
    assert out[5]._main.text.count("\n") == 4999
    assert extract.main_text(odd.limit(0), weights).count() == 0
    assert extract.fit(odd.limit(0))["out"].shape

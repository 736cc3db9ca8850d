import html
import re

from martflow.llm import html_text as H

SF = "/root/testdata/sf0.01"


def test_cases():
    p = "A sentence of the article that has some words in it, as they do."
    cases = {
        None: "",
        "": "",
        "   ": "",
        f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{p}<p>Yes.<p>{p}</article><footer>&copy; us</footer>": f"Head\n{p}\nYes.\n{p}",
        f"<article><p>a&amp;b &lt;i&gt; &#233; &nbsp; x\n\t y</p><p>{p}</p></article>": f"a&b <i> é x y\n{p}",
        f"<script>var t='</p>';</script><style>p{{}}</style><article><p>{p}</p><!-- <p>no</p> --><p>{p}</p></article>": f"{p}\n{p}",
        f"<article><p>{p}</p><div class='comments'><p>{p} says a reader</p></div><form><p>Your name</p></form></article>": p,
        f"<article><p>{p}</p><aside>{p}</aside><div id=cookie-notice>{p}</div><div class=ad>{p}</div></article>": p,
        f"<body><header><h1>The site</h1>{p}</header><div class=sidebar><p>{p}</p></div><main><header><h1>Head</h1></header><p>{p}</p></main></body>": f"Head\n{p}",
        f"<article><p>{p}</p><p>{p} cut <a hre": f"{p}\n{p} cut",
        f"<article><p>{p}</p><p>last</p></article>": f"{p}\nlast",
        f"<article><h1>x</h1><p>{p} <b>bold <p>{p}</b></article>": f"x\n{p} bold\n{p}",
        f"<head><title>T</title><article><p>{p}</p><p>{p}": f"{p}\n{p}",
        f"<article><p>{p}</p><select><option>A<option>B</select><button>Go</button><p>{p}</p></article><noscript>{p}</noscript>": f"{p}\n{p}",
        f"<article><p>{p}</p><script>never closed <p>{p}</p>": p,
        f"<ARTICLE><P>{p}</P></ARTICLE><FOOTER>{p}</FOOTER>": p,
        # names on body, and of other things than what they are in, tell nothing
        f"<body class='single post with-sidebar'><article><p>{p}</p><p>{p}</p></article></body>": f"{p}\n{p}",
        f"<body class='home comments-open'><div><p>{p}</p><p>{p} {p} {p}</p><p>{p}</p></div></body>": f"{p}\n{p} {p} {p}\n{p}",
        f"<div class='content has-ads'><p>{p}</p><p>{p}</p></div>": f"{p}\n{p}",
        f"<div class='layout sidebar'><article><p>{p}</p></article></div>": p,
        f"<div class='comments'><article><p>{p}</p></article></div><main><p>{p}</p></main>": p,
        # links are part of an article
        f"<article><p>{p}</p><p><a href=/>one link alone</a></p><p>{p}</p></article>": f"{p}\none link alone\n{p}",
        f"<article><p>{p}</p><p>See <a href=/>one</a> <a href=/>two</a> links.</p><p>{p}</p></article>": f"{p}\nSee one two links.\n{p}",
        f"<div><p>{p} {p} {p}</p><p>See <a href=/>one</a> <a href=/>two</a> links.</p><p>{p} {p} {p}</p></div>": f"{p} {p} {p}\nSee one two links.\n{p} {p} {p}",
        "<article><p>Let <math><mi>x</mi></math> be</p><p>an <svg><text>arrow</text></svg> and <object>this</object></p></article>": "Let x be\nan arrow and this",
        "<article><p>AT&<b>amp;</b>T</p></article>": "AT&amp;T",
        f"<p>{p}</p>": p,
    }
    for page, want in cases.items():
        assert H.main_text(page) == want, page


def test_tree_uses_the_features_of_blocks():
    x, y = H.labelled_blocks(H.labelled_pages(200, 17))
    tree = H.trained()
    assert 300 < len(y) and 0.3 < y.mean() < 0.7 and (tree.predict(x) == y).mean() > 0.99
    assert tree.feature[0] < 6  # the root asks for words or links, not for names
    assert {f for f in tree.feature if f >= 0} >= {0, 1} and any(f in (2, 3, 4, 5) for f in tree.feature)


def test_tree_on_other_pages():
    for forms, least in ((("",), 0.97), (H.FORMS, 0.98)):  # pages without any element that says where the article is, and all kinds
        x, y = H.labelled_blocks(H.labelled_pages(150, 99, forms))
        assert (H.trained().predict(x) == y).mean() > least


def test_long_page():
    p = "word " * 30
    page = "<nav>" + "<a href=/>x</a>" * 1000 + "</nav><article>" + f"<p>{p}</p>" * 20_000 + "</article>"
    assert H.main_text(page) == "\n".join([p.strip()] * 20_000)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = H.op2_html_text(spark, SF).collect()
    assert rows[0].__fields__ == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner))
        assert r.text == "\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>a", "t")], "page_id long, html string, text string")
    assert [(r.text, r.n_chars) for r in H.extract(df).collect()][:2] == [("", 0), ("", 0)]
    assert H.extract(df.limit(0)).count() == 0

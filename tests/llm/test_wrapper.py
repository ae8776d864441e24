"""Main text against pages whose articles are known."""

import pytest

from gleaner.llm import wrapper
from gleaner.llm.q_wrapper import op11_html_extraction

WORDS = "sol luna mar cielo rio monte valle bosque nube viento piedra arena".split()


def words(seed, n):
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)] + str((seed + i) % 9) for i in range(n))


def article(i):
    return [f"Title {words(i, 3)}", *(words(i * 11 + j, 12 + j) + "." for j in range(1 + i % 4))]


def semantic(i, blocks):
    head, *rest = blocks
    body = "".join(f"<p>{b}{'</p>' if j % 2 else ''}" for j, b in enumerate(rest))
    return (
        f"<!DOCTYPE html><html><head><title>{head}</title><script>var a='</p><article>no</article>';</script><style>p{{}}</style></head><body><header><h1>Site</h1></header>"
        f"<nav><ul><li><a href=/x>{words(i + 1, 2)}</a></ul></nav><div class='cookie-notice'>We use cookies {i}</div><main><article><header><h1>{head}</h1></header><div class=ad>{words(i, 5)}</div>{body}"
        f"<form><input name=q>search</form><section class=comments><article><p>I say {words(i, 4)}</p></article></section><div>Send this page to a friend</div></article></main>"
        f"<aside>{words(i + 3, 9)}</aside><footer>&copy; {words(i, 3)}</footer></body></html>"
    )


def plain(i, blocks):
    """No marks at all: only other pages tell menu and small print from the text."""
    head, *rest = blocks
    links = "".join(f"<a href='/{j}'>{words(i + j, 2)}</a> " for j in range(4))
    body = "".join(f"<p>{b}</p>" for b in rest)
    return f"<body><div>Welcome to the paper of record</div><div>{links}</div><div><h1>{head}</h1>{body}<p>{words(i, 30)}</p></div><div>All rights with the publisher of this paper</div></body>"


def test_pages_with_marks_and_without(spark, tmp_path):
    rows, want = [], {}
    for i in range(12):
        blocks = article(i)
        rows.append((i, f"http://marks.test/{i}", semantic(i, blocks), "text", 0))
        want[i] = "\n".join(blocks)
        rows.append((100 + i, f"https://plain.test/{i}?q#f", plain(i, blocks), "text", 0))
        want[100 + i] = "\n".join([*blocks, words(i, 30)])
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = op11_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert {k: r.text for k, r in found.items()} == want
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_result_is_the_same_however_trees_are_merged(spark, monkeypatch):
    rows = [(i, "http://a.test/", plain(i, article(i)) if i % 3 else semantic(i, article(i))) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(map(tuple, wrapper.extract(df.coalesce(1)).collect()))
    monkeypatch.setattr(wrapper, "FAN", 2)
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wrapper.extract(df.repartition(13)).collect())) == one


def test_copies_and_repeated_lines_stay(spark):
    """Equal articles are no template, nor is a line that many articles share."""
    rows = [(i, "http://a.test/", f"<body><article><h1>One</h1><p>The same text</p></article>") for i in range(9)]
    rows += [(20 + i, "http://b.test/", f"<body><article><h1>{words(i, 3)}</h1><p>Under the license</p><p>{words(i, 9)}</p></article>") for i in range(9)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One\nThe same text" for i in range(9))
    assert all(got[20 + i] == f"{words(i, 3)}\nUnder the license\n{words(i, 9)}" for i in range(9))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("just words &amp; more &lt;b&gt;", "just words & more <b>"),
        ("<article><p>a<br>b &eacute;&#233;&#xe9; &copy 1&nbsp;2</p>tail <b>bold<i>er</b> end</article>", "a b ééé © 1 2\ntail bolder end"),
        ("<article><p>one<p>two<ul><li>three<li>four</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\nthree\nfour\na b\nc"),
        ("<article><p>in <span class='ad'>buy</span> text <span hidden>x</span></p><p style='display: none'>gone</p></article>", "in text"),
        ("<div class='with-sidebar'><div class=sidebar>s</div><article>body</article></div>", "body"),
        ("<div class=sidebar><article>body</article></div>", "body"),
        ("<main><h1>t</h1><p>b</p></main><p>out</p>", "t\nb"),
        ("<div id=main-nav>menu</div><div class='entry-header'><h1>t</h1></div><p>b</p><div class='post-footer'>by x</div><div class=commentContent>c</div><div class='site-header'>s</div>", "t\nb"),
        ("<article><![foo[x]]><!-- c --><p>a <!-- d -->b</p><script>if (a<b) '</article>'</script></article>", "a b"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>", "deep\nafter"),
    ],
)
def test_single_pages(html, text):
    assert wrapper.main_text(html, None) == text


def test_a_very_long_page():
    many = [f"line {i}" for i in range(60_000)]
    html = "<article>" + "".join(f"<p>{x}</p>" for x in many) + "<p>" + "w " * 500_000 + "</p></article>"
    assert wrapper.main_text(html, None) == "\n".join(many) + "\n" + "w " * 499_999 + "w"


def test_nulls_repeated_rows_and_no_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, "<article>a</article>"), (None, "nowhere", "<p>b</p>"), (2, "http://a.test", None)] + [(3, "http://a.test", "<p>c</p>")] * 3
    got = sorted((str(r.page_id), r.text) for r in wrapper.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "a"), ("2", ""), ("3", "c"), ("3", "c"), ("3", "c"), ("None", "b")]
    assert wrapper.extract(spark.createDataFrame([], schema)).count() == 0


def test_matching_counts_nodes():
    tree = lambda s, *kids: [s, s, 1, 0, 0, 0, 0, list(kids)]
    a = tree("r", tree("x", tree("b"), tree("c")), tree("y"), tree("x", tree("d")))
    b = tree("r", tree("y"), tree("x", tree("d"), tree("e")), tree("z"))
    assert wrapper.matching(a, b, {}) == (4, [(1, 0), (2, 1)])
    assert [k[0] for k in wrapper.merged(a, b, {})[7]] == ["x", "y", "x", "z"]

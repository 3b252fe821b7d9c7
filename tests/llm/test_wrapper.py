"""Wrapper induction decides the text: pages whose markup says nothing, deep and odd markup, awkward rows."""

import random

import pytest

from tessera.llm import wrapper

WORDS = "amber birch cedar delta ember fjord grove heath inlet jolly knoll larch maple north ocean prism quill ridge stone tulip".split()


def _prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def _page(rnd, host, layout, short=False):
    """A page without article or telling names: bar, links, teaser that varies, content, foot; and its text."""
    title = _prose(rnd, 4)
    paragraphs = [_prose(rnd, rnd.randint(3, 6) if short else rnd.randint(15, 50)) for _ in range(1 if short else rnd.randint(2, 6))]
    bar = f"<div class='x1'><a href='/'>{host} home</a> Weather and trains</div>"
    links = "<div class='x2'>" + "".join(f"<a href='/{i}'>{_prose(rnd, 3)}</a>" for i in range(5)) + "</div>"
    teaser = f"<div class='x3'>{_prose(rnd, 6)}</div>"
    body = f"<h1>{title}</h1><div class='x4'>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
    foot = f"<div class='x5'><p>All rights reserved by {host}</p></div>"
    parts = [bar, links, body, teaser, foot] if layout else [bar, body, foot]
    return f"<html><body>{''.join(parts)}</body></html>", "\n".join([title, *paragraphs])


def _pages(n, seed=1):
    rnd, rows, texts = random.Random(seed), [], {}
    for k in range(n):
        host = f"h{k % 3}.example"
        html, text = _page(rnd, host, k % 2, short=k % 7 == 0)
        rows.append((k, f"http://{host}/{k}", html))
        texts[k] = text
    return rows, texts


def test_the_wrapper_decides(spark):
    rows, texts = _pages(150)
    out = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == texts
    alone = {k: wrapper.main_text(wrapper.parse(html)) for k, _, html in rows}
    assert sum(alone[k] == texts[k] for k in texts) == 0


def test_an_article_is_kept_whole(spark):
    rnd, rows, texts = random.Random(2), [], {}
    for k in range(40):
        title, long, last = _prose(rnd, 4), _prose(rnd, 80), _prose(rnd, 3)
        rows.append((k, "http://a.example/", f"<body><p>Same on all pages</p><article><h1>{title}</h1><div><p>{long}</p></div><p>{last}</p></article><div>{_prose(rnd, 5)}</div></body>"))
        texts[k] = f"{title}\n{long}\n{last}"
    out = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == texts


@pytest.mark.parametrize("name", ["market-share", "related-work", "search-engine", "header-text", "navigate", "adsorption", "commentary", "social"])
def test_names_of_content_inside_an_article(name):
    assert wrapper.main_text(wrapper.parse(f"<article><p>a</p><section class='{name}'><p id='{name}'>b</p></section></article>")) == "a\nb"


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "ads", "ad-slot", "newsletter-signup", "x share-buttons", "disqus_thread"])
def test_names_of_parts_that_are_no_content(name):
    assert wrapper.main_text(wrapper.parse(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>")) == "a"


@pytest.mark.parametrize("tag", ["nav", "div", "b", "ul><li"])
def test_any_depth(spark, tag):
    html = f"<{tag}>" * 1500 + "deep" + f"</{tag.split('>')[0]}>" * 1500 + "<p>last</p>"
    rows = [(k, "http://deep.example/", f"<p>page {k}</p>{html}") for k in range(4)]
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 4 and all(r["text"].startswith(f"page {r['page_id']}") for r in out)


def _plain(a, b):
    """Simple tree matching as it is defined."""
    if a.tag != b.tag:
        return 0
    p, q = a.kids, b.kids
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(q):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + _plain(x, y))
    return 1 + best[-1][-1]


def test_matching_of_random_trees_is_the_largest():
    rnd = random.Random(4)

    def tree(depth):
        node = wrapper.Node(rnd.choice("abc") if depth < 4 else "a")
        for _ in range(rnd.randint(0, 3) if depth else 0):
            node.add(tree(depth - 1))
        return node

    for _ in range(300):
        a, b = tree(4), tree(4)
        found = wrapper.match(a, b)
        assert len(found) == _plain(a, b) and all(x.tag == y.tag for x, y in found)
        again = wrapper._load(wrapper._dump(a))
        assert [n.tag for n in wrapper.preorder(again)] == [n.tag for n in wrapper.preorder(a)] and _plain(again, a) == len(wrapper.preorder(a))


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x.example/", "<p>no id</p>"), (3, "http://x.example/", "<p>a &amp; b &#233;</p>"), (3, "http://x.example/", "<p>a &amp; b &#233;</p>"), (4, "nonsense", "a < b"), (5, "http://x.example/", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in wrapper.extract(df).collect())
    assert out == sorted([("1", "", 0), ("2", "", 0), ("None", "no id", 5), ("3", "a & b é", 7), ("3", "a & b é", 7), ("4", "a < b", 5), ("5", ("word " * 100_000).strip(), 499_999)])
    assert wrapper.extract(df.limit(0)).count() == 0


def _layouts():
    """Six ways to hang readers' comments beside a text; classes say nothing in the last four."""
    entry = {
        "articles after it": ("</article>{c}", "<article class='comment'><b>{a}</b><time>{d}</time><p>{t}</p></article>", ""),
        "articles inside it": ("{c}</article>", "<article class='comment-body'><b>{a}</b><p>{t}</p></article>", ""),
        "divs": ("<div class='k1'>{c}</div></article>", "<div class='k2'><b>{a}</b> <span>{d}</span><p>{t}</p></div>", ""),
        "list": ("<ol>{c}</ol></article>", "<li><cite>{a}</cite><p>{t}</p><a href='#'>Reply</a></li>", ""),
        "pictures": ("<section><h3>Voices</h3>{c}</section></article>", "<div><img src='a.png'><div><strong>{a}</strong></div><div>{t}</div></div>", ""),
        "no article": ("{c}", "<div><b>{a}</b><em>{d}</em><p>{t}</p></div>", "plain"),
    }
    return entry


def _commented(layout, k):
    """A page with a text of its own and two to four comments."""
    end, form, plain = _layouts()[layout]
    text = [f"Paragraph {j} of page {k} tells what happened to number {k * 7 + j} on that long day." for j in range(3 + k % 3)]
    body = f"<h1>Title {k}</h1>" + "".join(f"<p>{t}</p>" for t in text) + f"<ul><li><strong>Term{k}</strong> {k} meant something</li><li><strong>Other{k}</strong> {k} did not</li></ul>"
    said = "".join(form.format(a=f"Reader{k}{j}", d=f"{j} days ago", t=f"I think that {k} and {j} were quite wrong about it, and I shall say so every time.") for j in range(2 + k % 3))
    html = f"<html><body><div>Menu of the site</div><div id='c{k}'>{body}</div><div>{said}</div></body></html>" if plain else f"<html><body><article>{body}{end.format(c=said)}</body></html>"
    lines = [f"Title {k}", *text, f"Term{k} {k} meant something", f"Other{k} {k} did not"]
    return html, "\n".join((["Menu of the site"] if plain else []) + lines)


@pytest.mark.parametrize("layout", list(_layouts()))
def test_comments_go_by_structure(spark, layout):
    pages = [(k, f"http://{layout.replace(' ', '-')}.example/{k}", *_commented(layout, k)) for k in range(7)]
    for _, _, html, want in pages:
        assert wrapper.main_text(wrapper.parse(html)) == want
    got = wrapper.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()
    want = {p[0]: p[3].removeprefix("Menu of the site\n") for p in pages}  # the wrapper knows the menu as template
    assert {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>One</p><section><div><h2>A</h2><p>text</p></div><div><h2>B</h2><p>more</p></div></section></article>", "One\nA\ntext\nB\nmore"),
        ("<article><p>One</p><ul><li><b>x</b> <p>long</p></li><li><b>y</b> <p>more</p></li></ul></article>", "One\nx\nlong\ny\nmore"),
        ("<article><div><div><b>Q</b><i>1</i><p>first</p></div><div><b>A</b><i>2</i><p>second</p></div></div></article>", "Q1\nfirst\nA2\nsecond"),
        ("<article class='comments'><p>All there is</p></article>", "All there is"),
        ("<main><h1>T</h1><article><p>text of it</p></article><article><p>x</p></article></main>", "T\ntext of it"),
    ],
)
def test_what_is_no_list_of_comments_stays(html, text):
    assert wrapper.main_text(wrapper.parse(html)) == text

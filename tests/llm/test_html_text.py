from collections import Counter

import pytest

from granary.llm import html_text
from granary.llm.html_text import digest, articles_of, extract, main_text, parse, places, removable, subtrees, templates

NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just  text\n here", "just text here"),
        ("<html><head><title>T</title><style>p{}</style></head><body><script>var t='</p>';</script><p>a &amp; b &eacute;&#233;&#x41;</p>", "a & b ééA"),
        (f"<body>{NAV}<article><h1>Head</h1><p>One<br>two <b>bold</b>.<p>Next</article><footer>f</footer>", "Head\nOne two bold.\nNext"),
        ("<p><b>open<br><p>two</p>", "open\ntwo"),
        ('<div class="side sidebar">x</div><div id="comments"><p>y</div><main><p>z</p><form>q</form></main>', "z"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside></article><article class='comment'><p>long comment long comment long comment</p></article>", "T\nx"),
        ("<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "1\n2\na\nb\nc"),
        ("<p>unclosed <i>tag", "unclosed tag"),
        ("a < b and c<!-- comment <p> -->d", "a < b and cd"),
        ('<p title="a > b">x</p></div></p>', "x"),
        ("<main><div class='related'>r</div><p>m</p></main>", "m"),
        ("<p>one&nbsp;&nbsp;two</p><pre>  a\n  b </pre>", "one two\na b"),
    ],
)
def test_blocks(page, text):
    assert extract(page, set()) == text


def test_equal_subtrees_have_equal_hashes():
    a, b = ({h: p for h, p, _ in subtrees(f"<body>{NAV}<article><p>{x}</p></article>")} for x in ("one", "two"))
    shared = set(a) & set(b)
    assert shared and all(a[h] == b[h] for h in shared if a[h] in shared)


def site(spark):
    """A site without any telling names: templates are found only because they recur; a copied article and a shared paragraph are not."""
    copy = "<div><p>Copied article text.</p><p>Its end.</p></div>"
    top = "<div><span>Site name</span><span>Log on</span></div>"
    end = "<section>Follow us everywhere</section>"
    rows = []
    for i in range(30):
        body = copy if i % 3 == 0 else f"<div><p>Article number {i} says this.</p><p>Own end {i}</p></div>"
        rows.append((i, f"https://www.x.example/{i}", f"<html><body>{top}{body}{end}</body></html>"))
    rows += [(100 + i, f"http://y.example:80/{i}", f"<body>{NAV}<article><h1>H{i}</h1><p>shared paragraph</p><div>Rate this page</div><p>own {i}</p></article>") for i in range(12)]
    rows += [(200, None, f"<body>{top}<p>no host</p>"), (201, "http://z.example/", None), (202, "http://z.example/", ""), (203, "not a url", f"{top}<p>x</p>")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int").repartition(3)


def want(i):
    if i < 30:
        return "Copied article text.\nIts end." if i % 3 == 0 else f"Article number {i} says this.\nOwn end {i}"
    if i < 200:
        return f"H{i - 100}\nshared paragraph\nown {i - 100}"
    return {200: "Site nameLog on\nno host", 201: "", 202: "", 203: "Site nameLog on\nx"}[i]


@pytest.mark.parametrize("rows", [0, 500_000])
def test_templates_go_and_copies_stay(spark, rows, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", rows)
    pages = site(spark)
    got = main_text(pages).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r.page_id, r.url) for r in pages.collect())
    for r in got:
        assert r.text == want(r.page_id), r.page_id
        assert r.n_chars == len(r.text)


def test_repeated_and_empty(spark):
    pages = site(spark)
    assert Counter(r.text for r in main_text(pages.union(pages)).collect()) == Counter([want(r.page_id) for r in pages.collect()] * 2)
    assert main_text(pages.filter("false")).collect() == []


def texts(spark, pages):
    rows = [(i, f"https://h.example/{i}", page) for i, page in enumerate(pages)]
    return [r.text for r in sorted(main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect(), key=lambda r: r.page_id)]


def test_inline_repeats_stay(spark):
    """A word set off in several paragraphs of one page, or of several pages, is part of its sentences, with an article element and without."""
    one = "<article>" + "".join(f"<p>Number {i} of <em>x</em> and <a href='/k'>a link</a>.</p>" for i in range(4)) + "</article>"
    assert texts(spark, [one]) == ["\n".join(f"Number {i} of x and a link." for i in range(4))]
    for a, b in (("<p>", "</p>"), ("<div>", "</div>")):
        assert texts(spark, [f"<body>{a}Page {i} says <b>so</b> again.{b}</body>" for i in range(5)]) == [f"Page {i} says so again." for i in range(5)]


def test_repeats_within_a_page_are_one_page(spark):
    page = "<body>" + "".join(f"<div><p>Same.</p><p>Own {i}</p></div>" for i in range(4)) + "</body>"
    assert texts(spark, [page] * 2) == ["\n".join(f"Same.\nOwn {i}" for i in range(4))] * 2


def test_near_copies_without_article_stay(spark):
    """Three near copies keep what they share, beside a bar that all pages of the host have."""
    shared = [f"Paragraph {k} of the text that was copied, with one other changed." for k in range(4)]
    near = [[*shared, f"The changed one {i}."] for i in range(3)]
    page = lambda ps: "<body>" + "".join(f"<p>{p}</p>" for p in ps) + "</body>"
    assert texts(spark, [page(ps) for ps in near]) == ["\n".join(ps) for ps in near]
    bar = "<div><a href='/'>Start</a><a href='/n'>News</a></div>"
    other = [[f"Another text {i}, " + f"of its own {i} " * 9] for i in range(12)]
    got = texts(spark, [page(ps).replace("<body>", f"<body>{bar}") for ps in near + other])
    assert got == ["\n".join(p.strip() for p in ps) for ps in near + other]


def test_menu_of_a_section_on_a_large_host(spark):
    """A menu on 12 pages goes on a host of 1,500 pages as it does on a small one."""
    menu = "<div>Section menu</div>"
    pages = [f"<body>{menu if i < 12 else ''}<div>Text {i} is its own.</div></body>" for i in range(1500)]
    assert texts(spark, pages) == [f"Text {i} is its own." for i in range(1500)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><article><p>One <svg width='1'/>two <math/>three.</p></article>", "One two three."),
        ("<body><iframe src='/x'/><script src='a.js'/><article><p>One.</p></article><script>x</script></body>", "One."),
        ("<body><div><script>var x = 1;</div><article><p>One.</p></article></body>", "One."),
        ("<body><textarea/><p>One.</p><textarea>q</textarea></body>", "One."),
        ("<body><script src=/js/>no</script><p>One.</p></body>", "One."),
        ("<body><div class='has-sidebar'><div class='sidebar'>x</div><article><p>The text.</p></article></div></body>", "The text."),
        ("<body><form id='form1'><div class='with-search'><p>The text.</p></div></form></body>", "The text."),
        ("<main><article><div class='no-sidebar'><p>The text.</p></div></article></main>", "The text."),
        ("<main><article><p>First of two.</p></article><article><p>The second.</p></article></main>", "First of two.\nThe second."),
        ("<article><p>First.</p></article><article class='comment'><p>A remark.</p></article><article><p>The second one.</p></article>", "First.\nThe second one."),
        ("<article><p>x</p><div class='comments'><p>A long remark, longer than it.</p></div></article>", "x"),
        ("<nav>" + "<a>link</a>" * 9 + "</nav><div class='related'>r</div><p>text</p>", "text"),
    ],
)
def test_articles_are_whole(page, text):
    assert extract(page, set()) == text


def test_notice_inside_of_articles(spark):
    """An unhinted notice in the articles of all pages of a host goes; what near copies share stays, and so does a paragraph on a few pages."""
    notice = "<p>Subscribe to our letter today.</p>"
    pages = [f"<article><h1>Head {i}</h1><p>Article {i} says a good deal, and all of it its own: {i * 7} and {i * 9}.</p>{'<p>A shared quotation.</p>' if i < 4 else ''}{notice}</article>" for i in range(12)]
    want = [f"Head {i}\nArticle {i} says a good deal, and all of it its own: {i * 7} and {i * 9}." + ("\nA shared quotation." if i < 4 else "") for i in range(12)]
    assert texts(spark, pages) == want
    shared = "".join(f"<p>Paragraph {k} of the copied text, which is long.</p>" for k in range(4))
    near = [f"<article>{shared}<p>The changed one {i}.</p></article>" for i in range(12)]
    assert texts(spark, near) == ["\n".join([*(f"Paragraph {k} of the copied text, which is long." for k in range(4)), f"The changed one {i}."]) for i in range(12)]


def test_a_small_article_element_is_not_the_article(spark):
    page = "<body><div><article><p>A card.</p></article></div><div><p>The long text of the page, which stands outside of it.</p></div></body>"
    assert extract(page, set()) == "A card.\nThe long text of the page, which stands outside of it."


def brute_templates(pages):
    """host, hash of what templates() is to find, counted page by page; for sites without near copies."""
    by, sizes = {}, {}
    for host, page in set(pages):
        nodes = digest(parse(page))
        sizes[host] = sizes.get(host, 0) + 1
        for node, h, prose in removable(nodes, articles_of(nodes)).values():
            by.setdefault((host, h, prose), {}).setdefault(page, []).append(node.parent.digest)
        articles = articles_of(nodes)
        if 2 * sum(x.size for x in articles) >= nodes[0].size:
            ids = {id(x): x for x in nodes}
            for k, h in places(nodes, articles).items():
                by.setdefault((host, h, True), {}).setdefault(page, []).append(ids[k].digest)
    out = set()
    for (host, h, prose), on in by.items():
        n, total = len(on), sizes[host]
        signed = [[x - (1 << 64) if x >> 63 else x for x in parents] for parents in on.values()]
        apart = max(len({f(p) for p in signed}) for f in (min, max))
        common = total >= 10 and 2 * n >= total
        if apart >= 3 and n >= min(0.01 * total, 10) and (common or not prose):
            out.add((host, h))
    return out


def test_templates_against_a_count_by_hand(spark):
    host = lambda u: (u or "").split("/")[2] if "//" in (u or "") else ""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    pages = [(host(r.url), r.html) for r in rows]
    got = {(r.host, r.hash) for r in templates(spark.createDataFrame(pages, "host string, html string").repartition(3)).collect()}
    assert got and got == brute_templates(pages)


def test_template_of_the_registered_pages(spark):
    """Recurring subtrees are taken out of pages of the table before their article is looked for, and no word of the articles is lost."""
    import re

    from granary.llm.queries import op7_site_templates

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op7_site_templates(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sum(got[r.page_id].n_template > 0 for r in pages) > 0
    for r in pages:
        own = extract("".join(re.findall(r"<article>.*</article>", r.html, re.S)), set())
        assert got[r.page_id].text == own


def test_a_longer_advert_beside_a_short_article():
    page = "<body><div class='ad'>" + "buy this now " * 20 + "</div><article><h1>Short</h1><p>Few words.</p></article></body>"
    assert extract(page, set()) == "Short\nFew words."
    around = "<body><div class='has-sidebar'><article><p>" + "words of it " * 20 + "</p></article></div></body>"
    assert extract(around, set()).startswith("words of it")
    remark = "<body><div class='promo'>" + "the page itself " * 20 + "</div><div class='comments'><article>first!</article></div></body>"
    assert extract(remark, set()).startswith("the page itself")


def test_places_beside_articles_are_template_whatever_they_hold(spark):
    """Boxes without telling names, never twice the same, are told by their place in the layout of a host; where articles are only the heads of pages what stands beside them stays."""
    words = lambda k, n: " ".join(f"w{(k * 7919 + i * 104729) % 997}" for i in range(n))
    page = lambda k, n: f"<body><div class='x1'>{words(k, 12)}</div><article><h1>t{k}</h1><p>{words(k + 500, n)}</p></article></body>"
    rows = [(k, f"https://a.example/{k}", page(k, 4 if k == 3 else 60)) for k in range(20)]
    head = lambda k: f"<body><article><h1>t{k}</h1></article><div class='x1'>{words(k, 60)}</div></body>"
    rows += [(100 + k, f"https://b.example/{k}", head(k)) for k in range(20)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"t{k}\n{words(k + 500, 4 if k == 3 else 60)}" for k in range(20))
    assert all(words(k, 60) in got[100 + k] for k in range(20))


def test_no_page_holds_its_advert(spark):
    import re

    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    adverts = {r.page_id: re.findall(r'<div class="ad">(.*?)</div>', r.html or "", re.S) for r in pages.collect()}
    plain = lambda t: " ".join(t.split())
    heads = {r.page_id: {plain(h) for h in re.findall("<h1>(.*?)</h1>", r.html or "", re.S)} for r in pages.collect()}  # a few articles have the advert's words for their heading
    held = [i for i, own in adverts.items() for a in own if plain(a) and plain(a) not in heads[i] and plain(got[i]).startswith(plain(a))]
    assert sum(map(len, adverts.values())) > 100 and held == []

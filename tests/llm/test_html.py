import pytest

from tillwright.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x > y --><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p><b>One  two<br><p>Three\n four &lt;x&gt;</p><ul><li>item</li></ul><form>send</form><div class="comments"><p>nice!</p></div></article>
<footer>&copy; site</footer></body></html>"""


def text(html, near=()):
    page = h.lines(html)
    mine, others = h.measured(page), [h.measured(h.lines(x)) for x in near]
    return h.main_text(h.candidates(page), h.places(h.deleted(mine, [x for x in others if x != mine]), mine[1]))


def test_article_is_kept_whole():
    assert text(PAGE) == "Head & line\n\nOne two\n\nThree four <x>\n\nitem"
    assert text(PAGE, [PAGE, PAGE.replace("item", "other")]) == text(PAGE)
    assert text(PAGE[: PAGE.index("</article>")]) == text(PAGE)


def test_shared_lines_of_unmarked_pages_go():
    a = "<div>Menu</div><div>Story of a</div><p>Same words</p><div>Imprint</div>"
    b = "<div>Menu</div><div>Story of b</div><div>Imprint</div>"
    assert text(a, [b]) == "Story of a\n\nSame words" and text(a) == "Menu\n\nStory of a\n\nSame words\n\nImprint"
    assert text(a, [a]) == text(a)  # a copy says nothing about the frame


def test_difference_decides_inside_and_outside_of_landmarks():
    def page(x, n=2):
        return f"<div>Menu</div><article><h2>Teaser {x}</h2><p>Follow us</p><p>a {x}<p>" + "<p>".join(f"{x} {i}" for i in range(n)) + f"<p>Quoted<p>more {x}<p>end {x}<p>Read on</p></article><div>Story of {x}</div><div>Imprint</div>"

    near = [page("b", 3), page("c", 5)]
    assert text(page("a"), near) == "Teaser a\n\na a\n\na 0\n\na 1\n\nmore a\n\nend a\n\nStory of a"
    assert text(page("a"), near[:1]) == "Teaser a\n\nFollow us\n\na a\n\na 0\n\na 1\n\nQuoted\n\nmore a\n\nend a\n\nRead on\n\nStory of a"
    moved = [x.replace("<p>Quoted", "").replace("<article>", "<article><p>Quoted") for x in near]
    assert "Quoted" in text(page("a"), moved)  # a quotation stands anywhere
    versions = [page("a").replace("end a", f"end {i}") for i in range(2)]
    assert "a 1" in text(page("a"), versions)  # as versions of a page say nothing about its frame


def test_article_text_under_a_frame_word_stays():
    own = ['<section id="discussion"><p>one</p></section>', '<h2 id="related-work">two</h2>', '<h2 id="how-to-register">three</h2>', '<h3 class="notice">four</h3>', '<p class="notice-of-motion">five</p>', '<div class="side-by-side">six</div>', '<figure class="social-history">seven</figure>', '<p>eight <a class="related">nine</a></p>']
    want = "one\n\ntwo\n\nthree\n\nfour\n\nfive\n\nsix\n\nseven\n\neight nine"
    assert text(f"<article>{''.join(own)}<div class='x share'>gone</div></article>") == want
    assert text("".join(own) + "<div class='site-footer'>gone</div><p class='ad'>gone") == want
    # omitted end tags
    assert text("<div class='notice'>gone<p>gone</div><p>stays") == "stays"
    for before in ("", "<main>"):
        assert text(before + "<p style='display:none'>gone<p>a<h2>b</h2><ul><li aria-hidden=true>gone<li>c<ul><li>d</ul><li>e</ul>") == "a\n\nb\n\nc\n\nd\n\ne"
        assert text(before + "<dl><dt aria-hidden=true>gone<dd>f</dl><table><tr><td aria-hidden=true>gone<td>g<tr aria-hidden=true><td>gone<tr><td>h</table>") == "f\n\ng\n\nh"
        assert text(before + "<div><p aria-hidden=true>gone</div>i") == "i"


@pytest.mark.parametrize("html", [None, "", "plain words", "<", "a < b", "<p", "<p title='x>", "&amp", "<script>x", "</p></div>", "<p>" * 3000 + "deep", "x" * 100_000])
def test_odd_input(html):
    assert isinstance(text(html), str)
    if html == "plain words":
        assert text(html) == "plain words"


def test_alignment_is_a_common_subsequence():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = sorted(h.shared(a, b))
        it = iter(b)
        assert all(a[i] in it for i in got)
    assert h.shared(list("xaybz"), list("aqb")) == {1, 3}


def test_alignment_is_a_longest_one(monkeypatch):
    import itertools

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    words = [list(w) for n in range(5) for w in itertools.product("pq", repeat=n)] + [list(w) for w in itertools.product("pqr", repeat=4)]
    for kept in (h.KEPT_BITS, 3):
        monkeypatch.setattr(h, "KEPT_BITS", kept)
        for a, b in itertools.product(words, words):
            got = sorted(h.shared(a, b))
            rest = iter(b)
            assert len(got) == longest(a, b) and all(a[i] in rest for i in got)
    assert len(h.shared(list("pqp"), list("qp"))) == 2
    monkeypatch.setattr(h, "KEPT_BITS", 100_000)
    a, b = [f"{i % 97}" for i in range(3000)], [f"{i % 89}" for i in range(2900)]
    assert len(h.shared(a, b)) == longest(a, b)


def test_hidden_blocks_go():
    for around in ("", "<article>"):
        assert text(around + "<p hidden>gone<p>a<div hidden=''><p>gone</div><p data-hidden=x title='so hidden'>b<p class='hidden-gem'>c") == "a\n\nb\n\nc"


def test_frames_inside_and_outside_of_an_article():
    gone = ['<div id="comments"><p>x</div>', '<ul class="comment-list"><li>x</ul>', '<div class="reader-comments">x</div>', '<div class="ad-slot">x</div>', '<section class="related-posts"><p>x</section>', '<div class="share-buttons">x</div>', '<div class="cookie-notice">x</div>', '<p class="ad">x</p>', '<div class="box notice">x</div>']
    own = ['<section class="discussion"><p>one</p></section>', '<div class="alert">two</div>', '<table class="side"><tr><td>three</table>', '<p>four <span class="advert">x</span>and <b>more</b>', '<section id="related-work">five</section>', '<div class="table-side">six</div>']
    want = ["one", "two", "three", "four and more", "five", "six"]
    assert text("<article>" + "".join(a + b for a, b in zip([*own, "", "", ""], gone)) + "</article>") == "\n\n".join(want)
    outside = ['<div class="search-results"><p>one</div>', '<section class="social history"><p>two</section>', '<div id="main-side">three</div>', "<div class='sidereal'>four</div>"]
    assert text("".join(outside) + "<div class='side'>x</div><div id='search-box'>x</div><div class=banner>x</div>") == "one\n\ntwo\n\nthree\n\nfour"


def test_menus_with_words_of_their_own_are_shared_by_place():
    def page(words, story):
        return f"<div><ul>{''.join(f'<li><a href=/{w}>{w}</a>' for w in words.split())}</ul></div><p>{story}</p><ul><li>a point of {story}</ul><p><a href=x>{story} to read</a></p>"

    assert text(page("a b c", "one"), [page("d e f g", "two")]) == "one\n\na point of one\n\none to read"
    assert text(page("a b c", "one"), [page("d", "two")]).count("\n\n") == 4  # one place of the menu is shared, two links are left


def test_difference_comes_before_elements():
    a, b = (h.lines(f"<nav><li>{w}</nav><article><p>{w}</article><footer>{w}</footer>") for w in "ab")
    assert h.deleted(h.measured(a), [h.measured(b)]) == [0, 2] and h.deleted(h.measured(a), []) == []
    assert h.candidates(a) == ["a"] and h.places([0, 2], [-1, 1, -1]) == [] and h.places([0, 1], [-1, 0, 1]) == [0]


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_extract_against_a_plain_version(spark, parts):
    """Pages made from lists of lines, whose shared ones stand in one order, so that the longest common subsequence is
    what both have. The plain version reads the lists, not the html."""
    import random

    rng = random.Random(4)
    pool = [f"line {i}" for i in range(9)]
    rows, made = [], {}
    for i in range(150):
        before, inside, after = (sorted(rng.sample(part, rng.randint(0, 3))) + [f"own {i} {n}"] * (rng.random() < 0.6) for n, part in enumerate((pool[:3], pool[3:6], pool[6:])))
        has = i % 3 > 0
        page = tuple([(0, x) for x in before] + ([(1, x) for x in inside] if has else [(0, x) for x in inside]) + [(0, x) for x in after])
        if i % 10 == 9:
            page = made[i - 5]  # a copy, elsewhere on some host
        made[i] = page
        tag = lambda k: "".join(f"<p>{x}</p>" for kind, x in page if kind == k)
        cut = next((n for n, (kind, _) in enumerate(page) if kind == 1), None)
        flat = lambda part: "".join(f"<p>{x}</p>" for _, x in part)
        html = flat(page) if cut is None else flat(page[:cut]) + "<article>" + tag(1) + "</article>" + flat([x for x in page[cut:] if x[0] == 0])
        rows.append((i if i % 13 else None, f"https://h{i % 4}.example/{rng.randint(0, 9)}/{i}", html + f"<!-- {rng.randint(0, 2)} -->"))
    contents = {}
    for (key, url, _), page in zip(rows, made.values()):
        host, path = url.split("/")[2], "/" + "/".join(url.split("/")[3:])
        at = (path, key is not None, key or 0)
        contents[host, page] = min(contents.get((host, page), at), at)
    want = {}
    for (host, page), at in contents.items():
        order = sorted((v, p) for (h_, p), v in contents.items() if h_ == host)
        k = order.index((at, page))
        near = [order[j][1] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        size = sum(len(x) for kind, x in page if kind)
        template = len(near) == 2 and not any(2 * sum(len(x) for kind, x in page if kind and (1, x) in other) > size for other in near)
        inner = [x for kind, x in page if kind]
        kept = []
        for kind, x in page:
            if kind == 0 and any((0, x) in other for other in near):
                continue
            if kind and template and all((1, x) in other for other in near):
                n = inner.index(x)
                lists = [[y for k2, y in other if k2] for other in near]
                if any(all(-len(c) <= j < len(c) and c[j] == x for c in lists) for j in (n, n - len(inner))):
                    continue
            kept.append(x)
        want[host, page] = "\n\n".join(kept)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.url: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {url: want[url.split("/")[2], page] for (_, url, _), page in zip(rows, made.values())}
    assert sum(text != "\n\n".join(x for _, x in page) for text, page in zip(got.values(), made.values())) > 75  # the neighbours decide


def test_equal_pages_of_a_host_get_equal_texts(spark):
    same = "<div>Menu</div><div>Imprint</div><p>copy"
    rows = [(i, f"https://h.example/{i}", same) for i in range(3)] + [(3, "https://h.example/3", "<div>Menu</div><p>other</p><div>Imprint</div>"), (9, "https://lone.example/", same)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "copy", 1: "copy", 2: "copy", 3: "other", 9: "Menu\n\nImprint\n\ncopy"}


def test_pages(spark):
    rows = [(i, f"https://h{i % 2}.example/{i:03}", f"<div>Menu {i % 2}</div><p>body of {i}</p>") for i in range(20)] + [(50, None, None), (51, "not a url", ""), (None, "https://h0.example/000?x", PAGE), (3, "https://h1.example/003", "<div>Menu 1</div><p>body of 3</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "text"):
        df = df.withColumn(c, df.url)
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = h.extract(df).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        if parts == "1":
            assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 50} == {i: f"body of {i}" for i in range(20)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert h.extract(df.filter("false")).count() == 0


def test_texts_do_not_depend_on_the_partitions(spark):
    rows = [(i if i % 7 else None, f"https://h{i // 15}.example/{i:03}", f"<div>Menu {i // 15}</div><article><p>Byline<p>a {i}<p>b {i}<p>c {i}</article><div>Imprint</div>") for i in range(60)]
    rows += [rows[3], rows[20], (90, None, None), (91, None, "<p>x"), (92, "not a url", "<p>x<p>y"), (93, "https://lone.example/ü", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    try:
        for parts in (1, 2, 3, 7, 30, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got[parts] = sorted(map(tuple, h.extract(df.repartition(1 + parts % 5)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got[1]) == len(rows) and all(x == got[1] for x in got.values())
    assert sum("Menu" in r[2] for r in got[1]) == 0
    assert sum("Byline" in r[2] for r in got[1]) == 8  # the first and last of a host

import random
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from logloom.llm import language, templates, urlfilter

PAGE = """<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>T &amp; U &lt;x&gt;</h1></header><p><b>One<br>two   three.<p>Four &eacute;</p><ul><li>x<li>y</ul>
<div class="comments"><p>first!</p></div><form><p>mail</p></form></article><aside>side</aside><footer>&copy; z</footer></body></html>"""
WANT = "T & U <x>\n\nOne two three.\n\nFour é\n\nx\n\ny"


def test_main_text():
    assert templates.main_text(PAGE) == WANT
    assert templates.main_text("") == ""
    assert templates.main_text("<p>no frame") == "no frame"
    assert templates.main_text("<article><p>cut <a hre") == "cut"
    assert templates.main_text("<article>a<!-- <p>b</p> -->c</article>") == "ac"


def test_kinds_of_containers():
    # The title of an article is no page header; adverts and share links amid text go with all they contain.
    assert templates.main_text('<article><div class="post-header"><h1>T</h1></div><div><header>U</header></div><p>a <span class="advert">Buy <span>it</span> now</span>b<a class="share">Share</a></p><div class="comments">c</div></article>') == "T\n\nU\n\na b"
    assert templates.main_text('<div class="site-header">S</div><div class="entry-header">T</div><div class="w-1/2">t</div>') == "T\n\nt"
    assert templates.main_text('<p hidden>no</p><p data-x="hidden">yes</p><p class=x HIDDEN>no') == "yes"
    # Depth and attributes without bound.
    assert templates.main_text("<div>" * 20000 + "deep" + "</div>" * 20000 + "out") == "deep\n\nout"
    assert templates.main_text(f'<article class="{"k " * 50000}">{"word " * 100000}</article>') == " ".join(["word"] * 100000)


def test_pages(spark):
    html = lambda i: f'<html><body><div class="top">Site</div><div class="story"><p>Body {i} of the page, which is long enough to hold most of what there is to read on it.</p><p>Same</p></div><div class="foot">All rights</div></body></html>'
    rows = [(i, f"http://h.org/{i}", html(i)) for i in range(6)] + [(7, None, None), (8, "http://x.org/", ""), (9, "http://lone.net/a", PAGE), (9, "http://lone.net/a", PAGE)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in templates.extract_pages(d).collect()), key=str)
    want = [(i, f"Body {i} of the page, which is long enough to hold most of what there is to read on it.\n\nSame", None) for i in range(6)] + [(7, "", None), (8, "", None), (9, WANT, None), (9, WANT, None)]
    assert got == sorted([(i, t, len(t)) for i, t, _ in want], key=str)
    assert templates.extract_pages(d.limit(0)).count() == 0


def extracted(spark, pages):
    d = spark.createDataFrame([(i, f"http://h.org/{i}", f"<html><body>{x}</body></html>") for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(templates.extract_pages(d).collect(), key=lambda r: r.page_id)]


def test_main_slot_holds_all_that_varies_and_no_part_that_only_repeats(spark):
    # Less than 0.8 of the text varies: site title and footer go, what repeats beside varying text stays.
    short = [f'<div class="top">Site</div><div class="story"><p>Body {i} of the page, long enough to matter.</p><p>Same</p></div><div class="foot">All rights</div>' for i in range(6)]
    assert extracted(spark, short) == [f"Body {i} of the page, long enough to matter.\n\nSame" for i in range(6)]
    # More than 0.8 of it is in one container: headline, intro and tail outside it stay.
    body = "words of the body " * 20
    split = [f'<div class="top">Site</div><div class="content"><h1>Headline {i}</h1><div class="body"><p>{i} {body}</p></div><div class="tail">End {i}</div></div><div class="foot">All rights</div>' for i in range(6)]
    assert extracted(spark, split) == [f"Headline {i}\n\n{i} {body.strip()}\n\nEnd {i}" for i in range(6)]
    # Varying text with nothing but body around it.
    apart = [f'<div class="top">Site</div><div class="lead">Lead {i}</div><div class="story"><h2>Intro</h2><p>{i} {body}</p></div><div class="foot">All rights</div>' for i in range(6)]
    assert extracted(spark, apart) == [f"Lead {i}\n\nIntro\n\n{i} {body.strip()}" for i in range(6)]
    # A slot that few pages have counts as well.
    rare = [*split[:5], split[5].replace('<div class="foot">', '<div class="note">Seen once</div><div class="foot">')]
    assert extracted(spark, rare)[5].endswith("End 5\n\nSeen once") and "Site" not in "".join(extracted(spark, rare))
    # Copies of one page lose nothing.
    assert extracted(spark, [split[0]] * 3) == ["Site\n\n" + f"Headline 0\n\n0 {body.strip()}\n\nEnd 0" + "\n\nAll rights"] * 3
    # An article keeps all its text; a heading of main outside the article stays too.
    marked = [f'<div class="top">Site</div><main><h1>Headline {i}</h1><article><h2>Intro</h2><p>{i} {body}</p></article></main><div class="x">Seen {i}</div>' for i in range(6)]
    assert extracted(spark, marked) == [f"Headline {i}\n\nIntro\n\n{i} {body.strip()}" for i in range(6)]


def test_classes_nest_into_gaps(spark):
    pages = [
        f'<html><body><nav><ul><li>a</li></ul></nav><div class="c"><h1>{i}</h1>'
        + ('<div class="box"><h2>Also</h2><ul><li>x</li></ul></div>' if i % 3 else "")
        + "".join(f'<section><h3>{j}</h3><p>{i}{j}</p></section>' for j in range(i % 4 + 1))
        + '</div><div class="foot"><p>All</p></div></body></html>'
        for i in range(12)
    ]
    vector = defaultdict(lambda: [0] * len(pages))
    for i, page in enumerate(pages):
        for kind, node, _ in templates.read(page):
            if kind == "open":
                vector[node.path][i] += 1
    groups = defaultdict(list)
    for path, v in vector.items():
        groups[tuple(v)].append(path)
    valid = {path: n for n, (v, g) in enumerate(sorted(groups.items())) if len(g) >= 3 and sum(map(bool, v)) >= 0.6 * len(pages) for path in g}
    want = {}
    for path in valid:
        outer = [q for q in valid if path.startswith(f"{q}/") and valid[q] != valid[path]]
        want[path] = (valid[path], max(outer, key=len) if outer else None)
    rows = [("h", path, "div", 1, 1, n, 0) for path, n in valid.items()]
    got = templates.nest(spark.createDataFrame(rows, "host string, token string, kind string, support long, once long, v1 long, v2 long")).collect()
    assert {r.token: (r.v1, r.gap) for r in got} == want and len(got) == len(rows)
    assert want["html/body/div.c/div.box/ul"][1] == want["html/body/div.c/section"][1] == "html/body/div.c"


def test_a_nested_part_goes_or_stays_whole(spark):
    box = '<div class="box"><h2>Also</h2><ul><li>x</li></ul></div>'
    page = lambda i, inner, outer: f'{outer}<div class="c"><h1>Title {i}</h1><p>Text {i} of the page</p>{inner}</div><div class="end"><p>All</p><p>rights</p></div>'
    # A class that only some pages have, nested beside the varying part: it never varies, so it goes.
    assert extracted(spark, [page(i, "", box if i % 4 else "") + f"<div><p>Tail {i}</p></div>" for i in range(8)]) == [f"Title {i}\n\nText {i} of the page\n\nTail {i}" for i in range(8)]
    # Inside the varying part it stays.
    assert extracted(spark, [page(i, box if i % 4 else "", "") + f"<div><p>Tail {i}</p></div>" for i in range(8)]) == [f"Title {i}\n\nText {i} of the page" + ("\n\nAlso\n\nx" if i % 4 else "") + f"\n\nTail {i}" for i in range(8)]


class Article(HTMLParser):
    """The blocks inside article elements, by the language's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in templates.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.on -= tag == "article"
        if tag not in templates.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_pages_against_another_parser(spark, sf):
    """The shared pages have one article each, without anything of the wrong kind in it."""
    d = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in templates.extract_pages(d).collect()}
    for r in d.collect():
        other = Article()
        other.feed(r.html or "")
        other.close()
        assert got[r.page_id] == "\n\n".join(b for b in (" ".join(x.split()) for x in other.blocks) if b), r.page_id


def test_salted_join_gives_the_same(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    one = sorted((r.page_id, r.text) for r in templates.extract_pages(d).collect())
    monkeypatch.setattr(templates, "BROADCAST_HOSTS", 0)
    assert sorted((r.page_id, r.text) for r in templates.extract_pages(d).collect()) == one
    assert all("<" not in t[:1] for _, t in one)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/es/", "allow")]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_url_rules_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    urls = ["http://Example.ORG/es/x", "https://a.example.org/es/", "http://badexample.org/es/1", "http://x.com/fr", "http://x.com/fr/?q=/de/", "http://x.com/de/#a", "http://example.org/en/1234.html", "http://org", "org/es", None, "", "x://", "a://b://c/de/", "http://com/de/é", "http://x.org\n/es/", "http://x.com/de/"]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(d, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls + urls[:2]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        m = min([rest.find(c, n) for c in "?#" if c in rest[n:]] or [len(rest)])
        path = rest[n:m]
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow")
        assert got[i] == (host, path, best[1], best[2]), u
    assert urlfilter.filter_urls(d.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_language(spark):
    de, en = "der und die das ist nicht mit für auf eine schön " * 8, "the and of that with from this have they would " * 8
    page = lambda lang, text: f'<html lang="{lang}"><body><nav>Menu</nav><article><p>{text}</p></article></body></html>'
    rows = [(i, f"http://a.de/de/{i}", page("de", de)) for i in range(8)] + [(10 + i, f"http://b.com/en/{i}", page("en", en)) for i in range(8)]
    rows += [(30, "http://a.de/x", page("en", de)), (31, "http://a.de/y", page("", "")), (32, None, None), (33, "http://b.com/z", "<p>the and of that"), (33, "http://b.com/z", "<p>the and of that")]
    got = sorted((r.page_id, r.lang) for r in language.identify(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")).collect())
    want = dict(got)
    assert len(got) == len(rows) and want[30] == "de" and want[31] == "de" and want[33] == "en" and want[32] in ("de", "en")
    assert all(want[i] == ("de" if i < 10 else "en") for i in want if i < 20)
    none = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    assert [r.lang for r in language.identify(none).collect()] == [None]
    assert language.identify(none.limit(0)).count() == 0


def test_no_language_or_suffix_is_too_rare(spark, monkeypatch):
    r = random.Random(3)
    codes = [a + b for a in "abcdefgh" for b in "abcdefghi"] + ["zu"]
    words = {c: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for c in codes}
    text = lambda c: " ".join(r.choice(words[c]) for _ in range(60))
    rows = [(i, f"http://h{i}.org/{i}", f'<html lang="{c}"><body><p>{text(c)}</p></body></html>') for i, c in enumerate([c for c in codes for _ in range(1 if c == "zu" else 3)])]
    rows.append((1000, "http://new.net/", f"<p>{text('zu')}</p>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {x.page_id: x for x in language.identify(d).collect()}
    assert one[1000].lang == one[1000].text_lang == "zu" and len({x.lang for x in one.values()}) == len(codes)
    monkeypatch.setattr(language, "AT_ONCE", 30)
    monkeypatch.setattr(language, "BROADCAST_NUMBERS", 0)
    again = {x.page_id: x for x in language.identify(d).collect()}
    assert len(again) == len(one) and all(again[i].lang == one[i].lang and again[i].posterior == pytest.approx(one[i].posterior) for i in one)


def test_a_suffix_beyond_the_commonest_has_its_own_likelihood(spark):
    page = lambda lang, text: f'<html lang="{lang}"><body><p>{text}</p></body></html>'
    en, sw, xh = "the and of that with from " * 8, "habari yako kwamba katika nchi " * 8, "ukuba nokuthi ngoko abantu " * 8
    paths = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstu"][:505]
    rows = [(i, f"http://h.org/{x}/{i}", page("en", en)) for i, x in enumerate(x for x in paths for _ in range(5))]
    rows += [(9000 + i, f"http://c{i}.com/{c}/", page(c, t)) for i, (c, t) in enumerate([("sw", sw), ("xh", xh)] * 2)] + [(9100, "http://b1.com/sw/1", ""), (9200, "http://b2.com/xh/1", "")]
    got = {x.page_id: x.lang for x in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9100] == "sw" and got[9200] == "xh"

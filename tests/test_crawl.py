"""List walks against a walk page by page."""

from parcelyn.sources import crawl

PAD = "<!-- " + "x" * 220 + " -->"


def page(cards, following=None, last=False):
    html = "".join(f'<a class="card property-item" href="{u}"><b class="price big">{p}</b></a>' for u, p in cards)
    if following:
        html += f'<a class="p" rel="next" href="{following}">next</a>'
    return f"<html>{PAD}{html}{'<li class="page last disabled">' if last else ''}</html>"


def site(name, sizes, prices=None, last=True):
    """Pages of a site with so many cards each; ids go on over pages."""
    out, n = [], 0
    for k, size in enumerate(sizes, 1):
        own = [(f"http://{name}/listing-{n + i}", f"€ {(prices[k - 1] if prices else 500 - n - i)},000") for i in range(size)]
        n += size
        out.append((f"http://{name}/list?page={k}", 0, 200, page(own, f"http://{name}/list?page={k + 1}", last and k == len(sizes))))
    return out


def walked(spark, responses, starts, **settings):
    frame = spark.createDataFrame(responses, "url string, stage int, status int, body string")
    return crawl.walk(spark.createDataFrame(starts, "domain string, url string, preferred int"), frame, **settings)


def start(name, preferred=None):
    return (name, f"http://{name}/list?page=1", preferred)


def test_every_page_once_and_every_end(spark):
    rows = site("a", [3, 3, 2]) + site("b", [2, 0, 5]) + site("c", [1, 1], last=False)
    # d: a ring; e: a page that shows nothing new; f: no response at all.
    rows += [("http://d/list?page=1", 0, 200, page([("http://d/listing-1", "1,000")], "http://d/list?page=2")), ("http://d/list?page=2", 0, 200, page([("http://d/listing-2", "")], "http://d/list?page=1"))]
    rows += [("http://e/list?page=1", 0, 200, page([("http://e/listing-1", "9")], "http://e/list?page=2")), ("http://e/list?page=2", 0, 200, page([("http://e/listing-1", "9")], "http://e/list?page=3")), ("http://e/list?page=3", 0, 200, page([("http://e/listing-3", "9")]))]
    seeds, pages, tries = walked(spark, rows, [start(n) for n in "abcdef"] + [start("a")])
    seen = sorted((r.domain, r.page, r.n_cards, r.error_code) for r in pages.collect())
    assert seen == sorted([("a", 1, 3, None), ("a", 2, 3, None), ("a", 3, 2, None), ("b", 1, 2, None), ("b", 2, 0, None), ("c", 1, 1, None), ("c", 2, 1, None), ("c", 3, 0, "no_response"), ("d", 1, 1, None), ("d", 2, 1, None), ("e", 1, 1, None), ("e", 2, 1, None), ("f", 1, 0, "no_response")])
    got = sorted((r.domain, r.site_property_id) for r in seeds.collect())
    assert got == sorted([("a", str(i)) for i in range(8)] + [("b", "0"), ("b", "1"), ("c", "0"), ("c", "1"), ("d", "1"), ("d", "2"), ("e", "1")])
    assert {r.url: r.price for r in seeds.collect()}["http://d/listing-2"] is None and tries.count() == len(seen) - 2


def test_stages_and_least_prices(spark):
    rows = [(u, 0, 403, "no") for u, *_ in site("a", [2, 2, 2])] + [(u, 2, s, b) for u, _, s, b in site("a", [2, 2, 2], [900, 450, 100])]
    rows += [("http://a/list?page=1", 1, 200, "Just a moment..." + PAD), ("http://z/list?page=1", 0, 404, "gone"), ("http://z/list?page=1", 1, 503, "busy")]
    seeds, pages, tries = walked(spark, rows, [start("a"), start("z")], least_price=400_000, by_price=True)
    assert sorted((r.domain, r.page, r.stage, r.error_code) for r in pages.collect()) == [("a", 1, 2, None), ("a", 2, 2, None), ("a", 3, 2, None), ("z", 1, 1, "blocked")]
    assert sorted(r.price for r in seeds.collect()) == [450_000, 450_000, 900_000, 900_000]
    told = sorted((r.url[-1], r.domain, r.stage, r.error_code) for r in tries.collect())
    assert told == [("1", "a", 0, "blocked"), ("1", "a", 1, "blocked"), ("1", "a", 2, None), ("1", "z", 0, "http_error"), ("1", "z", 1, "blocked"), ("2", "a", 0, "blocked"), ("2", "a", 2, None), ("3", "a", 0, "blocked"), ("3", "a", 2, None)]
    _, pages, tries = walked(spark, rows, [start("a", 2)], least_price=2_000_000, by_price=True)
    assert [(r.page, r.stage) for r in pages.collect()] == [(1, 2)] and tries.count() == 1


def test_no_starts(spark):
    seeds, pages, tries = walked(spark, site("a", [1]), [])
    assert seeds.count() == pages.count() == tries.count() == 0


def test_selectors_are_read_once_for_all_pages(monkeypatch):
    from parcelyn.plans.further import SITE_PAGES
    from parcelyn.sources import html

    first = {d: html.parse_page(page, html.SITES[d]) for d, page in SITE_PAGES.items()}
    monkeypatch.setattr(html, "_step", lambda text: (_ for _ in ()).throw(AssertionError("read again")))
    assert {d: html.parse_page(page, html.SITES[d]) for d, page in SITE_PAGES.items()} == first

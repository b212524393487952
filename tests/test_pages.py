"""Extraction from pages of our own making, one for each shape."""

import json
from decimal import Decimal as D
from html import escape

from pyspark.sql import functions as F

from offerlens.sources import pages as P


def pages(spark, *htmls, url="https://shop.test/p_z7/"):
    return spark.createDataFrame([("shop", "product", url if i == 0 else f"{url}{i}", h) for i, h in enumerate(htmls)], "store_slug string, page_kind string, url string, html string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in P.to_offers(df).collect())


LD = '<script type="application/ld+json">{"@type":"Organization"}</script><script type="application/ld+json">%s</script>'


def test_json_ld(spark):
    product = {"@type": "Product", "name": "Brand Gold Tester EDP", "brand": {"name": "Brand"}, "offers": {"price": "399.00", "sku": "8", "url": "https://shop.test/x#/45-volum-50_ml", "availability": "https://schema.org/InStock"}}
    got = rows(P.json_ld(pages(spark, LD % json.dumps(product), "<p>nothing</p>")), "price", "volume_ml", "tester", "concentration", "availability", "perfume_name")
    assert got == [(D("399.00"), 50, True, "EDP", "in_stock", "gold")]


def test_radio_combinations_and_fallback(spark):
    li = '<li><input class="input-radio" value="{v}"><span class="variant-price"> {p} </span><span class="attr-name">{n}</span>{old}<span class="variant-availability {c}">x</span></li>'
    body = '<h1>Brand Gold EDP</h1><div class="a product-variants"><ul class="radio-buttons">' + li.format(v=37, p="625,99 lei", n="50 ml", c="yes", old='<span class="attr-reduction">700,00</span>') + li.format(v=32, p="gratis", n="100 ml", c="no", old="") + "</ul></div>"
    single = LD % json.dumps({"@type": "Product", "name": "Brand Gold EDP 30 ml", "offers": {"price": "100"}})
    got = rows(P.combinations_or_json_ld(pages(spark, body, single)), "price", "old_price", "volume_ml", "availability", "store_product_identifier")
    assert got == [(D("100.00"), None, 30, "out_of_stock", None), (D("625.99"), D("700.00"), 50, "in_stock", "37")] or got[1][:3] == (D("625.99"), D("700.00"), 50)


def test_variant_list(spark):
    item = '<li class="product-variants-list__item"><a data-variant-value="9" class="{c}" title="Alege opțiunea produsului {t}"></a><span class="product-variants-list__item-price">{p}</span></li>'
    body = item.format(c="x", t="Gold Apă de toaletă 100 ml", p="99,50 lei") + item.format(c="is-disabled", t="Gold EDT 50 ml", p="59,50 lei") + item.format(c="x", t="", p="1,00")
    assert rows(P.variant_list(pages(spark, body)), "price", "concentration", "volume_ml", "availability") == [(D("59.50"), "EDT", 50, "out_of_stock"), (D("99.50"), "EDT", 100, "in_stock")]


def test_attribute_groups(spark):
    body = '<h1>Brand Woman</h1><span class="current-price-value">125,00 lei</span><button class="btn add-to-cart">x</button><div class="product-variants"><div class="product-variants-item"><span class="form-control-label">Volum</span><input class="input-radio" value="1" title="50 ml" checked><input class="input-radio" value="2" title="100 ml Tester"></div><div class="product-variants-item"><select><option>a</option><option selected>extract de parfum</option></select></div></div>'
    more = spark.createDataFrame([("shop", "https://shop.test/p_z7/", "2", '<span class="current-price-value"> 200,00&nbsp;lei </span>', '<button class="add-to-cart" disabled>')], "store_slug string, url string, value_id string, price_html string, button_html string")
    got = rows(P.attribute_groups(pages(spark, body), more), "price", "volume_ml", "tester", "concentration", "availability")
    assert got == [(D("125.00"), 50, False, "Extrait", "in_stock"), (D("200.00"), 100, True, "Extrait", "out_of_stock")]


def test_product_data_and_coupon(spark):
    one = {"7": {"product_id": 7, "item_brand": "Brand", "item_name": "Brand Gold Apă de parfum 100 ml", "price_with_tax": 549.0, "price_without_discount": 600, "has_discount": True, "availability": "Stoc epuizat", "url": "https://shop.test/a_z7/"}}
    two = {"7b": one["7"] | {"price_with_tax": 500.0, "has_discount": False}, "8": one["7"] | {"product_id": 8, "price_with_tax": 10, "availability": "În stoc"}}
    script = '<script type="x" data-controller="utils-gtm-productdataprinter">%s</script>'
    coupon = '<div data-product-add-coupon-to-cart="CODE5"><b></b><p class="x h4">450,00 lei</p></div>'
    got = rows(P.product_data(pages(spark, script % json.dumps(one) + script % json.dumps(two) + coupon)), "store_product_identifier", "price", "old_price", "availability", "coupon_code", "coupon_price")
    assert got == [("7", D("500.00"), None, "out_of_stock", "CODE5", D("450.00")), ("8", D("10.00"), D("600.00"), "in_stock", None, None)]


def test_tracked_search(spark):
    data = {"results": {"products": [{"id": 5, "name": 'Gold "X"', "brand": "Brand"}, {"id": 6, "name": "No link", "brand": "Brand"}, {"id": None, "name": "x", "brand": "y"}]}}
    body = f'<div data-tracking-search="{escape(json.dumps(data))}"></div><a href="/gold_z5/"><b>x</b></a><a href="/other_z5/?a">y</a>'
    assert [(r["id"], r["name"], r["product_url"]) for r in P.tracked_search(pages(spark, body)).collect()] == [(5, 'Gold "X"', "/gold_z5/")]


def test_suggestions(spark):
    data = {"suggestions": [{"data": {"name": "Dior (Christian Dior) Sauvage Parfum 200 ml", "url": "/s", "type": "product", "price": "1.013 lei", "stock_string": "în stoc", "code": "C"}}, {"data": {"type": "category", "name": "x"}}]}
    assert rows(P.suggestions(pages(spark, json.dumps(data)), F.lit("https://b.test")), "price", "volume_ml", "availability", "product_url", "perfume_name") == [(D("1013.00"), 200, "in_stock", "https://b.test/s", "dior sauvage")]


def test_pointer_map(spark):
    variant = {"name": "Sauvage", "variantName": "Eau de Parfum", "additionalInfo": "200 ml", "url": "/d/p-1/", "productCode": "C1", "price": {"value": 1050, "currency": "RON"}, "originalPrice": {"value": 1200}, "availability": {"state": "CanBeBought"}}
    state = {"Brand:1": {"name": "DIOR"}, "CatalogVariant:1": variant, "CatalogVariant:2": variant | {"price": None}, "CatalogProduct:9": {"brand": {"__ref": "Brand:1"}, "variants": [{"__ref": "CatalogVariant:1"}, {"__ref": "CatalogVariant:2"}, {"__ref": "CatalogVariant:3"}]}}
    body = f'<script id="__APOLLO_STATE__" type="application/json">{json.dumps(state)}</script>'
    got = rows(P.pointer_map(pages(spark, body), F.lit("https://n.test")), "price", "old_price", "volume_ml", "concentration", "brand", "product_url", "availability", "perfume_name")
    assert got == [(D("1050.00"), D("1200.00"), 200, "EDP", "DIOR", "https://n.test/d/p-1/", "in_stock", "sauvage")]


def test_escaped_state(spark):
    par = {"code": "c1", "value": "100 ml", "online": 1, "price": {"withVat": {"decimal": "250.50"}, "rrpWithVat": {"decimal": "300"}}, "priceAction": {"sale": True}}
    item = {"name": "MYSLF L'Absolu ] - P", "urlRelative": "/m/", "brands": [{"name": "YSL"}], "pars": [par, par | {"code": "c2", "value": "50 ml", "online": 0, "priceAction": {"sale": False}}]}
    text = json.dumps({"configStore": {"items": []}, "productsStore": {"listingPage": 1, "listingData": {"items": [item]}}}, separators=(",", ":")).replace("'", "\\'")
    got = rows(P.escaped_state(pages(spark, f"<script>window.__INITIAL_STATE__state='{text}'</script>"), F.lit("https://v.test")), "store_product_identifier", "price", "old_price", "volume_ml", "concentration", "availability")
    assert got == [("c1", D("250.50"), D("300.00"), 100, "Parfum", "in_stock"), ("c2", D("250.50"), None, 50, "Parfum", "out_of_stock")]


def test_collection_page(spark):
    body = """<h6>main accords</h6><div><div style="opacity: 100%; width: 100%;">sweet</div><div style="width: 76.5%;"> warm spicy </div></div><h5>x</h5><div style="width: 9%">no</div>
    <pyramid-level-new notes="top"><a class="pyramid-note-link"><span class="pyramid-note-label">Cherry</span></a><a><span class="pyramid-note-label">Pink &amp; Pepper</span></a></pyramid-level-new><pyramid-level-new notes="side"><span class="pyramid-note-label">z</span></pyramid-level-new>
    <script>let similar_perfumes = {"a": 1};</script>"""
    p = pages(spark, body, "<p>let similar_perfumes = {broken};</p>")
    assert [(r["accord"], r["strength"]) for r in P.accords(p).orderBy("position").collect()] == [("sweet", 100), ("warm spicy", 76)]
    assert [(r["tier"], r["name"]) for r in P.notes(p).orderBy("position").collect()] == [("top", "Cherry"), ("top", "Pink & Pepper")]
    assert [r["payload"] for r in P.sealed_payload(p).collect()] == ['{"a": 1}']


HOSTS = ["www.site.test", "site.test"]


def test_similar_and_owned(spark):
    entry = lambda u, n="N": {"perfume": {"dizajner": " B ", "naslov": n, "perfume_url": u}}
    payload = json.dumps({"similar_perfumes": [entry("/perfume/B/N-1.html"), entry("https://site.test/perfume/B/N-1.html?x"), entry("https://evil.test/perfume/B/N-1.html"), entry("/perfume/B/N-2.html", "")]})
    df = spark.createDataFrame([("u", payload)], "url string, payload string")
    assert [(r["brand"], r["similar_url"]) for r in P.similar_items(df, HOSTS, "www.site.test").collect()] == [("B", "https://www.site.test/perfume/B/N-1.html")]
    shelves = [{"type": "wardrobe", "field": "relation", "value": "want", "perfumes": [{"url": "/perfume/B/X-9.html"}]}, {"type": "wardrobe", "field": "relation", "value": "have", "perfumes": [{"url": "/perfume/B/N-1.html"}, {"url": "/bad"}]}]
    own = P.owned_json(spark.createDataFrame([("u", json.dumps(shelves))], "url string, payload string"), HOSTS, "www.site.test")
    assert [r["item_url"] for r in own.collect()] == ["https://www.site.test/perfume/B/N-1.html"]
    html = '<section><h3>Perfumes I Have (2)</h3><div><a href="/perfume/B/N-1.html?s=1">a</a><a href="/perfume/B/N-1.html">b</a></div></section><section><h3>Perfumes I Want (1)</h3><a href="/perfume/C/M-2.html">c</a></section>'
    assert [r["item_url"] for r in P.owned_html(pages(spark, html), HOSTS, "www.site.test").collect()] == ["https://www.site.test/perfume/B/N-1.html"]


def test_listing_directory_sitemap(spark):
    card = '<article class="product-miniature" data-id-product="1"><h2><a href="/g"><span class="product-name-manufacturer">Brand</span> <strong class="product-name-middle">Gold</strong> <span class="product-name-type">Apa de parfum</span></a></h2><span class="price">625,99 lei</span></article><article class="product-miniature" data-id-product="2"><h3><a href="/h">Silver EDT 50 ml</a></h3><span class="product-brand">Brand</span><span class="product-price" content="999">999.00 lei</span><span class="regular-price">1200.00 lei</span><i class="out-of-stock-product"></i></article>'
    got = rows(P.listing_cards(pages(spark, card)), "store_product_identifier", "price", "availability", "concentration", "perfume_name")
    assert got == [("1", D("625.99"), "in_stock", "EDP", "gold"), ("2", D("999.00"), "out_of_stock", "EDT", "silver")]
    directory = P.brand_directory(pages(spark, '<a href="/x">Xerjoff</a><a href="/cd">Christian Dior</a><a href="/cd2">Christian  DIOR</a>'))
    wanted = spark.createDataFrame([("Dior",), ("Nobody",)], "brand string")
    assert [(r["brand"], r["target"]) for r in P.brand_lookup(wanted, directory).collect()] == [("Dior", "/cd2")]
    urls = P.sitemap_urls(pages(spark, "<urlset><url><loc> https://n.test/dior/sauvage-elixir/ </loc></url><url><loc>https://n.test/x/y/</loc></url></urlset>"))
    found = P.sitemap_candidates(urls, spark.createDataFrame([("Christian Dior",)], "brand string"))
    assert [(r["brand"], r["name_text"]) for r in found.collect()] == [("Christian Dior", "sauvage elixir")]


def test_detail_and_errors(spark):
    offers = P.to_offers(P.json_ld(pages(spark, LD % json.dumps({"@type": "Product", "name": "Brand Gold 30 ml", "offers": {"price": "100"}}))))
    page = pages(spark, f'<div data-product="{escape(json.dumps({"description": "O apă de toaletă fină"}))}"></div>')
    assert [r["concentration"] for r in P.detail_concentration(offers, page).collect()] == ["EDT"]
    good, errors = P.extract_offers(pages(spark, LD % json.dumps({"@type": "Product", "name": "A 30 ml", "offers": {"price": "1"}}), "<p>"), {"shop": P.json_ld})
    assert good.count() == 1
    assert [r["error"] for r in errors.collect()] == ["structure not recognised"]


def test_long_and_deep_pages(spark):
    """A state of a megabyte, and elements nested 5,000 deep."""
    par = {"code": "c", "value": "100 ml", "online": 1, "price": {"withVat": {"decimal": "9.50"}}}
    items = [{"name": f"Name {i} it\'s EDP", "urlRelative": f"/m{i}/", "brands": [{"name": "Brand"}], "pars": [par]} for i in range(6000)]
    state = json.dumps({"x": {"a": [1]}, "productsStore": {"items": items, "more": [[1], "]"]}}).replace("\\", "\\\\").replace("'", "\\'")
    body = f"<script>window.__INITIAL_STATE__state='{state}';</script>"
    assert len(body) > 1_000_000
    assert P.to_offers(P.escaped_state(pages(spark, body), F.lit("https://v.test"))).count() == 6000
    deep = "<div>" * 5000 + '<article class="product-miniature"><h2><a href="/x">Brand Gold EDP 50 ml</a></h2><span class="price">10,50 lei</span></article>' + "</div>" * 5000
    assert [(r["price_text"], r["error"]) for r in P.listing_cards(pages(spark, deep)).collect()] == [("10,50 lei", None)]


def test_product_pages_take_brand_and_title_from_cards(spark):
    li = '<li><input class="input-radio" value="1"><span class="variant-price">100,00 lei</span><span class="attr-name">50 ml</span><span class="variant-availability yes">x</span></li>'
    page = pages(spark, f'<div class="product-variants">{li}</div>', url="https://shop.test/gold.html")
    card = '<article class="product-miniature"><h2><a href="https://shop.test/gold.html?x">Gold EDP</a></h2><span class="product-brand">Brand</span></article>'
    cards = P.listing_cards(pages(spark, card, url="https://shop.test/list"))
    offers, errors = P.extract_offers(page, {"shop": P.radio_combinations}, cards)
    assert [(r["brand"], r["raw_title"], r["volume_ml"], r["price"]) for r in offers.collect()] == [("Brand", "Gold EDP", 50, D("100.00"))]
    assert errors.count() == 0


def test_search_and_sitemap_candidates(spark):
    catalog = spark.createDataFrame([(1, "Jean Paul Gaultier", "Le Male"), (2, "Dior", "Sauvage")], "perfume_id long, brand string, name string")
    found = spark.createDataFrame([(1, "Jean P. Gaultier Le Male (tester)"), (1, "Dior Le Male"), (1, "Jean P. Gaultier Scandal"), (2, "Christian Dior Sauvage EDP 100 ml")], "perfume_id long, title string")
    assert sorted(r["title"] for r in P.search_candidates(found, catalog).collect()) == ["Christian Dior Sauvage EDP 100 ml", "Jean P. Gaultier Le Male (tester)"]
    urls = spark.createDataFrame([("s", "https://s.test/dior/sauvage-eau-de-parfum/"), ("s", "https://s.test/dior/addict/"), ("s", "https://s.test/other/sauvage/")], "store_slug string, loc string")
    kept = P.plausible_locations(P.sitemap_candidates(urls, catalog), catalog).collect()
    assert [(r["loc"], r["perfume_id"]) for r in kept] == [("https://s.test/dior/sauvage-eau-de-parfum/", 2)]
    index = pages(spark, "<sitemapindex><sitemap><loc>https://s.test/sitemap-products.xml</loc></sitemap><sitemap><loc>https://s.test/sitemap-pages.xml</loc></sitemap></sitemapindex>")
    assert [r["loc"] for r in P.product_sitemaps(index).collect()] == ["https://s.test/sitemap-products.xml"]


def test_stream_of_pages(spark, tmp_path):
    from offerlens.sources import schema as S

    S.conform(pages(spark, "<p>x</p>"), "raw_pages").write.parquet(str(tmp_path / "p"))
    assert S.read_pages(spark, str(tmp_path / "p")).count() == 1
    query = S.stream_pages(spark, str(tmp_path / "p")).writeStream.format("memory").queryName("pages_in").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("pages_in").count() == 1


def test_five_directories(spark):
    htmls = {
        "boxed_links": '<a href="/no">Outside</a><div class="brand-infos"><a href="/m">Amber House</a><a href="/n"> </a></div><div class="brand-infos"><a href="/m2">AMBER  house</a></div>',
        "brand_links": '<a href="/brand/a">Amber House</a><a href="/other/b">Other</a><a href="/brand/m2"><b>Amber</b> House</a>',
        "data_spans": '<span data-id="m-1" data-text="Amber House" data-url="x"></span><span data-id="c-1" data-text="No" data-url="y"></span><span data-id="m-2" data-text="Amber House" data-url="/m2"></span><span data-id="m-3" data-text="" data-url="z"></span>',
        "grid_links": '<div class="grid"><a href="/m2/">Amber House</a><a href="/m2/more/">Deep</a></div><a href="/out/">Out</a>',
        "checkboxes": '<input class="filter-checkbox-list__checkbox" id="fs-prop-brand-val-77"><label for="fs-prop-brand-val-77"><span class="filter-checkbox-list__label-text">Amber House <i>(12)</i></span></label><input class="filter-checkbox-list__checkbox" id="other-1">',
    }
    want = {"brand_links": "/brand/m2", "grid_links": "m2", "checkboxes": "77"}
    for shape, html in htmls.items():
        found, errors = P.read_directory(pages(spark, html, "<p>nothing</p>"), shape)
        assert [tuple(r) for r in found.collect()] == [("shop", "amber house", want.get(shape, "/m2"))], shape
        assert [(r["url"], r["error"]) for r in errors.collect()] == [("https://shop.test/p_z7/1", "ValueError: no directory of brands")]


def test_next_pages(spark):
    more = {
        "numbered_link": '<a class="x" href="/l?page=3">3</a>', "next_item": '<li class="product-list-pagination__item fs-next"><a href="/l">next</a></li>', "rel_next": '<a rel="next" href="/l">x</a>',
        "state_counts": '{"listingPage": 2, "listingPagesCount":3}',
    }
    for shape, html in more.items():
        last = html.replace("page=3", "page=2").replace("fs-next", "fs-other").replace('rel="next"', 'rel="prev"').replace("Count\":3", "Count\":2")
        rows = [("s", "", "https://s.test/a", "x"), ("s", "", "https://s.test/a?page=2", last), ("s", "", "https://s.test/b", "x"), ("s", "", "https://s.test/b?page=2", html), ("s", "", "https://s.test/c?page=2", last)]
        got = P.listing_gaps(spark.createDataFrame(rows, "store_slug string, page_kind string, url string, html string"), shape)
        assert sorted((r["listing"][-1], r["pages_seen"], r["last_page"], r["complete"]) for r in got.collect()) == [("a", 2, 2, True), ("b", 2, 2, False), ("c", 1, 2, False)], shape


def test_copies_of_the_last_page(spark):
    html = {True: '<a rel="next" href="/l">x</a>', False: "x"}
    for more in ([True, False, False], [False, True, True], [True, False, True], [False, True, False]):
        rows = [("s", "https://s.test/a", "x", 9)] + [("s", "https://s.test/a?page=2", html[m], i) for i, m in enumerate(more)]
        for turned in (rows, rows[::-1]):
            table = spark.createDataFrame(turned, "store_slug string, url string, html string, page_id long").coalesce(1)
            assert [r["complete"] for r in P.listing_gaps(table, "rel_next", order=F.col("page_id")).collect()] == [not more[0]], more
            assert [r["complete"] for r in P.listing_gaps(table, "rel_next").collect()] == [False], more


def test_listings_of_odd_pages_equal_their_sql(spark, tmp_path):
    import duckdb

    from offerlens.plans import queries as Q

    html = ["x", "xx", None, '<A REL="NEXT" href="/l">x</A>y', '<a rel="nrel="next"ext">z']
    urls = [(f"https://s.test/a{i}{j}{end}", x) for i, first in enumerate(html) for j, x in enumerate(html) for end, x in (("", first), ("?page=2", x), ("?page=2&x=1", first))]
    urls += [(u, x) for u in (None, "", "https://s.test/e?page=", "https://s.test/f?page=2\n", "https://s.test/g?page=2\rz") for x in ("x", "xx")]
    rows = [(i, *x) for i, x in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")  # of copies of a page the first one counts, which several threads leave open
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet') ORDER BY page_id")
    want = con.execute(Q.SQL["listing_gaps"]).fetchall()
    assert sorted(map(tuple, Q.QUERIES["listing_gaps"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_sitemap_files(spark, tmp_path):
    from offerlens.sources import schema as S

    head = '<?xml version="1.0" encoding="UTF-8"?>'
    entries = "".join(f"<url><loc> https://n.test/a/{i}?x=1&amp;y=2 </loc><lastmod>2024-01-01</lastmod></url>" for i in range(500))
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "one.xml").write_text(f'{head}<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</urlset>')
    (tmp_path / "maps" / "index.xml").write_text(f"{head}<sitemapindex><sitemap><loc>https://n.test/one.xml</loc></sitemap></sitemapindex>")
    found = S.read_sitemaps(spark, str(tmp_path / "maps"))
    assert found.count() == 500 and found.select("loc").distinct().count() == 500 and found.where("loc = 'https://n.test/a/7?x=1&y=2' AND lastmod = '2024-01-01' AND file = 'one.xml'").count() == 1
    assert [r["loc"] for r in S.read_sitemaps(spark, str(tmp_path / "maps"), index=True).collect()] == ["https://n.test/one.xml"]
    query = S.read_sitemaps(spark, str(tmp_path / "maps"), stream=True).writeStream.format("memory").queryName("maps_in").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("maps_in").count() == 500


def test_made_pages_are_dealt_to_all_cores(spark, tmp_path):
    from offerlens.plans import queries as Q

    parts = [(i, f"name {i}", "Brand#1", "SMALL", i % 9, 900.0 + i) for i in range(200)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = Q._parts(spark, str(tmp_path))
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) <= 200 // 8 and rows.select("k").distinct().count() == 200

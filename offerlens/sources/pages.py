"""Raw pages to offers and collection rows. JSON is read by Spark's own functions, markup by rules over small trees."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import money as M
from offerlens.functions import text as X
from offerlens.operators.matching import names_brand, plausible
from offerlens.sources.markup import Node, each_page
from offerlens.sources.schema import conform
from offerlens.sources.storage import written

#: What an extractor yields; prices, volumes and concentrations still as text.
FIELDS = ["raw_title", "product_url", "identifier", "brand", "name_text", "concentration_text", "volume_text", "tester_text", "price_text", "old_price_text", "price_format", "availability", "currency", "coupon_code", "coupon_text"]


def to_offers(raw: DataFrame, place: bool = False) -> DataFrame:
    """Extracted rows as raw offers: numbers, volume, concentration, tester and name by column expressions. Rows without a price go.

    With `place` they have the page (page_url) and the position on it that they come from.
    """

    def price(text: str) -> Column:
        t, kind = F.col(text), F.col("price_format")
        return F.when(kind == "comma", M.comma_price(t)).when(kind == "dot", M.dot_price(t)).when(kind == "lei", M.lei_price(t)).otherwise(t.try_cast(M.MONEY))

    title, name = F.col("raw_title"), F.coalesce("name_text", "raw_title")
    concentration = F.coalesce(X.concentration(F.col("concentration_text")), X.concentration_or_p(title))
    out = raw.where("error IS NULL").select(
        "url", "position", "store_slug", "raw_title", "product_url", F.col("identifier").alias("store_product_identifier"), "brand", X.core_name_any_brand(name, F.coalesce("brand", F.lit(""))).alias("perfume_name"),
        concentration.alias("concentration"), F.coalesce(X.volume_ml(F.col("volume_text")), X.volume_ml(title)).alias("volume_ml"), X.is_tester(F.coalesce(F.concat_ws(" ", "raw_title", "tester_text"), F.lit(""))).alias("tester"),
        price("price_text").alias("price"), price("old_price_text").alias("old_price"), F.coalesce("currency", F.lit("RON")).alias("currency"), "availability", "coupon_code", M.comma_price(F.col("coupon_text")).alias("coupon_price"),
    )
    at = [F.col("url").alias("page_url"), "position"] if place else []
    return conform(out.where("price IS NOT NULL"), "raw_offers", *at)


def _fields(df: DataFrame, **values) -> DataFrame:
    """store_slug, url, position, FIELDS and error, with the given columns and null for the rest."""
    pick = {f: F.lit(None) for f in FIELDS} | values
    return df.select("store_slug", "url", "position", *[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(f) for f, v in pick.items()], F.lit(None).cast("string").alias("error"))


def scripts(html: Column, mark: str) -> Column:
    """Bodies of the script elements whose tag holds `mark`, a regular expression."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script\b[^>]*{mark}[^>]*>(.*?)</script>"), 1)


def unescape(text: Column) -> Column:
    pairs = [("&quot;", '"'), ("&#34;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


# -- directories, sitemaps, listings -------------------------------------------------------------------------------


def anchors(pages: DataFrame) -> DataFrame:
    """(store_slug, url, position, href, label) of every link with plain text."""
    both = r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]*)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(both), 1).alias("href"), F.regexp_extract_all("html", F.lit(both), 2).alias("label"))
    out = pages.select("store_slug", "url", F.posexplode(pairs).alias("position", "x"))
    return out.select("store_slug", "url", "position", "x.href", X.collapse_whitespace(unescape(F.col("x.label"))).alias("label"))


def brand_directory(pages: DataFrame, pattern: str = r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>([^<]+)</a>", name: int = 2, target: int = 1) -> DataFrame:
    """(store_slug, brand, target): normalised brands and where they lead; the last entry of a brand counts. Groups of `pattern` may be attributes."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), name).alias("n"), F.regexp_extract_all("html", F.lit(pattern), target).alias("t"))
    out = pages.select("store_slug", "url", F.posexplode(pairs).alias("position", "x")).select("store_slug", X.normalize(unescape(F.col("x.n"))).alias("brand"), F.struct("url", "position").alias("at"), F.col("x.t").alias("target"))
    return out.where("brand <> ''").groupBy("store_slug", "brand").agg(F.max_by("target", "at").alias("target"))


def _own_text(node: Node) -> str:
    return " ".join("".join(x for x in node.children if isinstance(x, str)).split())


def _boxed_links(root: Node) -> list[tuple]:
    return [(a.text(), a.attrs["href"]) for box in root.all("div", "brand-infos") for a in box.all("a", attr="href")]


def _brand_links(root: Node) -> list[tuple]:
    return [(a.text(), a.attrs["href"]) for a in root.all("a", attr="href") if "/brand/" in (a.attrs["href"] or "")]


def _data_spans(root: Node) -> list[tuple]:
    return [(x.attrs.get("data-text"), x.attrs.get("data-url")) for x in root.all("span", attr="data-id") if (x.attrs["data-id"] or "").startswith("m-")]


def _grid_links(root: Node) -> list[tuple]:
    links = [a for box in root.all("div", "grid") for a in box.all("a", attr="href")]
    return [(a.text(), a.attrs["href"].strip("/")) for a in links if re.fullmatch("/[a-z0-9][a-z0-9-]*/", a.attrs["href"] or "")]


def _checkboxes(root: Node) -> list[tuple]:
    """The label's own text: the number behind it is an element of its own."""
    labels = {x.attrs["for"]: x.first(cls="filter-checkbox-list__label-text") for x in root.all("label", attr="for")}
    boxes = [x.attrs["id"] for x in root.all("input", "filter-checkbox-list__checkbox", "id") if (x.attrs["id"] or "").startswith("fs-prop-brand-val-")]
    return [(_own_text(labels[x]), x.removeprefix("fs-prop-brand-val-")) for x in boxes if labels.get(x) is not None]


#: The places in which directories have brands and where they lead.
DIRECTORIES = {"boxed_links": _boxed_links, "brand_links": _brand_links, "data_spans": _data_spans, "grid_links": _grid_links, "checkboxes": _checkboxes}


def read_directory(pages: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """(store_slug, brand, target) of directory pages of one of DIRECTORIES, the last entry of a brand counting, and (store_slug, url, error) of pages without any."""
    find = DIRECTORIES[shape]

    def rule(root: Node, url: str) -> list[dict]:
        found = [{"name": name, "target": target} for name, target in find(root) if name and target]
        if not found:
            raise ValueError("no directory of brands")
        return found

    rows = written(each_page(pages, rule, ["name", "target"]))
    named = rows.where("error IS NULL").select("store_slug", X.normalize(F.col("name")).alias("brand"), F.struct("url", "position").alias("at"), "target")
    return named.where("brand <> ''").groupBy("store_slug", "brand").agg(F.max_by("target", "at").alias("target")), rows.where("error IS NOT NULL").select("store_slug", "url", "error")


#: How a listing's page tells that another follows; `page` is its own number.
NEXT_PAGE = {
    "numbered_link": lambda html, page: F.rlike(html, F.concat(F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*page='), (page + 1).cast("string"))),
    "next_item": lambda html, page: html.rlike(r'(?is)<li\b[^>]*class="[^"]*\bproduct-list-pagination__item\b[^"]*\bfs-next\b[^"]*"[^>]*>(?:(?!</li>).)*<a\b[^>]*\bhref='),
    "rel_next": lambda html, page: html.rlike(r'(?is)<a\b[^>]*\brel="next"'),
    "state_counts": lambda html, page: F.coalesce(F.regexp_extract(html, r'"listingPage":\s*(\d+)', 1).try_cast("int") < F.regexp_extract(html, r'"listingPagesCount":\s*(\d+)', 1).try_cast("int"), F.lit(False)),
    "none": lambda html, page: F.lit(False),
}


def listing_gaps(pages: DataFrame, shape: str, page: Column | None = None, order: Column | None = None) -> DataFrame:
    """(store_slug, listing, pages_seen, last_page, complete): whether all pages of each listing are there, up to one after which none follows.

    Of several copies of the last page the first by the number `order` counts; without an order, one that names a next page does. Pages without
    html are seen, but tell nothing of a next one: the last page with html does.
    """
    page = url_page() if page is None else page
    more = NEXT_PAGE[shape](F.col("html"), page.cast("int"))
    rows = pages.select("store_slug", listing_url().alias("listing"), page.cast("int").alias("p"), more.alias("more"), (F.lit(0) if order is None else -order).alias("late"))
    last = F.max(F.when(F.col("p").isNotNull() & F.col("more").isNotNull(), F.struct("p", "late", "more")))
    out = rows.groupBy("store_slug", "listing").agg(F.count_distinct("p").alias("pages_seen"), F.max("p").alias("last_page"), last["more"].alias("more"))
    return out.select("store_slug", "listing", "pages_seen", "last_page", ((F.col("pages_seen") == F.col("last_page")) & ~F.col("more")).alias("complete"))


def brand_lookup(wanted: DataFrame, directory: DataFrame, brand: str = "brand") -> DataFrame:
    """Each wanted brand's target in each store's directory, under the first of its names that is listed."""
    forms = wanted.select(brand, F.posexplode(X.brand_forms(F.col(brand))).alias("priority", "form"))
    found = forms.join(directory.withColumnRenamed("brand", "form"), "form")
    return found.groupBy("store_slug", brand).agg(F.min_by("target", "priority").alias("target"))


def sitemap_urls(pages: DataFrame) -> DataFrame:
    """(store_slug, loc) of every location in sitemaps and their indexes."""
    locs = F.regexp_extract_all("html", F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), 1)
    return pages.select("store_slug", F.explode(locs).alias("loc")).select("store_slug", unescape(F.col("loc")).alias("loc")).distinct()


def product_sitemaps(pages: DataFrame, mark: str = "product") -> DataFrame:
    """(store_slug, loc) of those sitemaps in an index whose location holds `mark`."""
    index = pages.where(F.col("html").rlike(r"(?is)<sitemapindex\b"))
    return sitemap_urls(index).where(F.contains(F.lower("loc"), F.lit(mark)))


def sitemap_candidates(urls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Locations /<brand>/<name>/ of the catalog's brands, under any of their names, with name as text."""
    parts = r"^https?://[^/]+/([^/]+)/([^/]+)/?"
    split = urls.select("store_slug", "loc", F.regexp_extract("loc", parts, 1).alias("brand_slug"), F.replace(F.regexp_extract("loc", parts, 2), F.lit("-"), F.lit(" ")).alias("name_text"))
    brands = catalog.select("brand", F.explode(X.brand_forms(F.col("brand"))).alias("form")).select("brand", X.slug(F.col("form")).alias("brand_slug")).distinct()
    return split.join(brands, "brand_slug")


def plausible_locations(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Locations of `sitemap_candidates` with each perfume (perfume_id, name) of their brand that their name could be."""
    core = candidates.withColumn("core", X.core_name(F.col("name_text"), F.col("brand")))
    pairs = core.join(catalog.select("brand", "perfume_id", "name"), "brand")
    return pairs.where(plausible(F.col("core"), X.normalize(F.col("name"))))


def search_candidates(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Search results (perfume_id, title) that may be the perfume they were searched for: the title holds one of the brand's names, and the rest could be its name."""
    title = X.without_brackets(F.col("title"))
    pairs = rows.join(catalog.select("perfume_id", "brand", "name"), "perfume_id").where(names_brand(F.col("title"), F.col("brand")))
    return pairs.where(plausible(X.core_name_any_brand(title, F.col("brand")), X.normalize(F.col("name"))))


def with_cards(raw: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows of product pages with the brand, title and type of the listing card that leads to them, where they have none of their own."""
    known = cards.where("error IS NULL").groupBy("store_slug", X.url_key(F.col("product_url")).alias("__u")).agg(
        *[F.min_by(c, F.struct("url", "position")).alias(f"__{c}") for c in ("brand", "raw_title", "name_text", "concentration_text")]
    )
    out = raw.withColumn("__u", X.url_key(F.coalesce("product_url", "url"))).join(known, ["store_slug", "__u"], "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), f"__{c}") for c in ("brand", "raw_title", "name_text", "concentration_text")}
    return out.withColumns(filled).select(*raw.columns)


def pages_complete(pages: DataFrame, declared: Column, page: Column) -> DataFrame:
    """(store_slug, listing, pages_seen, last_page, complete): whether the pages of each listing reach the declared count."""
    out = pages.select("store_slug", listing_url().alias("listing"), page.cast("int").alias("p"), declared.cast("int").alias("d")).groupBy("store_slug", "listing")
    return out.agg(F.count_distinct("p").alias("pages_seen"), F.max("d").alias("last_page")).withColumn("complete", F.coalesce(F.col("pages_seen") >= F.col("last_page"), F.lit(False)))


def url_page(url: str = "url") -> Column:
    """The page's number in its address, 1 where that names none; null without an address."""
    number = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    return F.when(number == "", 1).otherwise(F.nullif(number, F.lit("")).cast("int"))


def listing_url(url: str = "url") -> Column:
    """The address without the page's number and what follows it; a line feed behind that number makes it part of the listing's address."""
    return F.regexp_replace(url, r"(?d)[?&]page=\d+.*\z", "")


def listing_cards(pages: DataFrame, card: str = "product-miniature") -> DataFrame:
    """Cards with a title link, brand, name and type; the price, old price and stock mark where they stand on the card."""

    def rule(root: Node, url: str) -> list[dict]:
        out = []
        for item in root.all("article", card):
            link = next((a for h in item.all() if h.tag in ("h2", "h3") for a in h.all("a", attr="href")), None)
            if link is None:
                continue
            part = lambda *names: next((x.text() for n in names if (x := item.first(cls=n)) is not None), None)
            price = item.first(cls="product-price") or item.first(cls="price")
            kind = part("product-name-type")
            brand = part("product-name-manufacturer", "product-brand")
            name = part("product-name-middle") or link.text()
            out.append({
                "raw_title": " ".join(x for x in (brand if part("product-name-middle") else None, name, kind) if x), "product_url": link.attrs["href"], "identifier": item.attrs.get("data-id-product"), "brand": brand, "name_text": name,
                "concentration_text": kind, "price_text": price and (price.attrs.get("content") or price.text()), "old_price_text": part("regular-price"),
                "price_format": None if price and price.attrs.get("content") else "dot" if price and price.tag and "product-price" in price.classes() else "comma", "availability": "out_of_stock" if item.first(cls="out-of-stock-product") else "in_stock",
            })
        return out

    return each_page(pages, rule, FIELDS)


# -- product pages in markup ---------------------------------------------------------------------------------------


def radio_combinations(pages: DataFrame) -> DataFrame:
    """One row for each size of a radio list: price, reduced-from price, stock class; parts without a price or stock mark go."""

    def rule(root: Node, url: str) -> list[dict]:
        box, out = root.first("div", "product-variants"), []
        title = next((x.text() for x in root.all() if x.tag in ("h1", "title")), "")
        for item in box.all("li") if box else []:
            radio, price, stock = item.first("input", "input-radio"), item.first(cls="variant-price"), item.first(cls="variant-availability")
            if radio is None or price is None or stock is None:
                continue
            size, old = item.first(cls="attr-name"), item.first(cls="attr-reduction")
            out.append({
                "raw_title": title, "product_url": url, "identifier": radio.attrs.get("value"), "volume_text": size and size.text(), "tester_text": url, "price_text": price.text(), "old_price_text": old and old.text(),
                "price_format": "comma", "availability": "in_stock" if "yes" in stock.classes() else "out_of_stock",
            })
        return out

    return each_page(pages, rule, FIELDS)


#: Fixed value: what stands before a variant's title.
VARIANT_PREFIX = "Alege opțiunea produsului "


def variant_list(pages: DataFrame, prefix: str = VARIANT_PREFIX) -> DataFrame:
    """Variants with a title of their own; a disabled class means out of stock."""

    def rule(root: Node, url: str) -> list[dict]:
        out = []
        for item in root.all("li", "product-variants-list__item"):
            link, price = item.first("a", attr="data-variant-value"), item.first(cls="product-variants-list__item-price")
            title = (link.attrs.get("title") or "").removeprefix(prefix).strip() if link else ""
            if price is not None and title:
                out.append({"raw_title": title, "product_url": url, "identifier": link.attrs["data-variant-value"], "price_text": price.text(), "price_format": "comma", "availability": "out_of_stock" if any("disabled" in c for c in link.classes()) else "in_stock"})
        return out

    return each_page(pages, rule, FIELDS)


def attribute_groups(pages: DataFrame, combinations: DataFrame | None = None, size_label: str = "volum") -> DataFrame:
    """Sizes of a radio group under `size_label`, the concentration from a select; the default's price stands on the page.

    The others' come from `combinations` (store_slug, url, value_id, html of the price, button), joined by page and value.
    """

    def rule(root: Node, url: str) -> list[dict]:
        box, sizes, chosen = root.first("div", "product-variants"), [], None
        title = next((x.text() for x in root.all("h1")), "")
        for item in box.all(cls="product-variants-item") if box else []:
            label, radios, select = item.first(cls="form-control-label"), item.all("input", "input-radio"), item.first("select")
            if radios and label and label.text().lower() == size_label:
                sizes = [(r.attrs.get("value"), r.attrs.get("title") or "", "checked" in r.attrs) for r in radios]
            elif select:
                option = next((o for o in select.all("option") if "selected" in o.attrs), select.first("option"))
                chosen = chosen or (option and option.text())
        price, button = root.first(cls="current-price-value"), root.first("button", "add-to-cart")
        stock = "out_of_stock" if button is None or "disabled" in button.attrs else "in_stock"
        return [
            {"raw_title": f"{title} {text}".strip(), "product_url": url, "identifier": value, "name_text": title, "concentration_text": chosen, "volume_text": text, "tester_text": text,
             "price_text": price.text() if default and price else None, "price_format": "comma", "availability": stock if default else None}
            for value, text, default in sizes
        ]

    found = each_page(pages, rule, FIELDS)
    if combinations is None:
        return found
    html = F.col("price_html")
    bought = F.when(F.col("button_html").rlike(r"(?is)<button\b[^>]*add-to-cart") & ~F.col("button_html").rlike(r"(?is)<button\b[^>]*add-to-cart[^>]*\bdisabled\b"), "in_stock").otherwise("out_of_stock")
    other = combinations.select("store_slug", "url", F.col("value_id").alias("identifier"), unescape(F.regexp_extract(html, r"(?is)current-price-value[^>]*>([^<]*)<", 1)).alias("__p"), bought.alias("__a"))
    return found.join(other, ["store_slug", "url", "identifier"], "left").withColumns({"availability": F.coalesce("availability", "__a"), "price_text": F.coalesce("price_text", "__p")}).select("store_slug", "url", "position", *FIELDS, "error")


# -- product pages and answers in JSON -----------------------------------------------------------------------------


def json_ld(pages: DataFrame) -> DataFrame:
    """The first product entry of each page's linked data; the volume may stand only in the offer url's fragment."""
    kind = "struct<`@type`:string,name:string,brand:struct<name:string>,offers:struct<price:string,sku:string,url:string,availability:string,priceCurrency:string>>"
    rows = pages.select("store_slug", "url", F.posexplode(scripts(F.col("html"), r"application/ld\+json")).alias("position", "s")).withColumn("d", F.from_json("s", kind))
    rows = rows.where((F.col("d.@type") == "Product") & F.col("d.offers.price").isNotNull())
    first = rows.groupBy("store_slug", "url").agg(F.min_by(F.struct("position", "d"), "position").alias("x")).select("store_slug", "url", "x.position", "x.d")
    hint = F.replace(F.regexp_extract("d.offers.url", "#(.*)$", 1), F.lit("_"), F.lit(" "))
    return _fields(
        first, raw_title=F.col("d.name"), product_url=F.col("url"), identifier=F.col("d.offers.sku"), brand=F.col("d.brand.name"), volume_text=F.concat_ws(" ", "d.name", F.regexp_replace(hint, "-", " ")), tester_text=F.col("url"),
        price_text=F.col("d.offers.price"), availability=F.when(F.contains("d.offers.availability", F.lit("InStock")), "in_stock").otherwise("out_of_stock"), currency=F.col("d.offers.priceCurrency"),
    )


def combinations_or_json_ld(pages: DataFrame) -> DataFrame:
    """Radio combinations where a page has valid ones, else its linked data."""
    radios = radio_combinations(pages)
    valid = radios.where(M.comma_price(F.col("price_text")).isNotNull())
    rest = json_ld(pages).join(valid.select("store_slug", "url").distinct(), ["store_slug", "url"], "left_anti")
    return valid.unionByName(rest)


def product_data(pages: DataFrame) -> DataFrame:
    """Entries of all product-data scripts of a page, later ones replacing earlier, the cheapest of each product; coupons for the page's own."""
    kind = "map<string,struct<product_id:long,item_brand:string,item_name:string,price_with_tax:decimal(10,2),price_without_discount:decimal(10,2),has_discount:boolean,availability:string,url:string>>"
    rows = pages.select("store_slug", "url", "html", F.posexplode(scripts(F.col("html"), "utils-gtm-productdataprinter")).alias("script", "s"))
    rows = rows.select("store_slug", "url", "script", F.explode(F.from_json("s", kind)).alias("key", "d"))
    merged = rows.groupBy("store_slug", "url", "key").agg(F.max_by("d", "script").alias("d"))
    merged = merged.where("d.product_id IS NOT NULL AND d.price_with_tax IS NOT NULL")
    best = merged.groupBy("store_slug", "url", F.col("d.product_id").alias("id")).agg(F.min_by("d", F.struct("d.price_with_tax", "key")).alias("d")).withColumn("position", F.lit(0))
    best = best.join(coupons(pages), ["store_slug", "url"], "left")
    own = F.regexp_extract("url", r"_z(\d+)", 1) == F.col("id").cast("string")
    old = F.when(F.col("d.has_discount"), F.col("d.price_without_discount"))
    best = best.where(F.col("d.item_name").isNotNull() & F.col("d.item_brand").isNotNull() & F.col("d.url").isNotNull())
    return _fields(
        best, raw_title=F.col("d.item_name"), product_url=F.col("d.url"), identifier=F.col("id"), brand=F.col("d.item_brand"), tester_text=F.col("d.url"), price_text=F.col("d.price_with_tax"), old_price_text=old,
        availability=X.availability(F.coalesce("d.availability", F.lit(""))), coupon_code=F.when(own, F.col("code")), coupon_text=F.when(own, F.col("coupon")),
    )


def coupons(pages: DataFrame) -> DataFrame:
    """(store_slug, url, code, coupon): a page's coupon code and the price text after it."""
    mark = r'(?is)data-product-add-coupon-to-cart="([^"]+)"(.*?)<p\b[^>]*class="[^"]*\bh4\b[^"]*"[^>]*>([^<]*)<'
    out = pages.select("store_slug", "url", F.regexp_extract("html", mark, 1).alias("code"), unescape(F.regexp_extract("html", mark, 3)).alias("coupon"))
    return out.where(F.col("code") != "").where(M.comma_price(F.col("coupon")).isNotNull())


def tracked_search(pages: DataFrame) -> DataFrame:
    """Candidates (id, name, brand, product_url) of a search page: the JSON in an attribute joined with the page's first link of each id."""
    kind = "struct<results:struct<products:array<struct<id:long,name:string,brand:string>>>>"
    data = F.from_json(unescape(F.regexp_extract("html", r'(?s)data-tracking-search="(.*?)"', 1)), kind)
    rows = pages.select("store_slug", "url", F.explode(data["results"]["products"]).alias("p")).select("store_slug", "url", "p.*").where("id IS NOT NULL AND name IS NOT NULL AND brand IS NOT NULL")
    links = anchors_any(pages).withColumn("id", F.regexp_extract("href", r"_z(\d+)/?(?:[?#].*)?$", 1).try_cast("long")).where("id IS NOT NULL")
    links = links.groupBy("store_slug", "url", "id").agg(F.min_by("href", "position").alias("product_url"))
    return rows.join(links, ["store_slug", "url", "id"]).groupBy("store_slug", "id").agg(F.min_by(F.struct("name", "brand", "product_url"), "url").alias("x")).select("store_slug", "id", "x.*")


def anchors_any(pages: DataFrame) -> DataFrame:
    """(store_slug, url, position, href) of every link, whatever it holds."""
    return pages.select("store_slug", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"'), 1)).alias("position", "href"))


def suggestions(pages: DataFrame, base_url: Column) -> DataFrame:
    """Products of a suggester's JSON answer."""
    kind = "struct<suggestions:array<struct<data:struct<name:string,url:string,type:string,price:string,stock_string:string,code:string>>>>"
    rows = pages.select("store_slug", "url", F.posexplode(F.from_json("html", kind)["suggestions"]).alias("position", "s"), base_url.alias("base")).where(F.col("s.data.type") == "product")
    stock = F.when(F.lower(X.strip_diacritics(F.col("s.data.stock_string"))) == "in stoc", "in_stock").otherwise("out_of_stock")
    link = F.when(F.startswith("s.data.url", F.lit("/")), F.concat("base", "s.data.url")).otherwise(F.col("s.data.url"))
    return _fields(rows, raw_title=F.col("s.data.name"), product_url=link, identifier=F.col("s.data.code"), name_text=X.without_brackets(F.col("s.data.name")), price_text=F.col("s.data.price"), price_format="lei", availability=stock)


def pointer_map(pages: DataFrame, base_url: Column) -> DataFrame:
    """Products of a state map whose entries point at others: product to variants and brand."""
    ref = "struct<`__ref`:string>"
    state = F.from_json(F.get(scripts(F.col("html"), "__APOLLO_STATE__"), F.lit(0)), "map<string,string>")
    entries = pages.select("store_slug", "url", base_url.alias("base"), F.explode(state).alias("key", "json"))
    products = entries.where(F.startswith("key", F.lit("CatalogProduct:"))).select("store_slug", "url", "base", F.from_json("json", f"struct<brand:{ref},variants:array<{ref}>>").alias("p"))
    wanted = products.select("store_slug", "url", "base", F.col("p.brand.__ref").alias("brand_key"), F.posexplode("p.variants").alias("position", "v")).withColumn("key", F.col("v.__ref"))
    kind = "struct<name:string,variantName:string,additionalInfo:string,url:string,productCode:string,price:struct<value:decimal(10,2),currency:string>,originalPrice:struct<value:decimal(10,2)>,availability:struct<state:string>>"
    variants = entries.select("store_slug", "url", "key", F.from_json("json", kind).alias("d"))
    brands = entries.select("store_slug", "url", F.col("key").alias("brand_key"), F.from_json("json", "struct<name:string>")["name"].alias("brand"))
    rows = wanted.join(variants, ["store_slug", "url", "key"]).join(brands, ["store_slug", "url", "brand_key"], "left").where("d.url IS NOT NULL AND d.price.value IS NOT NULL")
    link = F.when(F.startswith("d.url", F.lit("/")), F.concat("base", "d.url")).otherwise(F.col("d.url"))
    return _fields(
        rows, raw_title=F.trim(F.concat_ws(" ", "d.name", "d.variantName", "d.additionalInfo")), product_url=link, identifier=F.coalesce("d.productCode", "key"), brand=F.col("brand"), name_text=F.col("d.name"), concentration_text=F.col("d.variantName"),
        volume_text=F.col("d.additionalInfo"), price_text=F.col("d.price.value"), old_price_text=F.col("d.originalPrice.value"), availability=F.when(F.col("d.availability.state") == "CanBeBought", "in_stock").otherwise("out_of_stock"), currency=F.col("d.price.currency"),
    )


def script_state(html: Column) -> Column:
    """The JSON text in a quoted string that a script assigns, from its product store on.

    Possessive groups: the engine walks the string once and keeps nothing to go back to, however long it is.
    """
    text = F.regexp_extract(html, r"(?s)__INITIAL_STATE__state='([^'\\]*+(?:\\.[^'\\]*+)*+)'", 1)
    text = F.replace(F.replace(text, F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))
    mark = '"productsStore":'
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.locate(mark, text), F.length(text)))


def array_after(text: Column, key: str) -> Column:
    """What stands from the bracket after `key` on; JSON readers stop at the array's end by themselves."""
    return F.nullif(F.regexp_extract(text, rf'(?s)"{key}":\s*+(\[.*)', 1), F.lit(""))


def escaped_state(pages: DataFrame, base_url: Column) -> DataFrame:
    """Sizes of the items in a state that a script holds as a quoted string."""
    kind = "array<struct<name:string,urlRelative:string,brands:array<struct<name:string>>,pars:array<struct<code:string,value:string,online:int,price:struct<withVat:struct<decimal:string>,rrpWithVat:struct<decimal:string>>,priceAction:struct<sale:boolean>>>>>"
    items = F.from_json(array_after(script_state(F.col("html")), "items"), kind)
    rows = pages.select("store_slug", "url", base_url.alias("base"), F.explode(items).alias("i")).select("store_slug", "url", "base", "i", F.posexplode("i.pars").alias("position", "p"))
    rows = rows.where("p.code IS NOT NULL AND p.value IS NOT NULL AND p.price.withVat.decimal IS NOT NULL AND i.urlRelative IS NOT NULL")
    return _fields(
        rows, raw_title=F.trim(F.concat_ws(" ", "i.name", "p.value")), product_url=F.concat("base", "i.urlRelative", F.lit("?c="), "p.code"), identifier=F.col("p.code"), brand=F.get("i.brands", F.lit(0))["name"], name_text=F.col("i.name"),
        concentration_text=F.coalesce(X.concentration_or_p(F.col("i.name")), F.lit("")), volume_text=F.col("p.value"), price_text=F.col("p.price.withVat.decimal"), old_price_text=F.when(F.col("p.priceAction.sale"), F.col("p.price.rrpWithVat.decimal")),
        availability=F.when(F.col("p.online") == 1, "in_stock").otherwise("out_of_stock"),
    )


def detail_concentration(offers: DataFrame, details: DataFrame) -> DataFrame:
    """Offers whose title tells no concentration take it from their detail page's product description."""
    data = F.from_json(unescape(F.regexp_extract("html", r'(?s)data-product="([^"]*)"', 1)), "struct<description:string,description_short:string>")
    known = details.select(F.col("url").alias("product_url"), X.concentration(F.concat_ws(" ", data["description"], data["description_short"])).alias("__c")).where("__c IS NOT NULL")
    known = known.groupBy("product_url").agg(F.min("__c").alias("__c"))
    missing = offers.where("concentration IS NULL").join(known, "product_url", "left").withColumn("concentration", F.col("__c")).select(*offers.columns)
    return offers.where("concentration IS NOT NULL").unionByName(missing)


# -- collection pages ----------------------------------------------------------------------------------------------


def accords(pages: DataFrame) -> DataFrame:
    """(url, position, accord, strength): bars after the heading "main accords", widths in whole percent, halves to even."""
    after = F.regexp_extract("html", r"(?is)main accords(.*?)(?:<h[1-6]\b|$)", 1)
    bar = r'(?is)<div\b[^>]*\bstyle="[^"]*\bwidth:\s*([\d.]+)%[^"]*"[^>]*>\s*([^<]+?)\s*</div>'
    pairs = F.arrays_zip(F.regexp_extract_all(after, F.lit(bar), 1).alias("w"), F.regexp_extract_all(after, F.lit(bar), 2).alias("n"))
    out = pages.select("url", F.posexplode(pairs).alias("position", "x"))
    return out.select("url", "position", unescape(F.col("x.n")).alias("accord"), F.bround(F.col("x.w").cast("decimal(10,4)"), 0).cast("int").alias("strength"))


def notes(pages: DataFrame) -> DataFrame:
    """(url, tier, position, name) of the pyramid's three levels, in order."""
    level = r'(?is)<pyramid-level-new\b[^>]*\bnotes="(top|middle|base)"[^>]*>(.*?)</pyramid-level-new>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(level), 1).alias("tier"), F.regexp_extract_all("html", F.lit(level), 2).alias("body"))
    out = pages.select("url", F.posexplode(pairs).alias("l", "x"))
    names = F.regexp_extract_all("x.body", F.lit(r'(?is)class="pyramid-note-label"[^>]*>\s*([^<]+?)\s*<'), 1)
    return out.select("url", F.col("x.tier").alias("tier"), F.posexplode(names).alias("position", "name")).withColumn("name", unescape(F.col("name")))


def sealed_payload(pages: DataFrame, name: str = "similar_perfumes") -> DataFrame:
    """(url, payload) of the object that a script assigns to `name`, where it is JSON."""
    body = F.regexp_extract("html", rf"(?s)\blet\s+{name}\s*=\s*(\{{.*?\}})\s*;", 1)
    return pages.select("url", body.alias("payload")).where(F.try_parse_json("payload").isNotNull() & (F.col("payload") != ""))


def similar_items(payloads: DataFrame, hosts: list[str], host: str) -> DataFrame:
    """(url, position, brand, name, similar_url) of decoded payloads: entries with all fields on an allowed host, each url once."""
    kind = "struct<similar_perfumes:array<struct<perfume:struct<dizajner:string,naslov:string,perfume_url:string>>>>"
    rows = payloads.select("url", F.posexplode(F.from_json("payload", kind)["similar_perfumes"]).alias("position", "x")).select("url", "position", F.trim("x.perfume.dizajner").alias("brand"), F.trim("x.perfume.naslov").alias("name"), F.col("x.perfume.perfume_url").alias("raw"))
    full = F.when(F.startswith("raw", F.lit("/")), F.concat(F.lit(f"https://{host}"), "raw")).otherwise(F.col("raw"))
    rows = rows.withColumn("similar_url", X.canonical_page(full, hosts, host)).where("brand <> '' AND name <> '' AND similar_url IS NOT NULL")
    return rows.groupBy("url", "similar_url").agg(F.min_by(F.struct("position", "brand", "name"), "position").alias("x")).select("url", "x.*", "similar_url")


def owned_json(payloads: DataFrame, hosts: list[str], host: str) -> DataFrame:
    """(url, position, item_url): the first shelf of owned items in decoded shelf data, each url once."""
    shelves = F.from_json("payload", "array<struct<type:string,field:string,value:string,perfumes:array<struct<url:string>>>>")
    own = F.get(F.filter(shelves, lambda s: (s["type"] == "wardrobe") & (s["field"] == "relation") & (s["value"] == "have")), F.lit(0))
    rows = payloads.select("url", F.posexplode(own["perfumes"]).alias("position", "p"))
    return _canonical(rows.select("url", "position", F.col("p.url").alias("raw")), hosts, host)


def owned_html(pages: DataFrame, hosts: list[str], host: str, labels: tuple[str, ...] = ("perfumes i have", "i have", "have", "owned"), most: int = 10) -> DataFrame:
    """The same from a rendered page: the nearest ancestor, up to `most` levels, of the shelf's label that holds item links. Pages without one: `owned_errors`."""
    found = _shelves(pages, labels, most)
    return _canonical(found.where("error IS NULL").select("url", "position", "raw"), hosts, host)


def owned_errors(pages: DataFrame, labels: tuple[str, ...] = ("perfumes i have", "i have", "have", "owned"), most: int = 10) -> DataFrame:
    """(store_slug, url, error) of pages on which no shelf of owned items was found."""
    return _shelves(pages, labels, most).where("error IS NOT NULL").select("store_slug", "url", "error")


def _shelves(pages: DataFrame, labels: tuple[str, ...], most: int) -> DataFrame:
    wanted = set(labels)

    def rule(root: Node, url: str) -> list[dict]:
        for node in root.all():
            own = _own_text(node).lower()
            if (own.rsplit(" (", 1)[0] if own.endswith(")") else own) not in wanted:
                continue
            at = node
            for _ in range(most):
                if at is None:
                    break
                links = [a.attrs["href"] for a in at.all("a", attr="href") if "/perfume/" in (a.attrs["href"] or "")]
                if links:
                    return [{"raw": x} for x in links]
                at = at.parent
        raise ValueError("no shelf of owned items")

    return each_page(pages, rule, ["raw"])


def _canonical(rows: DataFrame, hosts: list[str], host: str) -> DataFrame:
    full = F.when(F.startswith("raw", F.lit("/")), F.concat(F.lit(f"https://{host}"), "raw")).otherwise(F.col("raw"))
    rows = rows.withColumn("item_url", X.canonical_page(full, hosts, host)).where("item_url IS NOT NULL")
    return rows.groupBy("url", "item_url").agg(F.min("position").alias("position")).select("url", "position", "item_url")


# -- all stores ----------------------------------------------------------------------------------------------------

Extractor = Callable[[DataFrame], DataFrame]


def extract_offers(pages: DataFrame, extractors: dict[str, Extractor], cards: DataFrame | None = None, place: bool = False, by: str = "store_slug") -> tuple[DataFrame, DataFrame]:
    """Raw offers of all pages, each by the extractor that the column `by` names, and (store_slug, url, error) of pages that gave none.

    With `cards`, offers take the brand and title that their page does not tell from their listing card; `place` as in `to_offers`. What the extractors
    find is written once. Names of one extractor are read in one scan, and where the table is laid out by that column (`write_pages`) each scan reads its own files alone.
    """
    names: dict[Extractor, list[str]] = {}
    for name, extractor in extractors.items():
        names.setdefault(extractor, []).append(name)
    raw = written(reduce(lambda a, b: a.unionByName(b), [f(pages.where(F.col(by).isin(own))) for f, own in names.items()]))
    found = raw.groupBy("store_slug", "url").agg(F.max("error").alias("e"), F.count_if(F.col("error").isNull()).alias("n"))
    errors = pages.select("store_slug", "url").join(found, ["store_slug", "url"], "left").where("n IS NULL OR n = 0")
    offers = to_offers(raw if cards is None else with_cards(raw, cards), place)
    return offers, errors.select("store_slug", "url", F.coalesce("e", F.lit("structure not recognised")).alias("error"))


def write_pages(pages: DataFrame, path: str, by: str = "store_slug") -> None:
    """Raw pages as a table laid out by store, or by extractor; a store with very many pages has several files."""
    pages.write.partitionBy(by).mode("append").parquet(path)

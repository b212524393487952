"""Column expressions that normalise free-text titles; no per-row Python."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of concentrations, first match wins; results must be exactly these.
CONCENTRATIONS = [
    (r"\beau\s+de\s+parfume?\b", "EDP"),
    (r"\bapa\s+de\s+parfume?\b", "EDP"),
    (r"\be\.?\s?d\.?\s?p\.?\b", "EDP"),
    (r"\beau\s+de\s+toilette\b", "EDT"),
    (r"\bapa\s+de\s+toaleta\b", "EDT"),
    (r"\be\.?\s?d\.?\s?t\.?\b", "EDT"),
    (r"\beau\s+de\s+cologne\b", "EDC"),
    (r"\bedc\b", "EDC"),
    (r"\bextrait\s+de\s+parfume?\b", "Extrait"),
    (r"\bextract\s+de\s+parfume?\b", "Extrait"),
    (r"\bextrait\b", "Extrait"),
    (r"\bextract\b", "Extrait"),
    (r"\bcologne\b", "EDC"),
    (r"\bparfume?\b", "Parfum"),
    (r"\bparfem\b", "Parfum"),
]
# Titles that are no regular bottle, first match wins.
EXCLUSIONS = [
    (r"\brefill\b", "refill"),
    (r"\bgift\s+set\b", "gift_set"),
    (r"\bset\s+cadou\b", "gift_set"),
    (r"\bcoffret\b", "gift_set"),
    (r"\bdiscovery\s+set\b", "discovery_set"),
    (r"\bsample\s+set\b", "sample"),
    (r"\bsamples?\b", "sample"),
    (r"\besantion\w*\b", "sample"),
    (r"\bmostr[ae]\w*\b", "sample"),
    (r"\bdecant\w*\b", "decant"),
    (r"\bminiatur\w*\b", "miniature"),
    (r"\bbundle\b", "bundle"),
    (r"\brezerv[ae]\w*\b", "refill"),
]
# Names that mean one brand.
BRAND_GROUPS = [
    ("dior", "christian dior"),
    ("initio", "initio parfums prives"),
    ("jean paul gaultier", "jean p. gaultier"),
]
# Words that are no part of a name.
NOISE = [
    r"\bpentru\s+(femei|barbati|copii)\b|\bfor\s+(women|men|kids)\b|\bunisex\b|\b(?:femei|barbati|copii)\b",
    r"\bcollection\s+noire?\b",
    r"\baromatix\b",
    "[\"'‘’“”,]|(?<!\\S)-(?!\\S)",
]
# Words after a brand, the form of a volume, words that mean out of stock.
COMPANY_WORDS = r"(?:perfumes?|parfums?|fragrances?|cosmetics?)"
VOLUME = r"\b(\d{1,4})\s*ml\b"
OUT_OF_STOCK_WORDS = ("epuizat", "indisponibil", "nu este")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters with one plain form, those forms, and letters with longer ones, by Unicode's compatibility decomposition."""
    one, plain, longer = [], [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x200B), *range(0xFB00, 0xFB07)]:
        form = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if form == chr(code) or not form:
            continue
        if len(form) == 1:
            one.append(chr(code))
            plain.append(form)
        else:
            longer.append((chr(code), form))
    return "".join(one), "".join(plain), longer


def strip_diacritics(text: Column) -> Column:
    """Plain letters for accented and compatibility ones of the Latin ranges; loose combining marks go."""
    one, plain, longer = _folds()
    folded = F.regexp_replace(F.translate(text, one, plain), r"\p{M}", "")
    several = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), longer, folded)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(several)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Brands and names: plain letters, lower case, single spaces."""
    return collapse_whitespace(F.lower(strip_diacritics(text)))


def first_label(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The label of the first pattern found in the plain, lower-cased text, else null."""
    label = lambda plain: reduce(lambda out, p: F.when(plain.rlike(p[0]), p[1]).otherwise(out), reversed(patterns), F.lit(None).cast("string"))
    return F.get(F.transform(F.array(F.lower(strip_diacritics(text))), label), F.lit(0))  # the plain text is made once, not for each pattern


def concentration(text: Column) -> Column:
    return first_label(text, CONCENTRATIONS)


def exclusion(text: Column) -> Column:
    return first_label(text, EXCLUSIONS)


def without_concentration(text: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p[0], " "), CONCENTRATIONS, text)


def volume_ml(text: Column, given: Column | None = None) -> Column:
    """A given volume of 1 to 1000, or null outside; without one, the first number before ml, under the same bounds."""
    found = F.try_to_number(F.nullif(F.regexp_extract(text, "(?iU)" + VOLUME, 1), F.lit("")), F.lit("9999")).cast("int")
    found = F.when(found.between(1, 1000), found)
    return found if given is None else F.when(given.isNotNull(), F.when(given.between(1, 1000), given.cast("int"))).otherwise(found)


def without_volume(text: Column) -> Column:
    return F.regexp_replace(text, "(?iU)" + VOLUME, " ")


def is_tester(text: Column) -> Column:
    plain = strip_diacritics(text)
    return plain.rlike(r"(?i)\btester\b") | plain.rlike(r"(?<=[a-z])Tester\b")


def without_tester(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\btester\b", " ")


def core_name(title: Column, brand: Column | None = None) -> Column:
    """What remains of a title without its brand (first place only, with a company word after it), fields and noise."""
    text = F.lower(strip_diacritics(title))
    if brand is not None:
        plain = F.lower(strip_diacritics(brand))
        pattern = F.concat(F.lit(r"(?s)^(.*?)\b\Q"), F.replace(plain, F.lit(r"\E"), F.lit("")), F.lit(rf"\E\b(?:\s+{COMPANY_WORDS}\b)?"))
        text = F.when(F.coalesce(plain, F.lit("")) == "", text).otherwise(F.regexp_replace(text, pattern, F.lit("$1 ")))
    text = without_tester(without_volume(without_concentration(text)))
    return collapse_whitespace(reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p, " "), NOISE, text))


def title_fields(title: Column) -> Column:
    return F.struct(concentration(title).alias("concentration"), volume_ml(title).alias("volume_ml"), is_tester(title).alias("tester"))


def brand_forms(brand: Column) -> Column:
    """The normalised brand first, then the other names of its group."""
    own = normalize(brand)
    others = F.lit(None).cast("array<string>")
    for group in BRAND_GROUPS:
        for name in group:
            others = F.when(own == name, F.array(*[F.lit(x) for x in group if x != name])).otherwise(others)
    return F.concat(F.array(own), F.coalesce(others, F.array().cast("array<string>")))


def core_name_any_brand(title: Column, brand: Column) -> Column:
    """core_name without the longest of the brand's names that the title holds, or else without the brand as given."""
    forms = F.array_sort(brand_forms(brand), lambda a, b: F.length(b) - F.length(a))
    held = F.filter(forms, lambda x: F.contains(normalize(title), x))
    return core_name(title, F.coalesce(F.get(held, F.lit(0)), brand))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_diacritics(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_key(url: Column) -> Column:
    """The path without slashes at its end, lower-cased; ß and its like stay, unlike under full case folding."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", ""))


def product_page(url: Column, hosts: list[str]) -> Column:
    """(brand, name) of /perfume/<brand>/<name>-<id>.html on one of `hosts`, dashes as spaces; null for other urls."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1)
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    parts = r"^/perfume/([^/]+)/([^/]+)-(\d+)\.html$"
    text = lambda i: F.trim(F.replace(F.regexp_extract(path, parts, i), F.lit("-"), F.lit(" ")))
    return F.when(host.isin(*hosts) & path.rlike(parts), F.struct(text(1).alias("brand"), text(2).alias("name")))


def canonical_page(url: Column, hosts: list[str], host: str) -> Column:
    """https and `host` for a product page on one of `hosts`, without query and fragment; null for other urls."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1)
    return F.when(product_page(url, hosts).isNotNull(), F.concat(F.lit(f"https://{host}"), path))


def shelf_label(text: Column) -> Column:
    """A shelf's label: single spaces, lower case, without a number in brackets at its end."""
    return F.trim(F.regexp_replace(F.lower(collapse_whitespace(text)), r"\s*\(\d+\)$", ""))


def availability(text: Column, markers: tuple[str, ...] = OUT_OF_STOCK_WORDS) -> Column:
    plain = F.lower(strip_diacritics(text))
    return F.when(reduce(lambda a, b: a | b, [F.contains(plain, F.lit(x)) for x in markers]), "out_of_stock").otherwise("in_stock")


def concentration_or_p(text: Column) -> Column:
    """concentration, or Parfum for a title that ends in "- P"."""
    return F.coalesce(concentration(text), F.when(text.rlike(r"-\s*P\s*$"), "Parfum"))


def without_brackets(text: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(text, r"\([^)]*\)", " "))


def last_segment(url: Column) -> Column:
    """The last part of a url's path as text."""
    return F.replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$|/+$", ""), "([^/]*)/*$", 1), F.lit("-"), F.lit(" "))


def label(brand: Column, name: Column) -> Column:
    return F.concat_ws(" ", brand, name)

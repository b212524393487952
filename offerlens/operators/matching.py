"""Matching of candidates to the catalog: blocking by brand, then one decision for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions import similarity as S
from offerlens.functions import text as T

HIGH, AMBIGUOUS = 90, 70


def _prepared(df: DataFrame, side: str) -> DataFrame:
    """Normalised and sorted names of the catalog or candidate side, once for each row instead of each pair."""
    name = "candidate_name" if side == "c" else "name"
    out = df.withColumn(f"__{side}", T.normalize(F.col(name)))
    out = out.withColumn(f"__{side}w", S.words(F.col(f"__{side}"))).withColumn(f"__{side}s", F.array_join(F.array_sort(f"__{side}w"), " "))
    out = out.withColumn(f"__{side}l", S.counted_letters(F.col(f"__{side}s")))
    out = out.withColumn("__tp", S.places(F.col("__ts"))) if side == "t" else out
    return out.withColumn("__x", T.exclusion(F.col("raw_title"))) if side == "c" else out


def candidate_pairs(catalog: DataFrame, candidates: DataFrame) -> DataFrame:
    """Catalog rows (perfume_id, brand, name) with candidates of their brand under any of its names.

    An equi-join on the brand: a brand with very many candidates is split by Spark's skew handling, the catalog side being small.
    """
    forms = _prepared(catalog, "t").withColumn("__brand", F.explode(F.array_distinct(T.brand_forms(F.col("brand")))))
    if {"candidate_name", "raw_title"} <= set(candidates.columns):
        candidates = _prepared(candidates, "c")
    return candidates.withColumn("__brand", T.normalize(F.col("candidate_brand"))).join(forms, "__brand").drop("__brand")


def likely_pairs(catalog: DataFrame, candidates: DataFrame, ambiguous: int = AMBIGUOUS) -> DataFrame:
    """Those of `candidate_pairs` on which `decide` can come to more than a mismatch: names that are equal, known, within each other, or near enough by length and letters.

    The bounds are exact and part of the join, so of a brand's pairs only these become rows. Candidates that no name can help (excluded, or without concentration or volume) are left out.
    """
    able = candidates.where(T.exclusion(F.col("raw_title")).isNull() & F.col("concentration").isNotNull() & F.col("volume_ml").isNotNull())
    near = (S.ratio_bound(F.col("__cs"), F.col("__ts"), True) >= ambiguous) & (S.letters_bound(F.col("__cl"), F.col("__tl")) >= ambiguous)
    known = F.coalesce(F.array_contains("aliases", F.col("__c")), F.lit(False))
    return candidate_pairs(catalog, able).where((F.col("__c") == F.col("__t")) | known | near | S.arrays_within(F.col("__tw"), F.col("__cw")))


def match_counts(catalog: DataFrame, candidates: DataFrame, found: DataFrame, candidate: str = "candidate_id") -> DataFrame:
    """(candidate, compared, accepted, doubtful, mismatched) of each candidate, from the rows of `found` (decided likely pairs) and the number of its brand's names alone."""
    forms = catalog.select("perfume_id", F.explode(F.array_distinct(T.brand_forms(F.col("brand")))).alias("__brand"))
    names = forms.groupBy("__brand").agg(F.count("*").alias("compared"))
    level = found.groupBy(candidate).agg(F.count_if(usable()).alias("accepted"), F.count_if((F.col("confidence") == "ambiguous") & F.col("score").isNotNull()).alias("doubtful"))
    out = candidates.select(candidate, T.normalize(F.col("candidate_brand")).alias("__brand")).join(names, "__brand", "left").join(level, candidate, "left")
    out = out.fillna(0, ["compared", "accepted", "doubtful"])
    return out.select(candidate, "compared", "accepted", "doubtful", (F.col("compared") - F.col("accepted") - F.col("doubtful")).alias("mismatched"))


def targeted_pairs(catalog: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the perfume (perfume_id) that they were found for, whatever their brand; one without a brand has the perfume's."""
    pairs = _prepared(candidates, "c").join(_prepared(catalog, "t"), "perfume_id")
    return pairs.withColumn("candidate_brand", F.coalesce(F.nullif(F.col("candidate_brand"), F.lit("")), F.col("brand")))


def with_aliases(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """The catalog with each perfume's confirmed names as an array, null where it has none."""
    names = aliases.groupBy("perfume_id").agg(F.array_sort(F.collect_set("normalized_alias")).alias("aliases"))
    return catalog.drop("aliases").join(names, "perfume_id", "left")


def normalised_catalog(catalog: DataFrame) -> DataFrame:
    """Brand and name without white space at their ends, and their normalised forms."""
    brand, name = F.trim("brand"), F.trim("name")
    return catalog.withColumns({"brand": brand, "name": name, "normalized_brand": T.normalize(brand), "normalized_name": T.normalize(name)})


def names_brand(title, brand):
    """Whether the title holds one of the brand's names."""
    plain = T.normalize(title)
    return F.exists(T.brand_forms(brand), lambda x: F.contains(plain, x))


#: Names of brands that every task holds; with more of them titles and brands are shuffled.
NAMES = 100_000


def titles_with_brands(titles: DataFrame, catalog: DataFrame, title: str = "title", most: int = 4, held: int = NAMES) -> DataFrame:
    """Each title with each brand of the catalog of which it holds a name, anywhere in its normalised text; (titles' columns, brand), once for each brand.

    A name in a title begins with its own first letters, up to `most`: titles meet brands by their runs of so many letters, and what meets is looked at as a whole.
    A title is as many rows as it has runs, so up to `held` names are sent to the titles, and beyond both sides are shuffled; the titles' rows are never broadcast.
    """
    forms = catalog.select("brand").distinct().select("brand", F.explode(T.brand_forms(F.col("brand"))).alias("__form")).where("__form <> ''")
    heads = forms.withColumn("__head", F.left("__form", F.lit(most)))
    sizes = F.array_sort(F.array_distinct(F.collect_list(F.length("__head"))))  # numbers from 1 to `most`
    own = titles.withColumns({"__row": F.monotonically_increasing_id(), "__plain": T.normalize(F.col(title))})
    at = F.sequence(F.lit(1), F.length("__plain"))
    runs = F.array_distinct(F.flatten(F.transform("__sizes", lambda n: F.transform(at, lambda i: F.substring(F.col("__plain"), i, n)))))
    dealt = own.where("__plain <> ''").withColumn("__sizes", heads.agg(sizes).scalar()).withColumn("__head", F.explode(runs))
    met = dealt.join(F.broadcast(heads), "__head") if forms.limit(held + 1).count() <= held else dealt.hint("merge").join(heads, "__head")
    return met.where(F.contains("__plain", F.col("__form"))).select(*titles.columns, "__row", "brand").distinct().drop("__row")


def decide(pairs: DataFrame, high: int = HIGH, ambiguous: int = AMBIGUOUS, brand_checked: bool = False) -> DataFrame:
    """confidence, reason and score of each pair.

    Columns: brand, name, aliases (array or null), raw_title, candidate_brand, candidate_name, concentration, volume_ml. The
    score is computed only where names differ and their lengths allow `ambiguous` of it, or all words are within; thresholds
    hold for it as it is. The score returned is in whole numbers, halves to even, and null where the names were not the reason.
    """
    brand_ok = F.lit(True) if brand_checked else F.array_contains(T.brand_forms(F.col("candidate_brand")), T.normalize(F.col("brand")))
    for side in ("c", "t"):
        if f"__{side}" not in pairs.columns:
            pairs = _prepared(pairs, side)
    out = pairs.withColumns({"__b": brand_ok, "__in": S.arrays_within(F.col("__tw"), F.col("__cw"))})
    a, b, x, y, inside = F.col("__c"), F.col("__t"), F.col("__cs"), F.col("__ts"), F.col("__in")
    reach = (S.ratio_bound(x, y, True) >= ambiguous) & (S.letters_bound(F.col("__cl"), F.col("__tl")) >= ambiguous)
    asked = F.col("__x").isNull() & F.col("__b") & (a != b) & (reach | inside)
    out = out.withColumn("__s", F.when(asked, S.token_sort_ratio(y, x, True, F.col("__tp"))))
    s = F.coalesce("__s", F.lit(0.0))
    whole = F.bround("__s", 0).cast("int")
    known = F.coalesce(F.array_contains("aliases", a), F.lit(False))
    ladder = [
        (F.col("__x").isNotNull(), "rejected", F.concat(F.lit("excluded:"), F.col("__x"))),
        (~F.col("__b"), "rejected", F.lit("brand_mismatch")),
        (F.col("concentration").isNull() | F.col("volume_ml").isNull(), "ambiguous", F.lit("missing_variant_fields")),
        (a == b, "exact", F.lit(None).cast("string")),
        (known, "exact", F.lit("confirmed_name_alias")),
        (s >= high, "high_confidence", F.concat(F.lit("name_fuzzy_score="), whole)),
        (s >= ambiguous, "ambiguous", F.concat(F.lit("name_fuzzy_score="), whole)),
        (inside, "ambiguous", F.concat(F.lit("name_containment_score="), whole)),
    ]
    confidence, reason = F.lit("rejected"), F.lit("name_mismatch")
    for test, level, why in reversed(ladder):
        confidence, reason = F.when(test, level).otherwise(confidence), F.when(test, why).otherwise(reason)
    out = out.withColumns({"confidence": confidence, "reason": reason})
    by_name = F.coalesce(F.col("reason").rlike("^name_(fuzzy|containment)_score="), F.lit(False))
    return out.withColumn("score", F.when(by_name, whole)).drop("__x", "__b", "__c", "__t", "__cs", "__ts", "__cw", "__tw", "__cl", "__tl", "__tp", "__in", "__s")


def usable(confidence: str = "confidence"):
    return F.col(confidence).isin("exact", "high_confidence")


def plausible(candidate, target, threshold: int = AMBIGUOUS):
    """Cheap test before costly work: equal names, a sufficient score, or all words within."""
    reach = S.ratio_bound(candidate, target) >= threshold
    score = F.when(reach, S.token_sort_ratio(candidate, target))
    return (candidate == target) | (F.coalesce(score, F.lit(0.0)) >= threshold) | S.words_within(target, candidate)

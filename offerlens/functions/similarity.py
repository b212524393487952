"""Name similarity: the ratio of sorted words, exact bounds on it, and word containment; no per-row Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a name that one whole number holds a bit for; sums of two such numbers and a carry stay below 2^63.
WORD = 62


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def counted_letters(text: Column) -> Column:
    """Each letter with how many of it there are up to there, as a number: names share as many of these as their bags of letters do."""
    own = letters(text)
    return F.transform(own, lambda c, i: F.ascii(c).cast("long") * 2**32 + F.size(F.filter(F.slice(own, 1, i + 1), lambda x: x == c)))


def places(text: Column) -> Column:
    """For each WORD letters of a text, a map from letter to the bits of its places."""

    def one(part: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        entry = lambda c: F.struct(c.alias("c"), F.aggregate(F.transform(part, lambda x, i: F.when(x == c, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("bits"))
        return F.map_from_entries(F.transform(F.array_distinct(part), entry))

    own = letters(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(WORD)), lambda i: i < F.size(own))
    return F.transform(starts, lambda i: one(F.slice(own, i + 1, WORD)))


def common_letters(a: Column, b: Column, places_of_a: Column | None = None) -> Column:
    """Length of the longest common subsequence. `places_of_a`: `places` of `a`, where it is at hand.

    A bit for each letter of `a`, in as many whole numbers as it needs: for each letter of `b`, one addition with a carry moves the
    bits at which the subsequence grows; what is 0 in the end is its length.
    """
    zero = F.lit(0).cast("long")
    full = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    n, other = F.length(a), letters(b)
    bits = lambda i: F.least(n - i * WORD, F.lit(WORD)).cast("int")
    mask = lambda found, c: F.coalesce(F.try_element_at(found, c), zero)

    def short(p: Column) -> Column:
        masks = F.transform(other, lambda c: mask(F.get(p, F.lit(0)), c))
        step = lambda row, m: (row + row.bitwiseAND(m)).bitwiseOR(row.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full(n))
        return n - F.bit_count(F.aggregate(masks, full(n), step))

    def long(p: Column) -> Column:
        def step(rows: Column, c: Column) -> Column:
            def word(s: Column, i: Column) -> Column:
                row, m = F.get(rows, i), mask(F.get(p, i), c)
                total = row + row.bitwiseAND(m) + s["carry"]
                grown = total.bitwiseAND(full(bits(i))).bitwiseOR(row.bitwiseAND(F.bitwise_not(m)))
                return F.struct(F.call_function("shiftright", total, bits(i)).alias("carry"), F.concat(s["rows"], F.array(grown)).alias("rows"))

            start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("rows"))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, word)["rows"]

        rows = F.aggregate(other, F.transform(p, lambda _, i: full(bits(i))), step)
        return n - F.aggregate(rows, F.lit(0), lambda s, row: s + F.bit_count(row))

    none = F.least(n, F.length(b)) == 0
    # the map is made once for both uses
    return F.get(F.transform(F.array(places(a) if places_of_a is None else places_of_a), lambda p: F.when(a.isNull() | b.isNull(), None).when(none, 0).when(n <= WORD, short(p)).otherwise(long(p))), F.lit(0))


def token_sort_ratio(a: Column, b: Column, are_sorted: bool = False, places_of_a: Column | None = None) -> Column:
    """200 times the common subsequence of the sorted words over both lengths."""

    def ratio(x: Column, y: Column) -> Column:
        total = F.length(x) + F.length(y)
        return F.when(total == 0, 100.0).otherwise(F.try_divide(200.0 * common_letters(x, y, places_of_a), total.cast("double")))

    if are_sorted:
        return F.when(a.isNotNull() & b.isNotNull(), ratio(a, b))
    pair = F.when(a.isNotNull() & b.isNotNull(), F.struct(sorted_words(a).alias("x"), sorted_words(b).alias("y")))
    return F.get(F.transform(F.array(pair), lambda p: F.when(p.isNotNull(), ratio(p["x"], p["y"]))), F.lit(0))


def ratio_bound(a: Column, b: Column, are_sorted: bool = False) -> Column:
    """What token_sort_ratio cannot exceed, by lengths alone."""
    x, y = (F.length(c if are_sorted else sorted_words(c)) for c in (a, b))
    return F.when(x + y == 0, 100.0).otherwise(F.try_divide(200.0 * F.least(x, y), (x + y).cast("double")))


def letters_bound(counted_a: Column, counted_b: Column) -> Column:
    """What it cannot exceed by the letters that both have, each as often; of `counted_letters` of the sorted words."""
    total = F.size(counted_a) + F.size(counted_b)
    return F.when(total == 0, 100.0).otherwise(F.try_divide(200.0 * F.size(F.array_intersect(counted_a, counted_b)), total.cast("double")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def words_within(target: Column, candidate: Column) -> Column:
    """All words of the target, at least one, are words of the candidate."""
    return arrays_within(words(target), words(candidate))


def arrays_within(target: Column, candidate: Column) -> Column:
    return (F.size(target) > 0) & (F.size(F.array_except(target, candidate)) == 0)

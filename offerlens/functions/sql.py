"""The normalisers and the similarity under names for SQL text: functions with an expression as body, so plans stay free of Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from offerlens.functions import similarity as S
from offerlens.functions import text as X


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _labels(patterns: list[tuple[str, str]]) -> str:
    """The label of the first pattern found; the plain text is made once."""
    cases = " ".join(f"WHEN p RLIKE {_quoted(pattern)} THEN {_quoted(label)}" for pattern, label in patterns)
    return f"get(transform(array(lower(plain_letters(x))), p -> CASE {cases} END), 0)"


def _plain() -> str:
    one, plain, longer = X._folds()
    out = f"regexp_replace(translate(x, {_quoted(one)}, {_quoted(plain)}), {_quoted(chr(92) + 'p{M}')}, '')"
    for letter, form in longer:
        out = f"replace({out}, {_quoted(letter)}, {_quoted(form)})"
    return f"CASE WHEN octet_length(x) = char_length(x) THEN x ELSE {out} END"


def _without(text: str, patterns: list[str]) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, {_quoted('(?i)' + pattern)}, ' ')"
    return text


def definitions() -> dict[str, str]:
    """Name and arguments of each function, what it returns, and its body; later ones use those before."""
    q = _quoted
    money = "DECIMAL(10,2)"
    brand = f"concat({q(r'(?s)^(.*?)' + chr(92) + 'b' + chr(92) + 'Q')}, replace(lower(plain_letters(brand)), {q(chr(92) + 'E')}, ''), {q(chr(92) + 'E' + chr(92) + 'b(?:' + chr(92) + 's+' + X.COMPANY_WORDS + chr(92) + 'b)?')})"
    fields = [p for p, _ in X.CONCENTRATIONS]
    comma = r"(?U)(\d+(?:[.\s]\d{3})*),(\d{2})"
    mask = lambda row: f"coalesce(try_element_at(get(p.places, {row}), c), 0L)"
    bits = f"int(least(length(p.a) - i * {S.WORD}, {S.WORD}))"
    total = f"(get(rows, i) + (get(rows, i) & {mask('i')}) + s.carry)"
    word = f"named_struct('carry', shiftright({total}, {bits}), 'rows', concat(s.rows, array(({total} & (shiftleft(1L, {bits}) - 1)) | (get(rows, i) & ~{mask('i')}))))"
    grown = f"aggregate(letters_of(p.b), transform(p.places, (x, i) -> shiftleft(1L, {bits}) - 1), (rows, c) -> aggregate(sequence(0, size(p.places) - 1), named_struct('carry', 0L, 'rows', cast(array() AS ARRAY<BIGINT>)), (s, i) -> {word}).rows)"
    return {
        "plain_letters(x STRING) RETURNS STRING": _plain(),
        "single_spaces(x STRING) RETURNS STRING": f"trim(regexp_replace(x, {q('(?U)' + chr(92) + 's+')}, ' '))",
        "normalized(x STRING) RETURNS STRING": "single_spaces(lower(plain_letters(x)))",
        "concentration_of(x STRING) RETURNS STRING": _labels(X.CONCENTRATIONS),
        "exclusion_of(x STRING) RETURNS STRING": _labels(X.EXCLUSIONS),
        "volume_of(x STRING) RETURNS INT": f"get(filter(array(int(nullif(regexp_extract(x, {q('(?iU)' + X.VOLUME)}, 1), ''))), v -> v BETWEEN 1 AND 1000), 0)",
        "is_tester(x STRING) RETURNS BOOLEAN": f"plain_letters(x) RLIKE {q('(?i)' + chr(92) + 'btester' + chr(92) + 'b')} OR plain_letters(x) RLIKE {q('(?<=[a-z])Tester' + chr(92) + 'b')}",
        "core_name(title STRING, brand STRING) RETURNS STRING": "single_spaces(" + _without(
            f"CASE WHEN coalesce(lower(plain_letters(brand)), '') = '' THEN lower(plain_letters(title)) ELSE regexp_replace(lower(plain_letters(title)), {brand}, '$1 ') END", [*fields, "(?U)" + X.VOLUME, r"\btester\b", *X.NOISE]) + ")",
        "page_slug(x STRING) RETURNS STRING": "regexp_replace(regexp_replace(lower(plain_letters(x)), '[^a-z0-9]+', '-'), '^-+|-+$', '')",
        "comma_price(x STRING) RETURNS " + money: f"CASE WHEN x RLIKE {q(comma)} THEN try_cast(concat(regexp_replace(regexp_extract(x, {q(comma)}, 1), {q('(?U)[.' + chr(92) + 's]')}, ''), '.', regexp_extract(x, {q(comma)}, 2)) AS {money}) END",
        "dot_price(x STRING) RETURNS " + money: f"try_cast(nullif(regexp_extract(x, {q(chr(92) + 'b(' + chr(92) + 'd+' + chr(92) + '.' + chr(92) + 'd{2})' + chr(92) + 'b')}, 1), '') AS {money})",
        "lei_price(x STRING) RETURNS " + money: f"try_cast(nullif(replace(regexp_extract(x, {q('(?iU)(' + chr(92) + 'd{1,3}(?:' + chr(92) + '.' + chr(92) + 'd{3})*)' + chr(92) + 's*lei')}, 1), '.', ''), '') AS {money})",
        f"discount_percent(price {money}, old {money}) RETURNS INT": "CASE WHEN old > 0 AND price < old THEN int(bround(cast(cast(old - price AS DECIMAL(12,2)) * 100 / old AS DECIMAL(20,8)), 0)) END",
        "letters_of(x STRING) RETURNS ARRAY<STRING>": "filter(split(x, ''), c -> c <> '')",
        "sorted_words(x STRING) RETURNS STRING": f"array_join(array_sort(filter(split(x, {q('(?U)' + chr(92) + 's+')}), w -> w <> '')), ' ')",
        "letter_places(x STRING) RETURNS ARRAY<MAP<STRING, BIGINT>>": f"transform(filter(sequence(0, greatest(size(letters_of(x)) - 1, 0), {S.WORD}), i -> i < char_length(x)), i -> get(transform(array(slice(filter(split(x, ''), c -> c <> ''), i + 1, {S.WORD})), part -> "
        "map_from_entries(transform(array_distinct(part), c -> named_struct('c', c, 'bits', aggregate(transform(part, (y, j) -> if(y = c, shiftleft(1L, j), 0L)), 0L, (u, v) -> u | v))))), 0))",
        "common_letters(a STRING, b STRING) RETURNS INT": f"get(transform(array(named_struct('a', a, 'b', letters_of(b), 'places', letter_places(a))), p -> CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN least(length(a), length(b)) = 0 THEN 0 ELSE length(a) - aggregate({grown.replace('letters_of(p.b)', 'p.b')}, 0, (n, row) -> n + bit_count(row)) END), 0)",
        "indel_ratio(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN length(sorted_words(a)) + length(sorted_words(b)) = 0 THEN 100.0D ELSE 200.0D * common_letters(sorted_words(a), sorted_words(b)) / double(length(sorted_words(a)) + length(sorted_words(b))) END",
    }


def register(spark: SparkSession) -> None:
    """Create the functions in the session, in place of any of the same names."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

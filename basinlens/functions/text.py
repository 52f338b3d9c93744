"""Name keys, fuzzy patterns, query strings, tag removal and slugs."""

from __future__ import annotations

import unicodedata
from functools import cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: those with one such character, what they become, and the others."""
    single, longer = {}, {}
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000:
            plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if plain:
                (single if len(plain) == 1 else longer)[chr(code)] = plain
    return "".join(single), "".join(single.values()), longer


def ascii_fold(text) -> Column:
    """Text as ASCII: accents and compatibility forms resolved (ā, ő, ﬁ, ²), other characters left out."""
    single, plain, longer = ascii_folds()
    folded = F.translate(_col(text), single, plain)
    # what becomes several characters is rare, so it is looked up only where such a one stands
    pairs = F.create_map(*[F.lit(v) for pair in longer.items() for v in pair])
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(pairs[c], c)), "")
    several = F.when(folded.rlike(f"[{''.join(longer)}]"), spelled).otherwise(folded)
    return F.regexp_replace(several, r"[^\x00-\x7f]", "")



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_key(name) -> Column:
    """Join key of a place name: case, a trailing "district", punctuation and spaces ignored."""
    key = F.lower(F.regexp_replace(_col(name), r"^\s+|\s+$", ""))
    key = F.regexp_replace(key, r"\s+district$", "")
    key = F.regexp_replace(key, r"[.\-']", "")
    return F.regexp_replace(key, r"\s+", " ")


def fuzzy_pattern(name) -> Column:
    """LIKE pattern in which the vowels a and o match any text."""
    return F.concat(F.lit("%"), F.translate(_col(name), "ao", "%%"), F.lit("%"))


def fuzzy_match(column, name: str) -> Column:
    return _col(column).ilike("%" + name.replace("a", "%").replace("o", "%") + "%")


def rewrite_prefix(column, old: str, new: str) -> Column:
    """Replace ``old`` by ``new`` where the text starts with it; other texts stay."""
    c = _col(column)
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 2**31 - 1))).otherwise(c)


def query_params(url) -> Column:
    """``map<string,string>`` of the query string; parts without ``=`` are dropped, the last key wins."""
    url = _col(url)
    at = F.instr(url, "?")
    query = F.when(at > 0, F.substring(url, at + 1, F.length(url)))
    parts = F.filter(F.split(query, "&", -1), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value"),
        ),
    )
    # keep only the last pair of each key, so a repeated key is not an error
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]),
    )
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def query_param(url, key: str) -> Column:
    """One parameter of the query string, decoded; cheaper than the whole map."""
    url = _col(url)
    at = F.instr(url, "?")
    query = F.when(at > 0, F.concat(F.lit("&"), F.substring(url, at + 1, F.length(url))))
    raw = F.regexp_extract(query, "^.*&" + key + "=([^&]*)", 1)
    present = F.regexp_like(query, F.lit("&" + key + "="))
    return F.when(present, F.try_url_decode(raw))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: within lambdas Spark evaluates an expression wherever it stands."""
    return F.transform(F.array(value), use)[0]


def unescape(text) -> Column:
    """Decode named and numeric character references; unknown names stay as written.

    The text is cut before each reference, so decoded text is never decoded again.
    """
    t = _col(text)
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def character(number: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.conv(number, 10, 16), 8, "0")), "UTF-32")

    def replaced(p: Column, ref: Column) -> Column:
        decimal = F.regexp_extract(ref, "^#([0-9]{1,7})$", 1)
        hexadecimal = F.regexp_extract(ref, "^#[xX]([0-9A-Fa-f]{1,6})$", 1)
        number = F.when(decimal != "", character(decimal)).when(hexadecimal != "", character(F.conv(hexadecimal, 16, 10)))
        plain = F.when(ref.startswith("#"), number).otherwise(F.try_element_at(names, ref))
        rest = F.regexp_replace(p, "^&#?[0-9A-Za-z]+;", "")
        return F.when(ref == "", p).otherwise(F.coalesce(once(plain, lambda c: F.concat(c, rest)), p))

    def piece(p: Column) -> Column:
        return once(F.regexp_extract(p, "^&(#?[0-9A-Za-z]+);", 1), lambda ref: replaced(p, ref))

    def decoded(v: Column) -> Column:
        return F.array_join(F.transform(F.split(v, "(?=&#?[0-9A-Za-z]+;)"), piece), "")

    return once(t, lambda v: F.when(v.contains("&"), decoded(v)).otherwise(v))


def collapse_spaces(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"[\s\u00a0]+", " "))


def strip_tags(text) -> Column:
    """Text without tags, trimmed; null when nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(_col(text), r"<[^>]+>", ""), r"^\s+|\s+$", "")
    return F.nullif(plain, F.lit(""))


def ascii_slug(title, max_len: int = 60) -> Column:
    """Lower-case ASCII file stem of a title."""
    stem = F.regexp_replace(_col(title), "^File:", "")
    stem = F.regexp_replace(stem, r"^.*/", "")
    stem = F.regexp_replace(stem, r"(?<=.)\.[^.]+$", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_fold(stem), r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    return F.substring(F.coalesce(F.nullif(slug, F.lit("")), F.lit("photo")), 1, max_len)


def whole_number(text) -> Column:
    """Integer written with thousands separators; null when it is not a number."""
    return F.replace(F.trim(_col(text)), F.lit(","), F.lit("")).try_cast("int")

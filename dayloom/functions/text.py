"""String, URL and HTML functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers count it.
BLANK = r"[\s ﻿]"
#: A link: with a scheme, or beginning with www.
LINK = r"(?:https?://|www\.)[^\s<>\"']+"


def or_default(x, default) -> Column:
    """``x`` unless null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def first_link(content, title) -> Column:
    """The first link in the content, else in the title, else null."""
    hit = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), LINK, 0), F.lit(""))
    return F.coalesce(hit(content), hit(title))


def with_scheme(url) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def segments(text) -> Column:
    """Text and links in order: array of (kind, value); empty texts between links are left out."""
    link = r"https?://[^\s]+"
    gaps, links = F.split(text, link, -1), F.regexp_extract_all(text, F.lit(link), F.lit(0))
    part = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    paired = F.transform(gaps, lambda g, i: F.array(part("text", g), part("url", F.get(links, i))))
    return F.filter(F.flatten(paired), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def _tag(html, pattern) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_title(html) -> Column:
    """The Open Graph title, else the title element, else ``Untitled``."""
    og = _tag(html, r"(?i)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']")
    return or_default(F.coalesce(og, _tag(html, r"(?i)<title>(.*?)</title>")), "Untitled")


def page_description(html) -> Column:
    og = _tag(html, r"(?i)<meta[^>]*property=[\"']og:description[\"'][^>]*content=[\"']([^\"']*)[\"']")
    return F.coalesce(og, _tag(html, r"(?i)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']"), F.lit(""))


def page_text(html) -> Column:
    """The body's text without scripts, styles and tags, blanks collapsed."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"<[^>]+>"):
        body = F.regexp_replace(body, pattern, " ")
    return F.btrim(F.regexp_replace(body, BLANK + "+", " "))


def preview(text, most: int = 1000) -> Column:
    """The beginning of a text, as a link's preview shows it."""
    return F.substring(text, 1, most)


def utf16_length(text) -> Column:
    """The length in UTF-16 units, as browsers count: two for a character beyond the basic plane."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_left(text, most: int) -> Column:
    """The first characters of a text that take no more than ``most`` UTF-16 units; no character is cut in two."""
    units = F.encode(text, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")  # the last unit begins a pair
    cut = F.decode(F.substring(units, F.lit(1), F.when(half, 2 * most - 2).otherwise(2 * most)), "UTF-16BE") if most > 0 else F.when(text.isNotNull(), "")
    return F.when(utf16_length(text) <= most, text).otherwise(cut)


def utf16_remaining(text, most: int) -> Column:
    """How many UTF-16 units a field of ``most`` still takes (below 0: too long); a null is empty."""
    return most - F.coalesce(utf16_length(text), F.lit(0))


def is_web_url(url) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def hostname(url) -> Column:
    """The host of a url, or the url itself where there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def slug(title) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def kebab(name) -> Column:
    return F.regexp_replace(F.lower(name), BLANK + "+", "-")


def title_case(name) -> Column:
    """Hyphens to spaces, the first letter of each word raised, the rest as it is."""
    words = F.split(F.regexp_replace(name, "-", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def first_underscore(code) -> Column:
    """Only the first ``_`` becomes a space."""
    return F.regexp_replace(code, "^([^_]*)_", "$1 ")


def mask_secret(name, value) -> Column:
    """First and last three characters of the value of a setting whose name speaks of a key or secret."""
    secret = F.lower(name).rlike("key|secret")
    return F.when(secret & value.isNotNull(), F.concat(F.left(value, F.lit(3)), F.lit("..."), F.right(value, F.lit(3)))).otherwise(value)


def redact(fields, names) -> Column:
    """A map with the values of the named entries replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*names), F.lit("[redacted]")).otherwise(v))


def initial(name) -> Column:
    return F.upper(F.substring(name, 1, 1))


def two_digits(n) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def sha256_url(text) -> Column:
    """SHA-256 in the URL-safe base64 alphabet, without padding."""
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "-_")


def initials_filled(*parts) -> Column:
    """The non-empty parts, each after its label: (label, column) pairs joined by spaces and trimmed."""
    filled = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c, F.lit(" "))).otherwise("") for label, c in parts]
    return F.btrim(F.concat(*filled))


def numeric_seed(text) -> Column:
    """A seed as a number, or null if it isn't one (blank, words, NaN)."""
    n = F.expr("try_cast(seed as double)") if isinstance(text, str) else text.try_cast("double")
    return F.when(~F.isnan(n) & (F.btrim(text) != ""), n)


def leading_int(text) -> Column:
    """The integer that a text begins with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def short_id(*seed) -> Column:
    """Nine characters of base 36 from a hash of the seed, so that reruns agree."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in seed])), 1, 11), 16, 36)
    return F.lower(F.lpad(digits, 9, "0"))


def pretty_json(value) -> Column:
    """A struct, map or array as indented JSON."""
    return F.to_json(value, {"pretty": "true"})

"""Column functions on text, URLs and identifiers. All are built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolens.operators import rules

#: What rules about white space mean by it.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

#: Any other character.
NOT_SPACE = "[^" + SPACE[1:]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(value) -> str:
    """SQL of a fixed value: a string, a list or a dict of strings or lists. One expression is built faster than a column for each value."""
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(literal, value)) + ")"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(column: str, values) -> Column:
    """Whether a column is one of fixed strings."""
    return F.expr(f"`{column}` IN ({', '.join(map(literal, values))})")


def collapse(c) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), SPACE + "+", " "))


def utf16_length(c) -> Column:
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def decode_entities(c) -> Column:
    """Named references of the policy and numeric ones; others stay. One pass: what a reference yields isn't decoded again."""
    parts = F.regexp_extract_all(_col(c), F.lit(r"(?si)&(?:#x[0-9a-f]{1,6}|#[0-9]{1,7}|[a-z][a-z0-9]*);|[^&]+|&"), F.lit(0))

    def one(p):
        body = F.lower(F.substring(p, 2, 1 << 20))
        name = F.regexp_replace(body, ";$", "")
        code = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        # A character from its code point, by way of UTF-32.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.expr(literal(rules.ENTITIES))[name]
        numeric = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char)
        return F.when(p.startswith("&") & p.endswith(";") & (F.length(p) > 2), F.coalesce(F.when(name.startswith("#"), numeric).otherwise(named), p)).otherwise(p)

    return F.when(_col(c).contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(_col(c))


def escape_text(c) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def slug(c, most: int = 60) -> Column:
    """Lower-case letters and digits joined by hyphens; 'page' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("page"))


def normalize_url(c) -> Column:
    """Without fragment, query and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(_col(c), "[?#].*$", ""), "/+$", "")


def is_content_link(c) -> Column:
    """An https link to a page, not to a file or an interface path."""
    u = F.lower(normalize_url(c))
    return u.startswith("https://") & ~u.rlike(r"\.(?:pdf|jpe?g|png|gif|svg|webp|zip|mp3|mp4|docx?|pptx?|xlsx?|epub)$") & ~u.contains("/@api/")


def host_of(c) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_public_url(c) -> Column:
    """http(s), no credentials, a dotted host that is neither an IP literal nor private."""
    u, host = _col(c), host_of(c)
    return (
        F.lower(u).rlike("^https?://")
        & ~u.rlike(r"^[a-zA-Z]+://[^/?#]*@")
        & host.contains(".")
        & ~host.rlike(r"^[0-9.]+$")
        & ~host.startswith("[")
        & ~host.rlike(r"(?:\.local|\.localhost|\.internal|\.home\.arpa|\.lan)$")
    )


def placed_paragraphs(c) -> Column:
    """Paragraphs of plain text, (i, x), each with its place among the parts that blank lines separate; blank parts are none. A line ends with LF or CRLF."""
    parts = F.transform(F.split(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n+"), lambda p, i: F.struct(i.alias("i"), F.trim(p).alias("x")))
    return F.filter(parts, lambda p: p["x"] != "")


def marked_paragraphs(c) -> Column:
    """An array of (i, x) as markup: paragraphs whose single newlines are breaks."""
    return F.array_join(F.transform(c, lambda p: F.concat(F.lit("<p>"), F.replace(escape_text(p["x"]), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def paragraphize(c) -> Column:
    """Plain text as paragraphs: blank lines separate them, single newlines become breaks."""
    return marked_paragraphs(placed_paragraphs(c))


def fit_alt(c, most: int = rules.MOST_ALT) -> Column:
    """At most `most` UTF-16 units: whole if it fits, else up to the last sentence end after 20 characters, else up to a word with an ellipsis."""
    text = collapse(c)
    # Code points outside the basic plane take two units, so a prefix in units is shortened by their number.
    head = lambda n: F.aggregate(
        F.split(F.substring(text, 1, n), ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("u")),
        lambda a, ch: F.when(a.u + utf16_length(ch) <= n, F.struct(F.concat(a.s, ch).alias("s"), (a.u + utf16_length(ch)).alias("u"))).otherwise(F.struct(a.s.alias("s"), F.lit(1 << 20).alias("u"))), lambda a: a.s,
    )
    prefix, cut = head(most), head(most - 1)
    sentence = F.regexp_extract(prefix, r"(?s)^(.*[.!?])(?=\s|$)", 1)
    word = F.regexp_extract(cut, r"(?s)^(.+) ", 1)
    body = F.rtrim(F.when(word != "", word).otherwise(cut))
    fitted = F.when(utf16_length(sentence) >= 20, F.trim(sentence)).otherwise(F.concat(body, F.lit("…")))
    return F.when(utf16_length(c) <= most, _col(c)).when(utf16_length(text) <= most, text).otherwise(fitted)


def first_sentence(c, least: int = 30) -> Column:
    """Up to the first sentence end after `least` characters that is followed by a capital and isn't an abbreviation."""
    text = collapse(c)
    ends = F.regexp_extract_all(text, F.lit(rf"(?s)^(.{{{least - 1},}}?[.!?])(?= [\p{{Lu}}“\"(])(?<!\b(?:Dr|Mr|Mrs|Ms|St|vs|etc|Fig|No|Prof|Jr|Sr|e\.g|i\.e|al|cf)\.)"), F.lit(1))
    return F.coalesce(F.get(ends, 0), text)


def anchor(c) -> Column:
    """Letters, digits and _.:- kept, other runs as a hyphen."""
    return F.regexp_replace(F.regexp_replace(collapse(c), r"[^\p{L}\p{N}_.:-]+", "-"), "^-+|-+$", "")


def fnv1a(c) -> Column:
    """32-bit FNV-1a over the characters' code units, as a number."""
    return F.aggregate(
        F.filter(F.split(_col(c), ""), lambda x: x != ""), F.lit(2166136261).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619), F.lit(4294967296))
    )

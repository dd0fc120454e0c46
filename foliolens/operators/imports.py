"""The sanitizer for imported pages: stricter than the publishing policy, with a long table of what it took away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import pages as P
from foliolens.operators import rules

# Tags, attributes and schemes of the import policy.
ALLOWED = (
    "a abbr address article aside b bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li mark nav ol p pre q samp "
    "section small span strike strong sub summary sup table tbody td tfoot th thead time tr u ul var"
).split()
DROPPED = "applet audio base embed iframe link object script style svg template video".split()
UNWRAPPED = "button datalist fieldset form input label optgroup option output select textarea".split()
GLOBAL = "dir id lang role title".split()
OWN = {
    "a": "href target", "abbr": "title", "blockquote": "cite", "col": "span", "colgroup": "span", "img": "alt height src title width", "ol": "start type", "q": "cite", "td": "colspan rowspan",
    "th": "abbr colspan rowspan scope",
}
LINKS, MEDIA = ("http", "https", "mailto"), ("http", "https")


def sanitize_import(tokens: DataFrame, tree: DataFrame, key: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, removals): pages (key, html) and removals (key, code, item).

    Active elements go with all inside; form and unknown elements are unwrapped; attributes and schemes are
    fenced; relative links are resolved against `base` or, without one, lose their address. A picture whose bytes aren't packaged gives way to a line
    that says where it was, with its alternative text.
    """
    active = tree.filter(F.col("tag").isin(*DROPPED))
    left = P.strip_chrome(tokens, key, tuple(DROPPED))
    opened = left.filter("kind = 'open'")
    row = lambda df, code, item: df.select(key, F.lit(code).alias("code"), item.alias("item"))
    removals = row(active, "active-removed", F.col("tag")).unionByName(row(opened.filter(F.col("tag").isin(*UNWRAPPED)), "active-removed", F.col("tag")))
    removals = removals.unionByName(row(opened.filter(~F.col("tag").isin(*ALLOWED, *UNWRAPPED)), "unsupported", F.col("tag")))
    packaged = P.url_verdict(F.lit("img"), F.lit("src"), F.coalesce(P.attribute("src"), F.lit(""))) == "ok"
    gone = (F.col("kind") == "open") & (F.col("tag") == "img") & ~(packaged & F.coalesce(P.attribute("src"), F.lit("")).startswith(rules.FILEBASE))
    removals = removals.unionByName(row(left.filter(gone), "image-unavailable", F.coalesce(P.attribute("src"), F.lit(""))))
    alt = T.collapse(F.coalesce(P.attribute("alt"), F.lit("")))
    said = F.concat(F.lit("<span>[Embedded image"), F.when(alt != "", F.concat(F.lit(": "), T.escape_text(alt))).otherwise(""), F.lit("]</span>"))
    every = P.attributes(left.filter(F.col("tag").isin(*ALLOWED)), key)
    left = left.withColumn("_said", F.when(gone, said))
    left = left.withColumns({"kind": F.when(F.col("_said").isNotNull(), "text").otherwise(F.col("kind")), "raw": F.coalesce("_said", "raw")}).drop("_said")
    kept = left.filter((F.col("kind") == "text") | F.col("tag").isin(*ALLOWED))
    own = F.lit(False)
    for tag, names in OWN.items():
        own = own | (F.col("tag") == tag) & F.col("name").isin(*names.split())
    listed = F.col("name").isin(*GLOBAL, *rules.ARIA_ATTRIBUTES) | own
    removals = removals.unionByName(row(every.filter(F.col("name").startswith("on")), "unsafe-attribute", F.col("name")))
    address = F.col("name").isin("href", "src", "cite")
    scheme = P.scheme_of("value")
    fits = scheme.isin("", *LINKS) & ~((F.col("name") == "src") & ~scheme.isin("", *MEDIA))
    target = F.concat_ws(".", "tag", "name")
    removals = removals.unionByName(row(every.filter(listed & address & ~fits), "dangerous-url", target))
    relative = address & (scheme == "") & ~F.col("value").startswith("#") & ~F.col("value").startswith(rules.FILEBASE)
    removals = removals.unionByName(row(every.filter(listed & relative & (F.col("tag") != "img")), "relative-link", target))
    safe = P.attributes(kept, key).filter(listed & (~address | fits))
    safe = safe.withColumn("value", F.when(relative, P.absolutize("value", F.lit(base))).otherwise(F.col("value"))) if base else safe.filter(~relative)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "value"))), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), T.escape_attribute(a["value"]), F.lit('"'))), "")
    written = safe.groupBy(key, "pos").agg(joined.alias("written"))
    out = kept.join(written, [key, "pos"], "left")
    raw = F.when(F.col("kind") == "open", F.concat(F.lit("<"), F.col("tag"), F.coalesce("written", F.lit("")), F.lit(">"))).when(F.col("kind") == "close", F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise(F.col("raw"))
    return P.serialize(out.withColumn("raw", raw), key), removals

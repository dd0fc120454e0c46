"""Colours and contrast as column expressions. A colour is a struct of r, g, b (0-255) and a (0-1); null is invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolens.functions.text import _col, literal

# The 148 named colours of CSS.
_NAMED = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887
cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9
darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b
darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0
forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c
indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2
lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de
lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371
mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080
oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9
peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57
seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8
tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()
NAMES = {name: f"#{digits}" for name, digits in zip(_NAMED[::2], _NAMED[1::2], strict=True)}
AA_NORMAL, AA_LARGE, AAA_NORMAL, AAA_LARGE = 4.5, 3.0, 7.0, 4.5


def rgba(r, g, b, a) -> Column:
    return F.named_struct(F.lit("r"), r.cast("double"), F.lit("g"), g.cast("double"), F.lit("b"), b.cast("double"), F.lit("a"), a.cast("double"))


def parse_color(c) -> Column:
    """Hex with 3, 4, 6 or 8 digits, rgb() and rgba() with commas or blanks, percentages and a slash, and names."""
    return let(_col(c), _parsed)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _parsed(c: Column) -> Column:
    named = F.expr(literal(NAMES))
    return let(F.coalesce(named[F.lower(F.trim(c))], F.lower(F.trim(c))), _read)


def _read(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^#([0-9a-f]{3,8})$", 1)
    twice = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).when(F.length(digits).isin(6, 8), digits)
    byte = lambda i: F.conv(F.substring(twice, i, 2), 16, 10).cast("double")
    hexed = F.when(twice.isNotNull() & (F.length(digits) > 0), rgba(byte(1), byte(3), byte(5), F.when(F.length(twice) == 8, byte(7) / 255).otherwise(F.lit(1.0))))
    number = r"([0-9]*\.?[0-9]+%?)"
    pattern = rf"^rgba?\(\s*{number}\s*[,\s]\s*{number}\s*[,\s]\s*{number}\s*(?:[,/]\s*{number}\s*)?\)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    value = lambda i, of: F.when(part(i).endswith("%"), F.regexp_replace(part(i), "%", "").cast("double") * (of / 100)).otherwise(part(i).try_cast("double"))
    channel = lambda i: F.least(F.lit(255.0), F.greatest(F.lit(0.0), value(i, 255)))
    alpha = F.when(part(4) == "", F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value(4, 1))))
    return F.when(text.startswith("#"), hexed).when(text.rlike(pattern), rgba(channel(1), channel(2), channel(3), alpha))


def _linear(channel: Column) -> Column:
    return let(channel / 255, lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))


def luminance(color: Column) -> Column:
    return let(color, lambda c: 0.2126 * _linear(c["r"]) + 0.7152 * _linear(c["g"]) + 0.0722 * _linear(c["b"]))


def contrast_ratio(a: Column, b: Column) -> Column:
    """The raw ratio; compare this, and report it rounded to two places."""
    return let(F.named_struct(F.lit("x"), luminance(a), F.lit("y"), luminance(b)), lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), (F.greatest(p["x"], p["y"]) + 0.05) / (F.least(p["x"], p["y"]) + 0.05)))


def level(ratio: Column, size) -> Column:
    large = _col(size) == "large"
    return F.when(ratio >= F.when(large, AAA_LARGE).otherwise(AAA_NORMAL), "AAA").when(ratio >= F.when(large, AA_LARGE).otherwise(AA_NORMAL), "AA").otherwise("fail")


def over(top: Column, below: Column) -> Column:
    """One layer over an opaque colour, each channel rounded."""
    mixed = lambda p, k: F.floor(p["t"][k] * p["t"]["a"] + p["b"][k] * (1 - p["t"]["a"]) + 0.5)
    return let(F.named_struct(F.lit("t"), top, F.lit("b"), below), lambda p: F.when(p["t"].isNotNull() & p["b"].isNotNull(), rgba(mixed(p, "r"), mixed(p, "g"), mixed(p, "b"), F.lit(1.0))))


def composite(layers) -> Column:
    """Colour strings from top to bottom over opaque white; those that don't parse are skipped."""
    white = F.when(F.lit(True), rgba(F.lit(255), F.lit(255), F.lit(255), F.lit(1)))  # nullable, as what over() gives
    parsed = F.filter(F.transform(_col(layers), parse_color), lambda c: c.isNotNull())
    return F.aggregate(F.reverse(parsed), white, lambda below, top: over(top, below))


def size_class(px, weight) -> Column:
    return F.when((_col(px) >= 24) | (_col(px) >= 18.66) & (_col(weight) >= 700), "large").otherwise("normal")

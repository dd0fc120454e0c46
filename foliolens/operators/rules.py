"""Rule values of the page policy, as plain data.

Fixed values: tag, attribute, scheme and style lists of the publishing policy, its entities, and the rule names and impacts that audits map.
"""

from __future__ import annotations

ALLOWED_TAGS = (
    "a acronym address area article aside audio b bdo big blockquote br caption cite code col colgroup dd del details dfn div dl dt em embed footer h2 h3 h4 h5 h6 header hr i img ins iframe "
    "kbd legend li map nav object ol p param picture pre q ruby rp rt samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr track tt u ul var video font "
    "source abbr annotation annotation-xml maction maligngroup malignmark math menclose merror mfenced mfrac mglyph mi mlabeledtr mlongdiv mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mscarries mscarry msgroup msline mspace msqrt msrow mstack mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics mark"
).split()
SEMANTIC_TAGS = (
    "main figure figcaption table thead tbody tfoot tr th td caption col colgroup ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote q cite a img area map audio video track iframe embed object "
    "source picture nav header footer section article aside address details summary abbr acronym dfn time del ins ruby rp rt mark legend form fieldset label button input select textarea "
    "optgroup option output datalist"
).split()
VOID_TAGS = "area base br col embed hr img input keygen link meta param source track wbr".split()
DROPPED_SUBTREES = ("script", "style")
GLOBAL_ATTRIBUTES = "style class id title role lang dir".split()
ARIA_ATTRIBUTES = [
    f"aria-{x}"
    for x in (
        "atomic busy controls describedby disabled dropeffect flowto grabbed haspopup hidden invalid label labelledby live owns relevant autocomplete checked expanded level multiline "
        "multiselectable orientation pressed readonly required selected sort valuemax valuemin valuenow valuetext"
    ).split()
]
ELEMENT_ATTRIBUTES = {
    "a": "href target name",
    "abbr": "title",
    "area": "alt coords href shape target",
    "audio": "name src muted controls",
    "blockquote": "cite",
    "col": "span width",
    "colgroup": "span width",
    "embed": "name src type allowfullscreen pluginspage wmode allowscriptaccess width height",
    "font": "face color size",
    "img": "align alt height src title usemap width",
    "iframe": "src width height name align allowfullscreen",
    "map": "name",
    "object": "width height style data type classid codebase",
    "ol": "start type",
    "param": "name value",
    "q": "cite",
    "source": "height media sizes src srcset type width",
    "table": "summary width border cellpadding cellspacing center frame rules",
    "tr": "align valign dir",
    "td": "abbr axis colspan rowspan width align valign dir",
    "th": "abbr axis colspan rowspan width align valign dir scope",
    "ul": "type",
    "video": "name src allowfullscreen muted poster width height controls playsinline",
}
LINK_SCHEMES = "ftp http https mailto skype".split()
WEB_SCHEMES = "http https".split()
URL_ATTRIBUTES = {
    "a": {"href": LINK_SCHEMES},
    "area": {"href": LINK_SCHEMES},
    "img": {"src": WEB_SCHEMES},
    "iframe": {"src": WEB_SCHEMES},
    "embed": {"src": WEB_SCHEMES, "pluginspage": WEB_SCHEMES},
    "audio": {"src": WEB_SCHEMES},
    "video": {"src": WEB_SCHEMES, "poster": WEB_SCHEMES},
    "source": {"src": WEB_SCHEMES, "srcset": WEB_SCHEMES},
    "track": {"src": WEB_SCHEMES},
    "object": {"data": WEB_SCHEMES, "codebase": WEB_SCHEMES, "classid": WEB_SCHEMES},
    "blockquote": {"cite": WEB_SCHEMES},
    "q": {"cite": WEB_SCHEMES},
}
#: What the addresses of files in a cartridge begin with (a fixed value of that format), and the folder that holds ours.
FILEBASE, PACKAGED_FOLDER = "$IMS-CC-FILEBASE$", "packaged"
STYLE_PROPERTIES = (
    "background border border-radius clear color cursor direction display flex float font grid height line-height list-style margin max-height max-width min-height min-width overflow "
    "overflow-x overflow-y padding text-align table-layout text-decoration text-indent vertical-align visibility white-space width zoom"
).split()
STYLE_ROOTS = "background border font margin padding list-style grid flex overflow".split()
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "mdash": "—", "ndash": "–", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "amp": "&",
}
STRUCTURE_RULES = (
    "heading-order p-as-heading list listitem definition-list dlitem region bypass landmark-one-main landmark-unique landmark-banner-is-top-level landmark-complementary-is-top-level "
    "landmark-contentinfo-is-top-level landmark-main-is-top-level landmark-no-duplicate-banner landmark-no-duplicate-contentinfo landmark-no-duplicate-main td-headers-attr th-has-data-cells "
    "td-has-header scope-attr-valid table-duplicate-name table-fake-caption"
).split()
IMPACTS = {"critical": "blocker", "serious": "error", "moderate": "warning", "minor": "advisory"}
MOST_ALT, LEAST_ALT = 120, 6

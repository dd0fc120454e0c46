"""Stored review documents, broken at random, against a reading of every field by hand."""

import base64
import copy
import json
import math
import random

from foliolens.operators import decks

CATEGORIES = ["7.1", "7.2", "7.6"]
IMAGE = {
    "kind": "image", "placement": {"kind": "insert-after", "elementId": "b1"}, "assetName": "a.jpg", "width": 8, "height": 6.5, "alt": "x", "caption": "",
    "attribution": {"text": "t", "sourcePageUrl": "https://s", "licenseName": "L", "licenseUrl": "https://l", "shareAlike": True},
}
ASSET = {"id": "1", "mediaType": "image/jpeg", "extension": "jpg", "sha256": "00", "originPart": "p", "name": "a.jpg", "bytes": base64.b64encode(b"data").decode()}
DOCUMENT = {
    "version": 1, "header": {"assessor": {"name": "N", "title": "T", "college": "C"}, "benchmark": {"bipocPercent": 130.4}, "region": "R"},
    "reviews": {"c1": {"summary": "s", "suggestions": "g", "categories": {"7.1": {"notes": "n", "ratings": {"r1": "na", "r2": "inclusive"}, "checklist": {"e1": "yes", "e2": "skip"}}, "7.2": {"notes": ""}, "9.9": {"notes": "unknown"}}}, "c2": {"categories": {}}},
    "edits": {"c1": {"edits": {"s::b::0::old": {"kind": "replace", "replacement": "new", "category": "7.6"}, "s::b::1::a::b": {"kind": "keep", "context": "then"}, "s::b::2::c": {"kind": "keep"}, "s::image::0::a.jpg": IMAGE, "bad key": {"kind": "replace", "replacement": "x"}}}},
    "assets": {"c1": [ASSET, ASSET | {"name": "b.jpg"}]},
}
JUNK = [None, 7, -2.5, True, "", "junk", "na", [], ["x"], {}, {"kind": "replace"}]


def spoilt(rng):
    """The document with some of its parts, at any depth, replaced or taken away."""
    doc = copy.deepcopy(DOCUMENT)
    for _ in range(rng.randrange(4)):
        at = doc
        while True:
            keys = list(at) if isinstance(at, dict) else list(range(len(at)))
            k = rng.choice(keys)
            if isinstance(at[k], (dict, list)) and at[k] and rng.random() < 0.8:
                at = at[k]
                continue
            if rng.random() < 0.3:
                del at[k]
            else:
                at[k] = copy.deepcopy(rng.choice(JUNK))
            break
        if not doc:
            break
    return doc


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def record(v):
    return v if isinstance(v, dict) else {}


def plain(i, doc):
    out = {k: [] for k in ("header", "reviews", "notes", "ratings", "answers", "edits", "assets")}
    if not isinstance(doc, dict) or not number(doc.get("version")) or doc["version"] != 1:
        return out
    text = lambda v: v if isinstance(v, str) else None
    h = record(doc.get("header"))
    a, b = record(h.get("assessor")), record(h.get("benchmark")).get("bipocPercent")
    out["header"].append((i, *[text(a.get(n)) or "" for n in ("name", "title", "college")], float(min(100, max(0, math.floor(b + 0.5)))) if number(b) else None, text(h.get("region"))))
    for chapter, r in record(doc.get("reviews")).items():
        if not isinstance(r, dict):
            continue
        out["reviews"].append((i, chapter, text(r.get("summary")) or "", text(r.get("suggestions")) or ""))
        for category, c in record(r.get("categories")).items():
            if category not in CATEGORIES or not isinstance(c, dict):
                continue
            out["notes"].append((i, chapter, category, text(c.get("notes")) or ""))
            out["ratings"] += [(i, chapter, category, k, v) for k, v in record(c.get("ratings")).items() if isinstance(v, str) and v in decks.STORED_RATINGS]
            out["answers"] += [(i, chapter, category, k, v) for k, v in record(c.get("checklist")).items() if isinstance(v, str) and v in decks.STORED_ANSWERS]
    for chapter, held in record(doc.get("assets")).items():
        for x in held if isinstance(held, list) else []:
            names = [record(x).get(n) for n in (*decks._ASSET, "bytes")]
            try:
                if all(isinstance(n, str) for n in names):
                    out["assets"].append((i, chapter, *names[:-1], bytearray(base64.b64decode(names[-1], validate=True))))
            except ValueError:
                pass
    named = {(x[1], x[7]) for x in out["assets"]}
    for chapter, e in record(doc.get("edits")).items():
        for key, d in record(record(e).get("edits")).items():
            if key.count("::") < 3 or not isinstance(d, dict):
                continue
            category = d.get("category") if isinstance(d.get("category"), str) and d.get("category") in CATEGORIES else None
            if d.get("kind") == "replace" and isinstance(d.get("replacement"), str):
                out["edits"].append((i, chapter, key, "replace", d["replacement"], None, category, *[None] * 12))
            elif d.get("kind") == "keep" and ("context" not in d or isinstance(d["context"], str)):
                out["edits"].append((i, chapter, key, "keep", None, d.get("context"), category, *[None] * 12))
            elif d.get("kind") == "image":
                p, t = record(d.get("placement")), record(d.get("attribution"))
                strings = [p.get("elementId"), d.get("assetName"), d.get("alt"), d.get("caption"), t.get("text"), t.get("sourcePageUrl"), t.get("licenseName"), *([t["licenseUrl"]] if "licenseUrl" in t else [])]
                if p.get("kind") in ("replace", "insert-after") and all(isinstance(s, str) for s in strings) and number(d.get("width")) and number(d.get("height")) and isinstance(t.get("shareAlike"), bool) and (chapter, d["assetName"]) in named:
                    out["edits"].append((i, chapter, key, "image", None, None, None, p["kind"], *strings[:4], float(d["width"]), float(d["height"]), *strings[4:7], t.get("licenseUrl"), t["shareAlike"]))
    return out


def test_restore(spark):
    rng = random.Random(11)
    docs = [DOCUMENT, *[spoilt(rng) for _ in range(400)], DOCUMENT | {"version": 2}, DOCUMENT | {"version": "1"}, [], 5]
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9000, "{not json"), (9001, ""), (9002, None)]
    got = decks.restore_documents(spark.createDataFrame(texts, "id int, json string"), "json", CATEGORIES)
    expected = {k: [] for k in ("header", "reviews", "notes", "ratings", "answers", "edits", "assets")}
    for i, doc in enumerate(docs):
        for k, rows in plain(i, doc).items():
            expected[k] += rows
    for k, rows in expected.items():
        found = sorted((tuple(r) for r in getattr(got, k).collect()), key=str)
        if k == "edits":
            found = [(*r[:7], r[7], r[8], r[9], r[10], r[11], *r[12:]) for r in found]
        assert found == sorted(rows, key=str), k
        assert len(rows) > 100
    assert {r[3] for r in expected["edits"]} == {"replace", "keep", "image"}

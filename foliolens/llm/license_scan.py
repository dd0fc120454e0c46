"""Licence scan by a positional index of rare licence words.

Templates are licence notices with key phrases that must stand in full. One pass over the corpus counts in how
many texts each template word occurs (a table as large as the templates' vocabulary). The index holds, for every
key-phrase word, the templates and the places where it stands there. A text is scanned so: its licence words
that are the rarest key-phrase word of some template name the candidates; the postings of each candidate's
RAREST key-phrase words are intersected by relative position, which leaves the places where the template may
begin; there the key phrases are verified, then all words are compared with the template. A place where a
template stands holds all its key-phrase words at their places, so no step loses one. Fixed base phrases always
give their label.

Rows: a null text counts as empty (no words, no labels, score 0). Texts are scanned one by one, so
repeated rows, null keys and further columns need no rule; ties between words of equal frequency go by
the word and don't change what is found. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import texts_of

#: The share of a template's words that must match at their places.
LEAST_MATCH = 0.8

# Phrases and the labels they give wherever they stand.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Licence notices in folded words, with key phrases; the sentences are those that the licences ask for or begin with.
GNU_HEADER = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("unless required by applicable law or agreed to in writing",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("may be used to endorse or promote products derived from this software",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("and or distribute this software for any purpose with or without fee",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone to use this software for any purpose",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("terms of the mozilla public license",)),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license", "2 0")),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
)
#: GNU licences by label: program word, family, version of the header, versions told in a sentence.
GNU = (("gpl-2", "program", "general", "2"), ("gpl-3", "program", "general", "3"), ("lgpl", "library", "lesser general", "2 1"), ("lgpl", "program", "lesser general", "3"), ("agpl-3", "program", "affero general", "3"))
#: Creative Commons terms by label: abbreviation, name.
CREATIVE_COMMONS = (
    ("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution sharealike"), ("cc-by-nc", "by nc", "attribution noncommercial"), ("cc-by-nd", "by nd", "attribution noderivatives"),
    ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"), ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"),
)
#: Identifiers that follow "SPDX-License-Identifier:", by label.
SPDX = {
    "mit": "MIT", "apache-2": "Apache-2.0", "bsd": "BSD-2-Clause BSD-3-Clause", "isc": "ISC", "zlib": "Zlib", "boost": "BSL-1.0", "mpl-2": "MPL-2.0", "epl-2": "EPL-2.0", "unlicense": "Unlicense", "cc0": "CC0-1.0",
    "gpl-2": "GPL-2.0", "gpl-3": "GPL-3.0", "lgpl": "LGPL-2.1 LGPL-3.0", "agpl-3": "AGPL-3.0", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nd": "CC-BY-ND-4.0",
    "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0",
}
#: Licences by name: label, names, and versions that must follow (none: the name alone). A name stands word for word.
NAMES = (
    ("mit", ("mit license", "mit licence", "expat license"), ()), ("isc", ("isc license",), ()), ("zlib", ("zlib license",), ()), ("unlicense", ("the unlicense",), ()), ("boost", ("boost software license",), ("1 0",)),
    ("bsd", ("bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "2 clause bsd", "3 clause bsd", "4 clause bsd", "simplified bsd license", "new bsd license", "modified bsd license"), ()),
    ("apache-2", ("apache license", "apache software license", "apache"), ("2 0",)), ("apache-2", ("you may not use this file except in compliance with the license",), ()),
    ("mpl-2", ("mozilla public license", "mpl"), ("2 0",)), ("epl-2", ("eclipse public license", "epl"), ("2 0",)), ("odbl", ("open database license", "odbl v1 0", "odbl 1 0"), ()), ("ofl", ("sil open font license", "ofl 1 1"), ()),
    ("eupl", ("european union public license", "european union public licence"), ()), ("artistic", ("artistic license",), ()), ("gfdl", ("gnu free documentation license", "gnu fdl"), ()),
    ("gpl-2", ("gnu general public license", "gnu gpl", "gpl"), ("2", "2 0")), ("gpl-3", ("gnu general public license", "gnu gpl", "gpl"), ("3", "3 0")), ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl-3", ("gnu affero general public license", "gnu agpl", "agpl"), ("3", "3 0")),
)
#: Versions of the Creative Commons, and how the parts of their names are spelt besides.
CC_VERSIONS, CC_SPELT = ("1 0", "2 0", "2 5", "3 0", "4 0"), (("sharealike", "share alike"), ("noncommercial", "non commercial"), ("noderivatives", "no derivatives"), ("noderivatives", "noderivs"))
#: Key-phrase words of a template whose postings are intersected.
RAREST = 3

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


_SPDX = (b"spdx", b"license", b"identifier")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, int], ...]  # places of the key phrases
    needed: frozenset[bytes]


def _made(label: str, text: str, phrases: tuple[str, ...]) -> Template:
    words = tuple(text.encode().split())
    places = []
    for phrase in phrases:
        part = tuple(phrase.encode().split())
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        places.append((at, at + len(part)))
    return Template(label, words, tuple(places), frozenset(w for a, b in places for w in words[a:b]))


def templates() -> list[Template]:
    """The notices as given, and those of the GNU, Creative Commons and SPDX families, made by rule."""
    made = [_made(*notice) for notice in NOTICES]
    for label, program, family, version in GNU:
        name, told = f"gnu {family} public license", f"version {version}"
        made.append(_made(label, GNU_HEADER.format(program, family, version), (name, told)))
        made.append(_made(label, f"licensed under the {name} {told}", (f"{name} {told}",)))
        made.append(_made(label, f"licensed under the {name} v {version}", (f"{name} v {version}",)))
    for label, short, name in CREATIVE_COMMONS:
        made.append(_made(label, f"cc {short} 4 0", (f"cc {short} 4",)))
        made.append(_made(label, f"cc {short} 3 0", (f"cc {short} 3",)))
        made.append(_made(label, f"licensed under a creative commons {name} 4 0 international license", (f"creative commons {name} 4 0",)))
        made.append(_made(label, f"licensed under a creative commons {name} 3 0 unported license", (f"creative commons {name} 3 0",)))
        made.append(_made(label, f"licensed under the creative commons {name} license", (f"creative commons {name} license",)))
    for label, names, versions in NAMES:
        for name in names:
            forms = [name] if not versions else [f"{name} {told}{v}" for v in versions for told in ("version ", "v ", "v", "")] + [f"version {v} of the {name}" for v in versions]
            if name in ("gpl", "lgpl", "agpl", "mpl", "epl"):
                forms += [f"{name}v{v}" for v in versions]
            made += [_made(label, form, (form,)) for form in dict.fromkeys(forms)]
    for label, short, name in CREATIVE_COMMONS:
        spelt = {name}
        for plain, other in CC_SPELT:
            spelt |= {n.replace(plain, other) for n in spelt}
        forms = [f"cc {short} {v}" for v in CC_VERSIONS] + [f"creative commons {n} {v}" for n in sorted(spelt) for v in CC_VERSIONS] + [f"creative commons {n} license" for n in sorted(spelt)]
        made += [_made(label, form, (form,)) for form in forms]
    for label, names in SPDX.items():
        for name in names.split():
            text = "spdx license identifier " + " ".join(x.decode() for x in words_of(name))
            made.append(_made(label, text, (text,)))
    return made


class Scanner:
    """The positional index of the templates, with the key-phrase words of each from the rarest in the corpus to the commonest."""

    def __init__(self, frequency: dict[bytes, int]):
        self.templates = templates()
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # word: template and place of the key-phrase words that are intersected
        self.rarest: dict[bytes, list[int]] = defaultdict(list)  # word: templates whose rarest key-phrase word it is
        for number, template in enumerate(self.templates):
            inside = {template.words[i]: i for a, b in template.phrases for i in range(a, b)}
            chosen = sorted(inside, key=lambda w: (frequency.get(w, 0), w))[:RAREST]
            self.rarest[chosen[0]].append(number)
            for word in chosen:
                self.postings[word].append((number, inside[word]))
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE_PHRASES]
        self.identifiers = sorted(((tuple(words_of(n)), label) for label, names in SPDX.items() for n in names.split()), key=lambda x: (-len(x[0]), x[0]))

    def begins(self, words: list[bytes], have: set[bytes]) -> dict[int, set[int]]:
        """By candidate template, the places where it may begin: all its rarest key-phrase words stand at their places from there."""
        candidates = {n for word in have & self.rarest.keys() for n in self.rarest[word] if self.templates[n].needed <= have}
        if not candidates:
            return {}
        asked = {word: [(n, at) for n, at in held if n in candidates] for word, held in self.postings.items() if word in have}
        asked = {word: held for word, held in asked.items() if held}
        places: dict[bytes, list[int]] = defaultdict(list)
        for place, word in enumerate(words):
            if word in asked:
                places[word].append(place)
        out: dict[int, set[int]] = {}
        for word in sorted(asked, key=lambda w: len(places[w])):
            for n, at in asked[word]:
                found = {p - at for p in places[word]}
                out[n] = out[n] & found if n in out else found
        return out

    def expression(self, words: list[bytes], at: int) -> set[str]:
        """Labels of the identifiers that an SPDX expression joins to its first one, of which `at` is the place."""
        found: set[str] = set()
        while True:
            known = next(((name, label) for name, label in self.identifiers if tuple(words[at : at + len(name)]) == name), None)
            if not known:
                return found
            found.add(known[1])
            at += len(known[0])
            while words[at : at + 1] in ([b"only"], [b"later"]) or words[at : at + 2] == [b"or", b"later"]:
                at += 1 + (words[at] == b"or")
            if words[at : at + 1] == [b"with"]:  # an exception to the licence, up to the next joining word
                at = next((i for i in range(at, min(at + 8, len(words))) if words[i] in (b"and", b"or")), len(words))
            if words[at : at + 1] not in ([b"and"], [b"or"]):
                return found
            at += 1

    def labels(self, words: list[bytes]) -> dict[str, float]:
        """Labels of verified templates with the best share of words that match."""
        found: dict[str, float] = {}
        for number, begins in self.begins(words, set(words)).items():
            template = self.templates[number]
            for begin in begins:
                if any(begin + a < 0 or tuple(words[begin + a : begin + b]) != template.words[a:b] for a, b in template.phrases):
                    continue
                share = sum(0 <= begin + i < len(words) and words[begin + i] == w for i, w in enumerate(template.words)) / len(template.words)
                if share >= LEAST_MATCH:
                    found[template.label] = max(share, found.get(template.label, 0))
                    if template.words[:3] == _SPDX:
                        found |= dict.fromkeys(self.expression(words, begin + 3), 1.0)
        return found

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.base:
            at, seen, number = line.find(phrase), 0, 0
            while at >= 0:
                number += line.count(b" ", seen, at)
                seen = at
                places.append(number)
                base.add(label)
                at = line.find(phrase, at + 1)
        found = self.labels(words)
        score = max([1.0] * bool(base) + [0.0, *found.values()])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score


def frequencies(df: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many texts each template word occurs."""
    vocabulary = frozenset(w for t in templates() for w in t.words)

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for value in texts_of(batch.column(0)):
                seen.update(vocabulary.intersection(words_of(value)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = df.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the key, word and base counts and places, labels and the score of the best match."""
    frequency = frequencies(df, text)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        scanner = Scanner(frequency)
        for batch in batches:
            found = [scanner.scan(t) for t in texts_of(batch.column(1))]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], [key, *names])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

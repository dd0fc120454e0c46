import random
import re
import time

from foliolens.llm import license_scan

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SCHEMA = "doc_id long, text string, labels string"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "", None, "Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nx", "under the mit license under the MIT-license CC/BY/NC",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0. é ", "ÉCOLE cc by ncx", "the mit press",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gnu general public version 3 license", "public license general " * 3000,
]


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["under", "the", "mit", "license", "apache", "Version", "2", "CC", "by", "nc", "x-y", "é", "\n"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(100)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_templates(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (5, TEXTS[5], "x")], SCHEMA)
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert rows[5]["labels"] == "gpl-3" and rows[5]["score"] == 1 and rows[5]["n_base"] == 0
    assert rows[9]["labels"] == "mit" and rows[9]["base_labels"] == ""
    assert rows[10]["labels"] == "" and rows[8]["labels"] == ""
    assert license_scan.scan(df.limit(0)).collect() == []


GPL = "This work is licensed under the GNU General Public License, version 3."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"


def test_every_notice_of_a_text_counts(spark):
    """A notice of rare words does not crowd out one of common words, and the order of notices is of no matter."""
    everything = " ".join(" ".join(w.decode() for w in t.words) for t in license_scan.templates())
    texts = [f"{BSD}. {GPL}", f"{GPL} {BSD}", everything, f"{BSD} licensed under the GNU General Public License, version 3"] + [GPL] * 40
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert rows[0] == rows[1] == rows[3] == "bsd,gpl-3"
    assert set(rows[2].split(",")) == {t.label for t in license_scan.templates()}


def test_equals_every_place():
    """Labels and shares are those of comparing every template at every place."""
    rng = random.Random(3)
    vocabulary = sorted({w for t in license_scan.templates() for w in t.words})
    scanner = license_scan.Scanner({w: rng.randrange(50) for w in vocabulary})
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            part = list(rng.choice(scanner.templates).words)
            words += [rng.choice(vocabulary) if rng.random() < 0.05 else w for w in part] + [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
        expected = {}
        for t in scanner.templates:
            for begin in range(-len(t.words), len(words)):
                fits = [0 <= begin + i < len(words) and words[begin + i] == w for i, w in enumerate(t.words)]
                share = sum(fits) / len(fits)
                if share >= license_scan.LEAST_MATCH and all(all(fits[a:b]) for a, b in t.phrases):
                    expected[t.label] = max(share, expected.get(t.label, 0))
        assert scanner.labels(words) == expected


def test_gnu_headers(spark):
    head = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = [head.format("program", "General", "3"), head.format("program", "General", "2"), head.format("library", "Lesser General", "2.1"), head.format("program", "Affero General", "3")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    assert [r["labels"] for r in license_scan.scan(df).orderBy("doc_id").collect()] == ["gpl-3", "gpl-2", "lgpl", "agpl-3"]


def test_notices_and_identifiers(spark):
    wanted = {
        "SPDX-License-Identifier: GPL-3.0-only": "gpl-3", "# SPDX-License-Identifier: Apache-2.0": "apache-2", "Text: CC BY-SA 4.0.": "cc-by-sa", "licensed under CC BY 4.0": "cc-by", "CC BY-NC-ND 4.0": "cc-by-nc,cc-by-nc-nd",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa", "licensed under the GNU GPL": "", "by the way, see section 4.0": "",
        "This is free and unencumbered software released into the public domain.": "unlicense", "CC by the river": "",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(wanted)], SCHEMA)
    assert [r["labels"] for r in license_scan.scan(df).orderBy("doc_id").collect()] == list(wanted.values())


def test_many_places_take_linear_time():
    began = time.process_time()
    found = license_scan.Scanner({}).scan("under the mit license " * 40_000)
    assert found[1:4] == (40_000, 0, 159_996) and time.process_time() - began < 3


NAMED = {
    "Licensed under the BSD 3-Clause License": "bsd", "The MIT License (MIT)": "mit", "MIT License": "mit", "licensed under GPLv3": "gpl-3", "GNU GPL version 2 or later": "gpl-2", "GNU General Public License v3.0": "gpl-3",
    "GNU Lesser General Public License version 2.1": "lgpl", "Licensed under the Apache 2.0 License": "apache-2", "Apache-2.0": "apache-2", "CC BY-SA 2.0": "cc-by-sa", "Creative Commons Attribution 2.5": "cc-by", "Open Database License (ODbL)": "odbl",
    "you may not use this file except in compliance with the License.": "apache-2", "under the SIL Open Font License, Version 1.1": "ofl", "Licensed under the European Union Public Licence": "eupl", "the Artistic License 2.0": "artistic",
    "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation": "gpl-2", "Creative Commons Attribution-Non-Commercial-Share Alike 3.0": "cc-by-nc-sa", "GNU Affero General Public License v3": "agpl-3",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit", "SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause": "bsd,gpl-2", "SPDX-License-Identifier: GPL-2.0-or-later AND MIT": "gpl-2,mit", "version 3 of the GNU General Public License": "gpl-3",
}


def test_names_and_expressions(spark):
    rows = [(i, f"Some words before. {text}\nand after.") for i, text in enumerate(NAMED)]
    clean = ["He met with the MIT team about a driver's license.", "Apache helicopters, 2 of them", "a version 3 of the novel", "general public, license plates", "The BSD conference has 3 tracks", "mit dem Zug, MIT Press", "attribution 2 of 5"]
    rows += [(100 + i, text) for i, text in enumerate(clean)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {text: got[i] for i, text in enumerate(NAMED)} == NAMED
    assert [got[100 + i] for i in range(len(clean))] == [""] * len(clean)

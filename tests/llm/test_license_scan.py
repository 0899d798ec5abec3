import random
import re

import pytest

from terravane.llm import license_scan as L
from terravane.llm import license_texts
from terravane.llm.queries import op3_license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    each = (x.strip(L.PUNCT_CHARS) for x in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)))
    return [x for x in each if x]


def brute(text, templates=L.TEMPLATES):
    """Every template against every place of the text, without retrieval."""
    w, found = words(text), set()
    s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    for name, template, *must in templates:
        own = words(template)
        if must and must[0] and not any(" " + " ".join(words(m)) + " " in " " + " ".join(w) + " " for m in must[0]):
            continue
        if len(own) < 5:
            hit = any(w[k : k + len(own)] == own for k in range(len(w)))
        else:
            want = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            size = 2 * (len(want) + L.WINDOW)
            hit = any(100 * len(want & set(s[k : k + size])) >= 75 * len(want) for k in range(0, max(1, len(s)), max(1, len(want) // 4)))
        if hit:
            found.add(name)
    return sorted(found - {other for one, other in license_texts.HOLDS.items() if one in found})


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_query(spark, where, edge_dir):
    where = "/root/testdata/sf0.001" if where == "sf" else edge_dir
    known = [*L.TEMPLATES, *license_texts.templates()]
    docs = [(r.doc_id, brute(r.text, known)) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = [(r.doc_id, r.licenses) for r in op3_license_scan(spark, where).collect()]
    assert sorted(got, key=repr) == sorted(docs, key=repr)
    assert where != "/root/testdata/sf0.001" or sum(map(bool, dict(docs).values())) > 5


def test_recall_of_damaged_templates(spark):
    """Of templates with words changed that still hold 75 % of their shingles, in other text, nearly all are found."""
    rng = random.Random(5)
    known = [t for t in [*L.TEMPLATES, *license_texts.templates()] if not (len(t) > 2 and t[2])]
    texts = []
    for _ in range(40):
        for name, text, *_ in known:
            w = words(text)
            if len(w) > 400:
                continue
            own = list(w)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(1000)}"
            pad = lambda: [f"other{rng.randrange(500)}" for _ in range(rng.randint(0, 60))]
            texts.append(" ".join([*pad(), *own, *pad()]))
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), known).orderBy("i").collect()
    due = [(r.i, n) for r in got for n in brute(r.text, known)]
    found = {(r.i, n) for r in got for n in r.licenses}
    assert len(due) > 200 and len([d for d in due if d in found]) >= 0.99 * len(due)
    short = {n for n, t in L.TEMPLATES}
    assert all(d in found for d in due if d[1] in short)


def test_bands_meet_as_often_as_stated(spark):
    """Windows that share four of nine shingles with a template's meet in some band 99 times of 100."""
    pairs = []
    rng = random.Random(2)
    for _ in range(3000):
        both = [rng.getrandbits(62) for _ in range(4)]
        pairs.append((both + [rng.getrandbits(62)], both + [rng.getrandbits(62) for _ in range(4)]))
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    values = L._band_values("0")
    met = df.selectExpr("arrays_overlap({}, {}) AS met".format(values.replace("slice(s,", "slice(a,"), values.replace("slice(s,", "slice(b,"))).where("met").count()
    assert 0.98 < met / 3000 < 0.998


def test_only_retrieved_templates_are_verified(spark):
    docs = spark.createDataFrame([("nothing of a licence in these many words that go on and on",), ("Released under the MIT License.",)], "text string")
    known = L.template_table(spark, L.TEMPLATES)
    texts = docs.selectExpr("xxhash64(text) AS k1", "xxhash64(1, text) AS k2", "text")
    assert {r.t for r in L._candidates(texts, known).collect()} == {1}


def test_hundreds_of_templates(spark):
    rng = random.Random(9)
    many = [(f"own-{k}", " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(1, 300)))) for k in range(400)]
    docs = spark.createDataFrame([(k, f"before it\n{t}\nafter it") for k, (_, t) in enumerate(many)], "i int, text string")
    got = L.scan(docs, many).collect()
    assert all(f"own-{r.i}" in r.licenses for r in got)


def test_no_callers_column_is_lost(spark):
    docs = spark.createDataFrame([("MIT words only", 1, 2, 3, 4)], "text string, _k1 int, _names int, w int, s int")
    got = L.scan(docs)
    assert got.columns == [*docs.columns, "licenses"] and tuple(got.first()) == ("MIT words only", 1, 2, 3, 4, [])


def test_altered_and_embedded(spark):
    texts = ["x y z " * 20 + "this work is  LICENSED under the GNU general public license, version 3. and more words here", "This work is licensed under the GNU General Public License, edition 3.", "This work was licensed by nobody under the GNU General Public Licence", "all rights reserved.\nnext"]
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [r.licenses for r in got] == [["gpl-3.0"], ["gpl-3.0"], [], ["all-rights-reserved"]]


def test_wrapped_and_inside_lines(spark):
    texts = [
        "Released under\n  the MIT License.", "Licensed under the Apache\r\nLicense, Version 2.0.", "Licensed under CC\nBY-NC 4.0.",
        "This work is licensed under the\nGNU General Public License,\nversion 3.", "Copyright 2024 Foo Inc. All rights reserved. More follows here.", "All rights\nreserved.", "overall rights reserved.",
    ]
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [r.licenses for r in got] == [["mit"], ["apache-2.0"], ["cc-by-nc-4.0"], ["gpl-3.0"], ["all-rights-reserved"], ["all-rights-reserved"], []]
    words = [f"word{k}" for k in range(300)]
    lines = "\n".join(" ".join(words[k : k + 11]) for k in range(0, 300, 11))
    assert L.scan(spark.createDataFrame([("before\n" + lines,)], "text string"), [("own", " ".join(words))]).first().licenses == ["own"]


def test_full_texts_headers_and_tags(spark):
    given = [(n, "Some words before it.\n" + "\n".join(" * " + line for line in t.split("\n")) + "\nand some after it.") for n, t, _ in license_texts.templates()]
    given += [
        ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("mit", "// SPDX-License-Identifier: MIT"), ("mit-0", "# SPDX-License-Identifier: MIT-0"),
        ("apache-2.0 gpl-2.0", "/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0) */"), ("", "He permitted redistribution, with or without conditions."),
    ]
    rows = L.scan(spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(given)], "i int, name string, text string")).collect()
    assert [(r.i, r.name, r.licenses) for r in rows if " ".join(r.licenses) != r.name] == []

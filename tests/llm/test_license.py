"""Licence scan: notices in running text, look-alikes, held-out variants, odd inputs."""

import re

import pytest
from pyspark.sql import functions as F

from rareclass.llm.license import ANCHORS, grams_of, scan, scan_corpus, train, words_of

NOTICES = {
    "Licensed under the Apache License, Version 2.0.": ["apache"], "Released under the MIT License.": ["mit"],
    "This work is licensed under the GNU General Public License, version 2.": ["gpl"], "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
    "All rights reserved.": ["proprietary"], "(c) 2021 us. ALL RIGHTS RESERVED": ["proprietary"],
    "Note: this work is licensed under the GNU General Public License version 3 or later.": ["gpl"],
    "Licensed under the Apache License, v2.0": ["apache"],
    "Licensed under the Mozilla Public License, Version 1.1.": ["mpl"], "Licensed under CC BY-SA 3.0.": ["cc-by-sa"],
}
OTHERS = ["my license plate is gone", "rights of way and permission slips", "der weg mit dem rad", "the copyright of songs", "apache tribes lived here", ""]


@pytest.fixture(scope="module")
def known(spark):
    return train(spark)


def test_notices_and_look_alikes(spark, known):
    lines = [*NOTICES, *OTHERS]
    rows = [(i, f"thand er ing the ont.\n\n{t}\nEred of thing.", "x") for i, t in enumerate(lines)]
    _, found = scan(spark.createDataFrame(rows, "doc_id long, text string, family string"), known)
    got = {}
    for r in found.filter("confirmed").collect():
        got.setdefault(lines[r["doc_id"]], []).append(r["family"])
        assert r["paragraph"] == 1 and 0.5 <= r["probability"] <= 1
    assert got == NOTICES


def test_every_planted_notice_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["families"] for r in scan_corpus(docs).collect()}
    names = {"Apache License": "apache", "the MIT License": "mit", "GNU General": "gpl", "CC BY-NC": "cc-by-nc", "All rights reserved": "proprietary"}
    for r in docs.select("doc_id", "text").collect():
        assert got[r["doc_id"]] == sorted({f for n, f in names.items() if n in r["text"]}), r["doc_id"]


def test_odd_tables(spark):
    schema = "doc_id long, text string, n_licences string"
    assert scan_corpus(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\n", "c"), (4, "All rights reserved.", None), (4, "All rights reserved.", None), (None, "word " * 50_000, None)]
    got = scan_corpus(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_paragraphs"], r["n_licences"], r["families"]) for r in got) == [
        (0, 1, 0, []), (1, 0, 0, []), (2, 0, 0, []), (3, 0, 0, []), (4, 1, 1, ["proprietary"]), (4, 1, 1, ["proprietary"])]


def test_words_and_grams(spark):
    df = spark.createDataFrame([("CC BY-NC 4.0.",)], "t string").select(words_of(F.col("t")).alias("w"))
    row = df.select("w", grams_of(F.col("w")).alias("g")).first()
    assert row["w"] == ["cc", "by", "nc", "#"]
    assert set(row["g"]) == {"^ cc", "cc by", "by nc", "nc #", "# $", "^ cc by", "cc by nc", "by nc #", "nc # $"}
    assert not any(re.search(a, "thing") for a in ANCHORS)


WRAPPED = {
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": ["gpl"],
    "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n"
    "# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.": ["lgpl"],
    "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as published\n"
    "// by the Free Software Foundation, either version 3 of the License, or": ["agpl"],
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n"
    " * are met:": ["bsd"],
    "To the extent possible under law, Jane Doe has waived\nall copyright and related or neighboring rights\nto this work.": ["cc0"],
    "This is free and unencumbered software released into the public\ndomain.": ["public-domain"],
    "Licensed under the Apache License, Version 2.0. Released under the MIT License.": ["apache", "mit"],
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["apache", "mit"],
}


def test_wrapped_notices_and_two_in_a_line(spark, known):
    texts = list(WRAPPED)
    rows = [(i, f"thand er ing the ont.\n\n{t}\n\nEred of thing.") for i, t in enumerate(texts)]
    # the same in the middle of a long paragraph, at places that fall differently on its pieces
    rows += [(len(texts) * k + i, "ered of thing " * (13 * k) + "\n" + t + "\n" + "thand er ing " * 40) for k in (1, 2, 3) for i, t in enumerate(texts)]
    got = {}
    _, found = scan(spark.createDataFrame(rows, "doc_id long, text string"), known)
    for r in found.filter("confirmed").collect():
        got.setdefault(r["doc_id"], []).append(r["family"])
    assert {i: sorted(f) for i, f in got.items()} == {i: WRAPPED[texts[i % len(texts)]] for i, _ in rows}


def test_repeated_notices_are_counted_once_each(spark, known):
    text = "\n".join(["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License."] * 3)
    rows, found = scan(spark.createDataFrame([(1, text), (2, "my license plate is gone")], "doc_id long, text string"), known)
    assert sorted((r["doc_id"], r["family"]) for r in found.collect()) == [(1, "apache")] * 3 + [(2, "unknown")]
    assert {r["n_paragraphs"] for r in rows.collect()} == {1}

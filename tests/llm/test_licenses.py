import os

import pytest
from pyspark.sql import functions as F

from pagelift.llm import licenses

from .helpers import docs, empty, odd

TEXT = dict(reversed(licenses.KNOWN))


def scanned(spark, texts):
    return [(r["license_id"], r["notice_ids"]) for r in licenses.scan_known(docs(spark, texts)).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "change",
    [str.upper, lambda t: "Copyright (c) 2020 Ann\n" + t, lambda t: "Copyright 2020 A.\n© B\n(c) 2021 C\nAll rights reserved.\n\n" + t, lambda t: t.replace(" ", "  \n"), lambda t: t.replace(",", ";").replace('"', "''")],
)
def test_whole_texts(spark, change):
    ids = [i for i, t in licenses.KNOWN if len(t) > 300]
    texts = [change(t) for _, t in licenses.KNOWN if len(t) > 300]
    assert [i for i, _ in scanned(spark, texts)] == ids


def test_spellings(spark):
    text = TEXT["Zlib"].replace("acknowledgment", "acknowledgement")
    assert scanned(spark, [text, text + " more", ""])[:2] == [("Zlib", ""), (None, "")]


def test_notices_in_texts(spark):
    got = scanned(spark, ["Words.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT Licence.\nlicensed UNDER cc by nc 4 0", "licenses of all kinds", None])
    assert got == [(None, "CC-BY-NC-4.0,MIT"), (None, ""), (None, "")]


def test_the_notice_alone_is_a_text(spark):
    assert scanned(spark, ["Released under the MIT License."]) == [("MIT", "MIT")]


def test_odd_rows(spark):
    got = licenses.scan_known(odd(spark))
    assert got.count() == odd(spark).count() and got.filter("license_id is not null").count() == 0
    assert licenses.scan_known(empty(spark)).count() == 0


def test_a_large_registry_is_joined(spark):
    known = [(f"L{i}", f"license text number {i}") for i in range(1200)]
    rows = docs(spark, ["License text, number 7!", "x\nlicense text number 9\nlicense text number 8", "none"])
    got = licenses.scan_known(rows, known).orderBy("doc_id").collect()
    assert [(r["license_id"], r["notice_ids"]) for r in got] == [("L7", "L7"), (None, "L8,L9"), (None, "")]


def test_no_python(spark):
    plan = licenses.scan_known(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan
    assert docs(spark, ["a"]).select(licenses.canonical(F.lit("A,  b-C"))).first()[0] == "a b c"


def test_files_as_they_are_shipped(spark):
    mit, bsd = TEXT["MIT"], TEXT["BSD-3-Clause"]
    with open(os.path.join(os.path.dirname(licenses.__file__), "license_texts", "Apache-2.0.txt")) as f:
        apache = f.read()
    bullets = bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    gpl = next(t for i, t in licenses.KNOWN if i == "GPL-3.0" and t.startswith("GNU"))
    texts = ["MIT License\n\nCopyright (c) 2020 Ann\n\n" + mit, "BSD 3-Clause License\n\nCopyright (c) 2020, Ann\nAll rights reserved.\n\n" + bsd, "Copyright (c) 2020, Ann\n\n" + bullets,
             apache, apache.replace("[yyyy] [name of copyright owner]", "2020 Ann"), apache[: apache.index("   APPENDIX")],
             gpl.replace("Everyone is", " Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is", 1)]
    assert [i for i, _ in scanned(spark, texts)] == ["MIT", "BSD-3-Clause", "BSD-3-Clause", *["Apache-2.0"] * 3, "GPL-3.0"]


def test_sql_gives_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    from pagelift.llm import queries

    texts = [t for _, t in licenses.KNOWN][::7] + ["Copyright 2020 Ann. Some words.\nCopyright law changed in 1998, and many long stories follow here.", "a © b", "(c) 2020 x", "", "Copyright (c) 2020 J. Smith. © Bob. Copyright 2019 Ann Co. Ltd. Words of more than that.\r\n/* Copyright by Ann Lee 2020. */\nCopyright law changed in 1998."]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts, 1)))
        want = c.execute(queries.ORACLE_SQL["op7_licenses"] + " ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in licenses.scan_known(docs(spark, texts)).orderBy("doc_id").collect()] == want


def test_only_the_notice_is_removed(spark):
    """A notice is taken out of its line, and prose that begins with the word stays."""
    flat = TEXT["MIT"].replace("\n", " ")
    heads = ["Copyright (c) 2020 Ann. ", "Copyright 2020 J. Smith. All rights reserved. ", "(c) 2019-2021 Ann, Bob and Co. Ltd. ", "© Ann. Copyright (c) 2021 Bob. ", "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "]
    assert [i for i, _ in scanned(spark, [h + flat for h in heads])] == ["MIT"] * len(heads)
    lines = ["Copyright Ann Lee, 2020", "Copyright (c) Ann", "# Copyright (c) 2014, 2016-2020 Ann Lee, Bob Ray, Google Inc. and all of the others who took part. All rights reserved.", "Copyright by Ann 2020. All rights reserved.", "/* Copyright 2020, The Authors */"]
    assert [i for i, _ in scanned(spark, [x + "\n" + TEXT["MIT"] for x in lines])] == ["MIT"] * len(lines)
    prose = ["Copyright law changed in 1998, and many long stories follow here.", "Copyright law changed in 1998.", "(c) 2020 was a mark on the wall " + "of the old house by the sea " * 5, "© 2020 Ann. This is what the page says.", "Copyright (c) 2020 Ann " + flat]
    kept = [r[0] for r in docs(spark, prose).orderBy("doc_id").select(licenses.canonical(F.col("text"))).collect()]
    assert kept[0] == "copyright law changed in 1998 and many long stories follow here" and kept[1] == "copyright law changed in 1998"
    assert kept[2].startswith("c 2020 was a mark") and kept[3] == "this is what the page says" and "permission is hereby granted" in kept[4]


def test_neighbours_in_spelling(spark):
    rows = spark.createDataFrame([("organisation, organisation Organisation",), ("per cent per cent",), ("sub-licence",), ("Whilst",)], "t string")
    got = [r[0] for r in rows.select(licenses.canonical(rows.t)).collect()]
    assert got == ["organization organization organization", "percent percent", "sublicense", "while"]

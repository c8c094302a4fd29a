import os

import pytest

from sitegauge.llm import licences

SF = "/root/testdata/sf0.001"
#: The licence lines of the given documents, and their family.
LINES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
         "This work is licensed under the GNU General Public License, version 3.": "gpl",
         "Licensed under the Apache License, Version 2.0.": "apache-2.0"}


def test_edge_cases(docs_of):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, f"some text before\n{line}\nand some after", "en") for i, line in enumerate(LINES)]
    rows += [(10, None), (11, ""), (12, "My driving license expired.\nnothing here"), (13, "\n\n"),
             (14, f"{long} licensed under the apache license, version 2.0. {long}"), (15, "plain"), (15, "plain"),
             (None, "Released under the MIT license.\n\nLICENSED UNDER CC BY-NC 4.0"), (16, "license " * 20_000),
             (17, "Redistribution and use in source and binary forms, with modification, are permitted provided that")]
    docs = docs_of(*rows).withColumnRenamed("lang", "family").withColumnRenamed("source", "words")
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(docs.repartition(3)).collect()}
    for i, family in enumerate(LINES.values()):
        assert got[i] == (3, family, f"1:{family}")
    for i in (10, 11, 12, 13, 15, 16):
        assert got[i][1:] == ("", "")
    assert (got[10][0], got[12][0], got[13][0]) == (1, 2, 3)
    assert got[14] == (1, "apache-2.0", "0:apache-2.0") and got[17][1] == "bsd"
    assert got[None] == (3, "cc-by-nc,mit", "0:mit,2:cc-by-nc")
    assert licences.scan(docs.where("false")).collect() == []


def test_statements_without_licence_words(docs_of):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies")
    gpl = "This program is free software: you can redistribute it and/or modify"
    docs = docs_of((1, mit), (2, f"first line\n{gpl}\nit and more"), (3, "this is free of thought"), (4, f"_{gpl}_"))
    got = {r.doc_id: r.statements for r in licences.scan(docs).collect()}
    assert got == {1: "0:mit", 2: "1:gpl", 3: "", 4: "0:gpl"}


def test_filter_lets_every_template_triple_pass(spark):
    lines = [f"x {t.upper()}, y" for t in licences.TRIPLES] + [f"_{t}_" for t in licences.TRIPLES]
    texts = [x for texts in licences.TEMPLATES.values() for x in texts]
    rows = spark.createDataFrame([(x,) for x in lines + texts], "line string")
    assert rows.where(~licences._may_hold_statement(licences.F.col("line"))).collect() == []
    triples = rows.where(licences.F.col("line").isin(texts)).select(
        licences.F.explode(licences._ngrams(licences.words_of(licences.F.col("line")), 3)).alias("t")).distinct()
    assert {r.t for r in triples.collect()} == set(licences.TRIPLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for r in docs.collect():
        lines = r.text.split("\n")
        want = [f"{i}:{LINES[line]}" for i, line in enumerate(lines) if line in LINES]
        assert got[r.doc_id].n_paragraphs == len(lines)
        assert got[r.doc_id].statements == ",".join(want)


def test_plan_has_no_python(docs_of):
    plan = licences.scan(docs_of((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

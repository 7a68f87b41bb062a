import re

import duckdb
import pytest

from vigil.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    "Released under the MIT License.", "mit mit license mit-license MIT\nLICENSE", "Apache License, Version 2.0; MIT License", "limit license",
    "GNU General Public License v3, general public license", "GNU LESSER General Public License", "general public apache license",
    "licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Permission is hereby granted, free of charge", "of charge to any person obtaining a copy of this software", "Licensed under CC BY-NC 4.0.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mitélicense MİT License mitKlicense", "éé mit license", "mit license" * 3, "license mit",
    "use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return odd.union(spark.createDataFrame([(100 + i, t, None, None) for i, t in enumerate(TEXTS)], odd.schema))


def base_rows(docs):
    out = []
    for r in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = WORD.findall(text)
        hits = [(i, label) for label, phrase, _ in licenses.BASE for i in range(len(words))
                if words[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in hits]
        out.append((str(r.doc_id), len(words), len(hits), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for _, x in hits}))))
    return sorted(out, key=repr)


def test_base_equals_brute_force(docs):
    found = licenses.summary(licenses.scan(docs)).collect()
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr) == base_rows(docs.collect())
    for r in found:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_all_columns_equal_the_plain_search(docs):
    found = licenses.summary(licenses.scan(docs)).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    plain = con.execute(licenses.oracle_sql()).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert sorted(found.columns) == sorted(plain.columns)
    assert [x.replace(".0,", ",") for x in key(found)] == [x.replace(".0,", ",") for x in key(plain)]


def test_notices_need_their_key_words(docs):
    labels = {r.doc_id: r.labels for r in licenses.summary(licenses.scan(docs)).collect()}
    assert labels[108] == "mit" and labels[109] == "" and labels[107] == "apache" and labels[111] == "cc" and labels[112] == "bsd"
    assert labels[105] == "gpl,lgpl"


def whole(label):
    return next(t for t in licenses.TEXTS if t[0] == label)[1]


def test_whole_texts_are_found_with_words_put_in_and_left_out(spark):
    mit, zlib = whole("mit"), whole("zlib")
    texts = [
        "Copyright 2020 Some One\n" + mit.upper(), mit.replace("authors or copyright holders", "some one and another one of these persons"),
        mit.replace("hereby granted free of charge", "hereby granted"), "before it " + zlib + " " + zlib,
        " ".join(zlib.split()[25:]), mit.split("without limitation")[0], zlib.replace("like", "li\u212ae").replace("must not be misrepresented", "x"),
        "this product works like " * 20 + mit]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    number = {id(t): n for n, t in enumerate(licenses.TEMPLATES)}
    of = {t.label: number[id(t)] for t in licenses.TEMPLATES[-len(licenses.TEXTS):]}
    found = {r.doc_id: {(p.template, p.start): p.share for p in r.places} for r in licenses.scan(docs).collect()}
    assert found[0][of["mit"], 4] == 1 and 0.9 < found[1][of["mit"], 0] < 1
    assert not any(t == of["mit"] for t, _ in (*found[2], *found[5])) and found[6] == {}
    length = len(zlib.split())
    assert {k: v for k, v in found[3].items() if k[0] == of["zlib"]} == {(of["zlib"], 2): 1, (of["zlib"], 2 + length): 1}
    assert 0.6 < found[4][of["zlib"], -25] < 1  # its opening is cut off
    assert found[7][of["mit"], 80] == 1


def test_templates_of_any_letters(spark):
    template = licenses.Template.of("kept", "keep kindly this work like a key", ("keep kindly", "work like a key"))
    docs = spark.createDataFrame([(1, "so KEEP kindly this other work, like a key"), (2, "\u212aeep kindly this work like a key"), (3, "keep kindly")],
                                 "doc_id long, text string")
    found = {r.doc_id: r.places for r in licenses.scan(docs, templates=(template,)).collect()}
    assert [(p.label, p.start) for p in found[1]] == [("kept", 1)] and found[1][0].share >= 2 / 3
    assert found[2] == [] and found[3] == []
    with pytest.raises(ValueError):
        licenses.Template.of("x", "some words", ("other words",))


def test_texts_are_read_once(docs):
    found = licenses.summary(licenses.scan(docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_no_documents(none):
    assert licenses.summary(licenses.scan(none)).count() == 0

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vigil.llm import fim, queries
from tests.conftest import SF0001


def brute(doc_id, text, share=90, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    sha = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return doc_id, n, "plain", text, None, None
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return doc_id, n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


TEXTS = ["", None, "a", "abc", "ab cd  ef\n\ngh", "<P>", "x <S> y", "tail <M>", "<", "<P", "P>", "<S<S", ">S>M>", "a<", "<a>b<c>" * 9, "$1 \\2 $3 \\Q \\E {2}",
         "日本語 text 😀😀 é \x00 \r\n", "AbC1dEf", "K ſ İ é", " " * 50, "word " * 30_000, "x" * 200_000, "<>" * 40_000]


def test_texts_of_all_kinds_many_cuts(spark):
    rows = [(100 * i + j, t) for i, t in enumerate(TEXTS) for j in range(25 if t and len(t) < 1000 else 3)] + [(None, "no id at all"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("form", F.lit(2)).withColumn("a.b", F.lit(3))
    found = fim.transform(df)
    back = found.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    texts = {(i, t or "") for i, t in rows}
    assert {(r.doc_id, r.back) for r in back} == texts
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_all_transformed_and_other_sentinels(spark):
    f = fim.Fim("[pre]", "[suf]", "[mid]", transformed_percent=100, spm_percent=50)
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS if t)]
    found = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), fim=f)
    got = {r.doc_id: r for r in found.withColumn("back", fim.restore(F.col("output"), F.col("form"), f)).collect()}
    assert {i: r.back for i, r in got.items()} == dict(rows)
    assert {r.form for r in got.values()} == {"psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<SS>", "<M>"), ("<P>", "P<>", "<M>"), ("<P>", "<<>", "<M>"), ("$P>", "$S>", "$M>")):
        with pytest.raises(ValueError):
            fim.Fim(*bad)


def test_query_digests(spark):
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    want = []
    for d in docs:
        i, n, form, out, p, m = brute(d.doc_id, d.text)
        want.append((i, n, form, p, m, sha(out), sha(d.text or "")))
    assert sorted(map(tuple, queries.op13_fill_in_middle(spark, SF0001).collect())) == sorted(want)


def test_empty_table_and_no_shuffle(spark, none):
    got = fim.transform(none)
    assert got.columns == ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"] and got.collect() == []
    plan = fim.digest(got)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan

import hashlib
import random
import re

import pyarrow as pa
import pytest

from tests.conftest import SF0001
from vigil.llm import secrets
from vigil.llm.queries import op7_secret_scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    order = list(found)
    spans = sorted((a, order.index(k), b) for k, s in found.items() for a, b in s)
    text = ",".join(f"{order[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, found.values()), hashlib.sha256(text.encode()).hexdigest()), text


def planted(rng, n):
    parts = ["é ", "plain words ", "password=hunter2secret ", "PassWD : 'abcdefgh' ", "api_key=\"Zm9vYmFy+/==\" ", "apikey: short ",
             "secret=token=abcdefghij ", "AKIA" + "Z9" * 8 + " ", "AKIAshort ", "0123456789abcdef" * 2, "deadbeef" * 5 + "g", "ToKeN  =  x.y-z_1234 ",
             "ghp_" + "a1B2" * 9 + " ", "xoxb-123456789012 ", "-----BEGIN RSA PRIVATE KEY----- ", "Key ", "paſſword=abcdefghij "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(n)]


def check(found, docs):
    expected = sorted((str(r.doc_id), *brute(r.text)[0]) for r in docs)
    got = found.collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expected
    base = {}
    for r in docs:
        base.setdefault(str(r.doc_id), set()).update(brute(r.text)[1].split(","))
    for r in got:
        assert set(x for x in r.spans.split(",") if x.startswith(("assign", "access", "hex"))) <= base[str(r.doc_id)]


def test_planted_and_odd_texts_equal_brute_force(spark, odd):
    rows = [(100 + i, t, None, None) for i, t in enumerate(planted(random.Random(2), 400))]
    docs = odd.union(spark.createDataFrame(rows, odd.schema))
    check(secrets.digest(secrets.find_secrets(docs)), docs.collect())


def test_query_equals_brute_force(spark):
    check(op7_secret_scan(spark, SF0001), spark.read.parquet(f"{SF0001}/documents.parquet").collect())


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_a_match_always_satisfies_its_query(rule):
    texts = planted(random.Random(3), 3000)
    index = secrets.Scanner((rule,)).index(pa.array(texts))
    chosen = index.select(secrets.trigram_query(rule.pattern))
    for text, hit in zip(texts, chosen):
        assert hit or not rule.compiled().search(text)


def test_queries():
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is True
    assert secrets.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert secrets.trigram_query("x?") is True
    assert secrets.trigram_query("(abc|de)") is True
    assert secrets.trigram_query("foo.*bar") == ("and", (b"foo", b"bar"))


def test_other_spans_come_too(spark):
    docs = spark.createDataFrame([(1, "ghp_" + "z" * 36 + " AKIA" + "B" * 16)], "doc_id long, text string")
    assert secrets.digest(secrets.find_secrets(docs)).first().spans == "github:0:40,access:41:61"


def test_no_documents(none):
    assert secrets.digest(secrets.find_secrets(none)).count() == 0

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from vigil.llm import quality
from vigil.llm.queries import op10_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


@pytest.fixture(scope="module")
def learned(spark):
    return quality.learn(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def rows(df):
    return sorted(((str(r.doc_id), tuple(r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def test_odd_texts_equal_brute_force(odd, learned):
    expected = sorted(((str(r.doc_id), brute(r.text)) for r in odd.collect()), key=repr)
    found = quality.measure(odd, learned)
    assert rows(found) == expected
    assert all(not r.kept for r in found.collect() if r.base_failed)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    assert rows(op10_quality_rules(spark, SF0001)) == sorted(((str(r.doc_id), brute(r.text)) for r in docs), key=repr)


def test_keep_drops_what_measure_rejects_and_keeps_columns(spark, learned):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    kept = quality.keep(docs, learned)
    assert kept.columns == docs.columns
    passed = {r.doc_id for r in quality.measure(docs, learned).collect() if r.kept}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == passed


def test_labelled_clean_documents_stay(spark, learned):
    labels = spark.read.parquet(f"{SF0001}/labels.parquet").filter("quality = 1")
    found = quality.measure(spark.read.parquet(f"{SF0001}/documents.parquet"), learned).join(labels, "doc_id").filter("NOT base_failed")
    assert found.filter("NOT kept").count() == 0


def test_distance(learned):
    p = np.array([0.5, 0.5, 0.0])
    assert quality.js_distance(p, p) == 0
    assert quality.js_distance(p, np.array([0.0, 0.0, 1.0])) == pytest.approx(1)
    plain = quality.Judge(quality.Rules(), learned)
    prose = b"the cat of the house and the dog in a garden " * 8
    assert not plain.measure(b" ".join(prose.upper().split()[i] + b"#%" + b"%d" % i for i in range(80)))[6]


def test_many_different_words_fall_back_to_pairs():
    ids = np.array([0, 1 << 22, 5, 9, 0, 1 << 22, 5, 7], np.int64)
    assert quality.repeated_words(ids) == 6


def test_bounds_follow_the_good_documents(spark, learned):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.measure(docs, quality.References(learned.words, learned.classes)).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed")
    for name, bound in (("class_distance", learned.max_class_distance), ("common_distance", learned.max_common_distance)):
        values = sorted(r[0] for r in found.select(name).collect() if r[0] is not None)
        assert bound == pytest.approx(1.5 * np.quantile(values, 0.999))
    half = quality.learn(docs, labels, margin=0.75)
    assert half.max_class_distance == pytest.approx(learned.max_class_distance / 2)


def test_no_documents(none, learned):
    assert quality.measure(none, learned).count() == 0
    assert quality.keep(none, learned).columns == none.columns


ITALIAN = (
    "quel ramo del lago di Como, che volge a mezzogiorno, tra due catene non interrotte di monti, tutto a seni e a golfi, a seconda "
    "dello sporgere e del rientrare di quelli, vien, quasi a un tratto, a ristringersi, e a prender corso e figura di fiume, tra un "
    "promontorio a destra, e un'ampia costiera dall'altra parte; e il ponte, che ivi congiunge le due rive, par che renda ancor più "
    "sensibile all'occhio questa trasformazione, e segni il punto in cui il lago cessa, e l'Adda rincomincia, per ripigliar poi nome "
    "di lago dove le rive, allontanandosi di nuovo, lascian l'acqua distendersi e rallentarsi in nuovi golfi e in nuovi seni.")
FINNISH = " ".join("mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan "
                   f"lajivirttä laulamahan sanat suussani sulavat puhe'et putoelevat kielelleni kerkiävät säkeistö{'abcdefghij'[i]}" for i in range(10))


def test_a_language_without_reference_is_not_judged_by_common_words(learned):
    once = quality.Rules(max_repeat_percent=100)
    judge = quality.Judge(once, learned)
    found = judge.measure(FINNISH.encode())
    assert found[8] is None and found[6]
    assert judge.measure(ITALIAN.encode())[6]
    spam = judge.measure(" ".join("the of " + "abcdefghij"[i % 10] * 4 for i in range(100)).encode())
    assert spam[8] > learned.max_common_distance and not spam[6]  # such words, but distributed unlike the language


def test_references_are_learned_from_the_labelled_sample(spark):
    rows = [(i, "xx", "Zap zap, zap bim bom " * 30 if i % 2 else "junk ### " * 50) for i in range(40)] + [(99, None, "no language " * 600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1), (99, 1), (None, 1)], "doc_id long, quality int")
    learned = quality.learn(docs, labels)
    assert learned.words == {"xx": {b"zap": 0.6, b"bim": 0.2, b"bom": 0.2}}
    assert learned.classes["xx"] == pytest.approx((14 / 21, 1 / 21, 0, 5 / 21, 0, 1 / 21, 0))
    assert quality.learn(docs, labels, sample_docs=0) == quality.References({}, {})
    assert quality.learn(docs, labels, min_words=10**6) == quality.References({}, {})
    assert learned.max_class_distance == learned.max_common_distance == np.inf  # every text repeats itself: none passes the plain rules
    bounded = quality.learn(docs, labels, rules=quality.Rules(max_repeat_percent=100))
    assert bounded.max_class_distance < 0.01 and bounded.max_common_distance < 0.01  # all alike
    assert all(r.class_distance is None and r.common_distance is None for r in quality.measure(docs, references=quality.References({}, {})).collect())


def test_query_learns_from_its_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("documents", "labels"))
    expected = quality.measure(docs, references=quality.learn(docs, labels))
    assert sorted(op10_quality_rules(spark, SF0001).collect(), key=repr) == sorted(expected.collect(), key=repr)


def test_references_count_every_labelled_document(spark):
    """More good documents than a sample would take: each counts, in shares and in bounds."""
    def text(i):
        return " ".join("abcdefghij"[j % 10] * (1 + j // 10) for j in range(60)) + (" bim" if i < 1000 else " bom") * (i % 7) + "#" * (i % 100)

    docs = spark.createDataFrame([(i, "xx", text(i)) for i in range(3000)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    rules = quality.Rules(min_words_for_common=1, max_repeat_percent=100)
    learned = quality.learn(docs, labels, common=100, rules=rules)
    counts = Counter(w.strip(b".,;:!?'\"()-") for i in range(3000) for w in text(i).encode().split())
    n = sum(counts.values())
    assert learned.words["xx"] == pytest.approx({w: k / n for w, k in counts.items() if k * 500 >= n}, rel=1e-12)
    found = quality.measure(docs, quality.References(learned.words, learned.classes), rules=rules).filter("NOT base_failed").collect()
    assert learned.max_class_distance == pytest.approx(1.5 * np.quantile([r.class_distance for r in found], 0.999), rel=1e-12)
    assert learned.max_common_distance == pytest.approx(1.5 * np.quantile([r.common_distance for r in found], 0.999), rel=1e-12)


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 0.77, 0.999, 1.0])
def test_quantile_is_exact_however_few_cells(spark, share):
    rng = np.random.default_rng(3)
    values = [*map(float, rng.normal(size=150) ** 3), *[0.25] * 60, -1e9, 1e9]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "v double")
    assert quality.quantile(df, "v", share, cells=8) == pytest.approx(np.quantile(values, share), rel=1e-12)
    assert quality.quantile(df.filter("v IS NULL"), "v", share) is None


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("bits", [{}, {"max_bits": 1}, {"bits_per_id": 1, "probes": 1}])
def test_listed_documents_are_exact_whatever_the_filter_lets_through(spark, kind, bits):
    docs = spark.range(-3000, 6000).selectExpr(f"cast(id as {kind}) id", "'text ' || id text")
    docs = docs.unionAll(docs.limit(50)).unionAll(spark.sql(f"select cast(null as {kind}), 'none'"))
    good = spark.range(-6000, 5000, 3).selectExpr("cast(id as int) _good").unionAll(spark.sql("select cast(null as int)"))
    expected = docs.join(good, docs.id.cast("long") == good._good, "left_semi")
    # with one block of bits for 2,667 ids, and one bit an id, many others pass by chance
    assert sorted(quality.listed(docs, good, **bits).collect()) == sorted(expected.collect())


def test_listed_documents_without_good_ids(spark):
    docs = spark.range(9).withColumn("text", F.lit("x"))
    assert quality.listed(docs, spark.range(0).toDF("_good")).count() == 0


def test_learning_does_not_shuffle_texts(spark, tmp_path):
    """Whatever is labelled good, no exchange on the way to the texts carries them (before: a join by id did)."""
    docs = spark.range(2000).selectExpr("id doc_id", "'xx' lang", "repeat('zap bim bom ', 40) || id text")
    docs.write.parquet(f"{tmp_path}/documents")
    good = spark.range(0, 2000, 2).toDF("_good")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # fewer than the labels have
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents").select(F.col("doc_id").alias("id"), "text")
        found = quality.listed(docs, good)
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert found.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

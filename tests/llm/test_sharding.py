import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.llm import queries, sharding
from tests.conftest import SF0001


def place(x, rows, seed=1):
    side = math.isqrt(max(rows, 1) - 1) + 1
    while True:
        left, right = divmod(x, side)
        for k in range(sharding.ROUNDS):
            value = int(hashlib.md5(f"{seed}|{k}|{right}".encode()).hexdigest()[:8], 16)
            left, right = right, (left + value) % side
        x = left * side + right
        if x < rows:
            return x


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 10, 99, 100, 101, 2500, 10_007])
def test_permutation_and_its_inverse(spark, rows):
    n = F.col("id")
    got = spark.range(rows).select("id", sharding.permuted(n, rows, 7).alias("p"), sharding.locate(n, rows, 4, 7).alias("at"))
    got = got.withColumn("back", sharding.row_at(F.col("at.shard"), F.col("at.slot"), rows, 4, 7)).collect()
    assert sorted(r.p for r in got) == list(range(rows))
    assert all(r.p == place(r.id, rows, 7) and (r["at"].shard, r["at"].slot) == (r.p % 4, r.p // 4) and r.back == r.id for r in got)


def test_large_numbers(spark):
    rows = 10**11 + 3
    ids = [0, 1, 12345678901, rows - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("p", sharding.permuted(F.col("id"), rows))
    df = df.withColumn("back", sharding.permuted(F.col("p"), rows, inverse=True))
    assert [(r.p, r.back) for r in df.collect()] == [(place(i, rows), i) for i in ids]


def check(found, rows, shards):
    """Same rows as given, counts at most one apart, slots gapless, numbers from 0."""
    assert Counter(r.row for r in found) == Counter(rows)
    assert sorted(r.row_number for r in found) == list(range(len(rows)))
    slots = {s: sorted(r.slot for r in found if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(r.shard + shards * r.slot == place(r.row_number, len(rows)) for r in found)


def test_odd_texts(spark, odd, none):
    for shards in (1, 3, 40):
        check(sharding.assign(odd, shards).collect(), odd.collect(), shards)
    got = sharding.assign(none, 5)
    assert got.columns == ["row", "row_number", "shard", "slot"] and got.collect() == []
    with pytest.raises(ValueError):
        sharding.assign(odd, 0)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, "x", "y"), (1, 2, 3, 4, 5, "x", "y"), (None,) * 7],
                               "row int, shard int, slot int, `a.b` int, `c``d` int, copies string, same string")
    check(sharding.assign(df, 2).collect(), df.collect(), 2)


def test_equal_rows_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    monkeypatch.setattr(sharding, "SLICE", 3)
    df = spark.createDataFrame([(None, "hot")] * 500 + [(i, str(i)) for i in range(700)], "doc_id long, text string").repartition(6)
    found = sharding.assign(df, 9).collect()
    check(found, df.collect(), 9)
    # the order follows the rows, not how they are spread over tasks
    again = sharding.assign(df.repartition(3), 9).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    assert Counter(r.shard for r in sharding.assign(df, 9, seed=2).collect()) == Counter(r.shard for r in found)


def test_query_sizes_and_another_order_of_files(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    found = queries.op12_feistel_shards(spark, SF0001).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    assert {r.shard for r in found} == set(range(40)) and len({(r.shard, r.slot) for r in found}) == len(docs)
    # a shuffle: neighbours by id do not stay neighbours
    at = [(r.shard, r.slot) for r in sorted(found, key=lambda r: r.doc_id)]
    assert sum(abs(a[1] - b[1]) <= 0 and abs(a[0] - b[0]) <= 1 for a, b in zip(at, at[1:])) < len(at) / 20


def test_shards_written(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), shards=3, file_rows=2)
    got = spark.read.parquet(str(tmp_path / "s"))
    want = sharding.assign(odd, 3)
    key = lambda r: (r.shard, r.slot, r.row)
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, want.collect()), key=repr)
    for part in (tmp_path / "s").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(part)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))

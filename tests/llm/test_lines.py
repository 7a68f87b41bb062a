import random

import pytest

from vigil.llm import lines


def brute(rows, min_sites):
    sites, first = {}, {}
    order = lambda i: (i is not None, i)
    for r in rows:
        for n, line in enumerate((r.text or "").split("\n")):
            key = line.strip(" \t\r\x0b\x0c")
            if key:
                sites.setdefault(key, set()).add(r.source)
                place = (order(r.doc_id), n)
                first[key] = min(first.get(key, place), place)
    out = []
    for r in rows:
        if r.text is None:
            out.append((str(r.doc_id), None, 0, 0))
            continue
        parts = r.text.split("\n")
        stay = []
        for n, line in enumerate(parts):
            key = line.strip(" \t\r\x0b\x0c")
            if not key or len(sites[key]) < min_sites or first[key] == (order(r.doc_id), n):
                stay.append(line)
        out.append((str(r.doc_id), "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((str(r.doc_id), r.text, r._lines, r._removed) for r in df.collect()), key=repr)


def test_odd_texts(odd):
    for sites in (1, 2, 3):
        assert got(lines.dedup(odd, min_sites=sites)) == brute(odd.collect(), sites)
    assert lines.dedup(odd).columns == [*odd.columns, "_lines", "_removed"]


@pytest.fixture(scope="module")
def spread(spark, odd):
    """Lines on 1 to 400 sites, so estimates err on both sides of a threshold."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        site = rng.randrange(400)
        picked = [f"line {k}" for k in range(0, 400, 4) if site < k * 1.05] if rng.random() < 0.5 else [f"own {i}", "", "line 9"]
        rng.shuffle(picked)
        rows.append((i, "\n".join(f" {x}\r" if rng.random() < 0.3 else x for x in picked), f"site{site}", i))
    return spark.createDataFrame(rows, odd.schema).repartition(4).cache()


@pytest.mark.parametrize("sites", [3, 100, 250])
def test_near_threshold_lines_are_decided_exactly(spread, sites):
    assert got(lines.dedup(spread, min_sites=sites)) == brute(spread.collect(), sites)


def test_no_documents(none):
    assert lines.dedup(none).count() == 0


def test_clashing_names_and_many_lines_gone(spark, clashing):
    found = lines.dedup(clashing, min_sites=2)
    assert found.columns == [*clashing.columns, "_lines_", "_removed_"]
    plain = clashing.select("doc_id", "text", "source").collect()
    assert sorted(((str(r.doc_id), r.text, r._lines_, r._removed_) for r in found.collect()), key=repr) == brute(plain, 2)
    # a long text of which every other line goes
    rows = [(i, "\n".join(f"shared {k % 7}" if k % 2 else f"own {i} {k}" for k in range(20_000)), f"s{i}", i) for i in range(4)]
    long = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    assert got(lines.dedup(long, min_sites=3)) == brute(long.collect(), 3)

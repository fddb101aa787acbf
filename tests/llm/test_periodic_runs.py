"""Runs of words against a comparison of all positions and all periods."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hazardloom.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, runs string, n_words string, collapsed int"


def docs_of(spark, rows):
    """Rows of (doc_id, text) with columns that clash with inner and result names."""
    return spark.createDataFrame([(i, t, "r", "n", 1) for i, t in rows], SCHEMA)


def brute(w, least=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            smaller = any(all(w[k] == w[k + d] for k in range(start, start + size - d)) for d in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                found.append((start, size, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(seed, n):
    r = random.Random(seed)
    for k in range(n):
        size, kind = r.randrange(0, 70), k % 4
        if kind == 0:
            yield [r.choice("ab") for _ in range(size)]
        elif kind == 1:
            w = []
            while len(w) < size:
                w += [r.choice("abc") for _ in range(r.randrange(1, 6))] * r.randrange(1, 7)
            yield w
        elif kind == 2:
            yield ([r.choice("ab") for _ in range(r.randrange(1, 9))] * 9)[:size]
        else:
            yield [r.choice("abcdef") for _ in range(size)]


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 2), (9, 3)])
def test_runs_equal_brute_force(least, exponent):
    for w in texts(least, 800):
        numbers = periodic_runs.word_numbers([x.encode() for x in w])
        assert periodic_runs.runs_of(numbers, least, exponent) == brute(w, least, exponent), w


def test_long_texts_are_read_whole():
    numbers = periodic_runs.word_numbers([b"word"] * 100_000)
    assert periodic_runs.runs_of(numbers, 6, 4) == [(0, 100_000, 1)]
    unit = [b"%d" % i for i in range(40)]
    numbers = periodic_runs.word_numbers([b"%d" % (1000 + i) for i in range(50_000)] + unit * 500)
    assert periodic_runs.runs_of(numbers, 6, 4) == [(50_000, 20_000, 40)]


def test_odd_rows(spark):
    rows = [(None, "a b " * 5), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "y z " * 4), (5, "y z " * 4)]
    found = periodic_runs.find(docs_of(spark, rows))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted([(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in found.collect()], key=str)
    expected = [
        (None, 10, [(0, 10, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "x"), (4, 1, [], "x"),
        (5, 8, [(0, 8, 2)], "y z"), (5, 8, [(0, 8, 2)], "y z"),
    ]
    assert got == sorted(expected, key=str)
    assert periodic_runs.find(docs_of(spark, [])).collect() == []
    assert periodic_runs.summary(periodic_runs.find(docs_of(spark, []))).collect() == []


def test_unicode_space_is_no_separator(spark):
    found = periodic_runs.find(docs_of(spark, [(1, "a b " * 6 + "a\x1cb")])).first()
    assert found["n_words"] == 7 and [tuple(r) for r in found["runs"]] == [(0, 6, 1)]


def test_greatest_exponent_wins(spark):
    text = "x " * 6 + "m " + "a b " * 6 + "n " + "c d " * 7 + "o " + "e f " * 7
    found = periodic_runs.summary(periodic_runs.find(docs_of(spark, [(1, text)]))).first()
    assert (found["n_runs"], found["start"], found["length"], found["period"], found["exponent_milli"]) == (4, 20, 14, 2, 7000)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(w) if i % 17 else None) for i, w in enumerate(texts(9, 300))]
    rows += [(1000 + i, "\n".join(str(r.random()) for _ in range(200))) for i in range(40)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {x["doc_id"]: x for x in queries.op11_kruskal_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    planted = 0
    for i, text in rows:
        w = (text or "").split()
        n, (g, rest) = len(w), divmod(zlib.crc32(str(i).encode()), 10)
        if rest == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert found[i]["n_runs"] == len(runs)
        assert found[i]["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert found[i]["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        if runs:
            s, m, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (found[i]["start"], found[i]["length"], found[i]["period"]) == (s, m, q)
            assert found[i]["exponent_milli"] == 1000 * m // q
        else:
            assert found[i]["start"] is None and found[i]["exponent_milli"] is None
    assert planted > 20


def test_no_shuffle(spark):
    plan = periodic_runs.find(docs_of(spark, [(1, "a")])).select(F.size("runs"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan

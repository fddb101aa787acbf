"""Vector codes against full comparison in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int"


def vectors_of(spark, rows):
    """Rows of (vec_id, embedding, label) with columns that clash with inner and result names."""
    return spark.createDataFrame([(*r, "v", 1) for r in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    points = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    width = len(points[0]) // parts
    cut = [[p[i * width : (i + 1) * width] for i in range(parts)] for p in points]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], points[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p])) for p, x in enumerate(c)]
            for c in cut
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                members = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    result = [(r[0], r[2], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(kept, assign())]
    listed = ",".join(str(x) for book in books for e in book for x in e)
    return result, hashlib.sha256(listed.encode()).hexdigest()


def random_rows(seed, n, dims=32):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.uniform(-1, 1), 0.5, -0.25]) for _ in range(dims)], r.choice([None, 0, 1])) for i in range(n)]
    return rows + [(n + i, rows[i][1], 7) for i in range(5)]


@pytest.mark.parametrize("seed, size, width", [(1, 64, 4), (2, 7, 1), (3, 1, 3), (4, 200, 2)])
def test_search_equals_full_comparison(seed, size, width):
    r = np.random.default_rng(seed)
    book = r.integers(-6, 7, (size, width))  # few values: many ties and equal entries
    points = r.integers(-9, 10, (500, width))
    entry, apart = vector_codes.nearest(points, book)
    full = ((points[:, None] - book[None]) ** 2).sum(2)
    assert (apart == full.min(1)).all() and (entry == full.argmin(1)).all()


def test_query_against_brute_force(spark, tmp_path):
    rows = random_rows(3, 300)
    rows += [(900, None, 1), (901, [0.1] * 31 + [None], 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, None)]
    vectors_of(spark, rows).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_orchard_codes(spark, str(tmp_path)).collect()
    expected, digest = brute(rows)
    sums = {}
    for _, label, _, error in expected:
        sums[label] = sums.get(label, 0) + error
    assert {r["codebooks_sha256"] for r in found} == {digest}
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found)
    assert got == sorted((i, code, error, sums[label]) for i, label, code, error in expected)


def test_few_rows_and_ties(spark):
    rows = [(1, [0.5] * 16, 0), (1, [0.25] * 16, 0), (1, [0.5] * 16, 0), (None, [9.0] * 16, None)]
    fitted = vector_codes.fit(vectors_of(spark, rows))
    assert fitted.books.shape == (16, 4, 1)
    assert sorted(fitted.books[0, :, 0].tolist()) == [64, 128, 128, 2304]
    coded = vector_codes.encode(vectors_of(spark, rows), fitted).collect()
    assert [r["error"] for r in coded] == [0] * 4 and coded[0]["code"] == coded[2]["code"] == "01" * 16


def test_other_lengths_and_large_components(spark):
    rows = [(0, [1.0] * 15, 0), (1, [1.0] * 16, 0), (2, [1.0] * 32, 0), (3, [], 1), (4, [1e30] * 16, 1), (5, [2.0] * 16, 1)]
    table = vectors_of(spark, rows)
    fitted = vector_codes.fit(table)
    assert fitted.books.shape == (16, 2, 1)
    coded = {r["vec_id"]: (r["code"], r["label_error"]) for r in vector_codes.with_label_error(vector_codes.encode(table, fitted)).collect()}
    assert coded == {0: (None, 0), 1: ("00" * 16, 0), 2: (None, 0), 3: (None, 0), 4: (None, 0), 5: ("01" * 16, 0)}


def test_empty_table(spark, tmp_path):
    vectors_of(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op12_orchard_codes(spark, str(tmp_path)).collect() == []
    none = vectors_of(spark, [(1, None, 1), (2, [], 1)])
    coded = vector_codes.encode(none, vector_codes.fit(none)).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in coded] == [(2, None, None)]


def test_decoded_vectors_are_near(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fitted = vector_codes.fit(table)
    coded = vector_codes.encode(table, fitted)
    joined = coded.join(vector_codes.quantised(table).select("vec_id", "v"), "vec_id").select("v", "code", "error").collect()
    for r in joined:
        picked = [int(r["code"][i : i + 2], 16) for i in range(0, 32, 2)]
        back = [x for p, e in enumerate(picked) for x in fitted.books[p, e].tolist()]
        assert sum((a - b) ** 2 for a, b in zip(r["v"], back)) == r["error"]
    assert coded.where(F.col("code").isNull()).count() == 0

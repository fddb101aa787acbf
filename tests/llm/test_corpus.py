"""The corpus operators against brute force, planted cases and odd input."""

import collections
import math
import random
import zlib

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from hazardloom.llm import (
    decontamination, grammar, mixing, near_dedup, quality_rules, queries, scoring, sharding, suffix_dedup, url_filter, warc,
)
from hazardloom.session import scratch_path

SCHEMA = "doc_id long, text string, source string, lang string, n_words long, k string, node long"


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with columns that clash with inner names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "a", "en", 7, "k", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


ODD = [(None, "x y z"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "word " * 30_000), (7, sentence(1, 80))]


def by_id(rows, name="doc_id"):
    return {r[name]: r for r in rows}


# ---- 1 ------------------------------------------------------------------------------------------


def test_quality_odd_rows(spark):
    found = quality_rules.judge(docs_of(spark, ODD)).collect()
    assert len(found) == len(ODD)
    rows = by_id(found)
    assert rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[1]["base_failed"]
    assert rows[6]["n_repeat_words"] == 30_000 and not rows[6]["kept"]
    assert rows[7]["kept"] and rows[7]["words_left"] == 80
    assert quality_rules.judge(docs_of(spark, [])).collect() == []
    kept = quality_rules.keep_good(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, []).columns
    assert [r["doc_id"] for r in kept.collect()] == [7]


def test_line_frequency(spark):
    menu = "\n".join("Menu  " + sentence(300 + i, 4) for i in range(12))
    rows = [(i, menu + "\n" + sentence(i, 10), "h") for i in range(12)]
    rows += [(100 + i, menu + "\n" + sentence(i, 10), "other") for i in range(3)]
    rows += [(200 + i, sentence(999, 60).replace(" ", "\n", 20), "copies") for i in range(30)]
    found = by_id(quality_rules.judge(docs_of(spark, rows)).collect())
    assert all(found[i]["words_left"] == 10 and not found[i]["kept"] for i in range(12))
    assert all(found[100 + i]["kept"] for i in range(3))
    assert all(found[200 + i]["kept"] for i in range(30))  # one text, however often


def test_line_frequency_of_long_lines(spark):
    notice = sentence(400, 60)
    assert len(notice) > 200
    rows = [(i, notice + "\n" + sentence(i, 10), "h") for i in range(12)]
    rows += [(100 + i, notice + "\n" + sentence(i, 10), "other") for i in range(3)]
    found = by_id(quality_rules.judge(docs_of(spark, rows)).collect())
    assert all(found[i]["words_left"] == 10 and not found[i]["kept"] for i in range(12))
    assert all(found[100 + i]["words_left"] == 70 and found[100 + i]["kept"] for i in range(3))
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(docs_of(spark, rows)).collect()) == [100, 101, 102]


def test_near_copies_count_once(spark):
    lines = [sentence(500 + i, 6) for i in range(30)]
    copies = [lines[:i] + [lines[i] + "x"] + lines[i + 1 :] for i in range(12)]
    rows = [(i, "\n".join(x), "h") for i, x in enumerate(copies)]
    # pages of one menu are no near copies
    menu = "\n".join(sentence(300 + i, 5) for i in range(12))
    rows += [(100 + i, menu + "\n" + sentence(i, 10), "h") for i in range(12)]
    rows += [(200 + i, lines[20] + "\n" + sentence(600 + i, 60), "h") for i in range(3)]
    kept = quality_rules.keep_good(docs_of(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(12), 200, 201, 202]


# ---- 2 ------------------------------------------------------------------------------------------


def test_targets_by_water_filling(spark):
    sizes = [("b", 100), ("a", 100), ("c", 1000), (None, 50), ("z", 0)]
    rows = spark.createDataFrame(sizes, "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    order = ["a", "b", "c", "z", None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = dict(sizes)
    open_, goal = set(order), {}
    while True:
        left = 1.5 * sum(size.values()) - sum(goal.values())
        fair = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if fair[s] > 2 * size[s]}
        if not full:
            goal |= fair
            break
        goal |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    assert {s: pytest.approx(v) for s, v in goal.items()} == found


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, sentence(i, 20 + i % 50), f"s{min(i % 9, 4)}") for i in range(900)]
    df = docs_of(spark, rows)
    plan = mixing.plan(df, block_rows=40).collect()
    again = mixing.plan(df.repartition(7), block_rows=40).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    taken = collections.Counter()
    for r in plan:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["taken"]
    goal = {r["source"]: r["target"] for r in plan}
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.03 * goal[s] + 70
    mixed = mixing.mix(df, block_rows=40)
    assert mixed.columns == df.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies == {r["doc_id"]: r["copies"] for r in plan if r["copies"]}


def test_equal_rows_spread_over_blocks(spark, monkeypatch):
    most = []
    rows = [(None, "one two three", "a")] * 3_000 + [(i, sentence(i, 9), "b") for i in range(50)]
    stored = mixing.stored

    def watch(df, name):
        out = stored(df, name)
        if name == "mix-level" and not most:
            most.append(out.groupBy("source", "block").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(mixing, "stored", watch)
    plan = [mixing.plan(docs_of(spark, rows).repartition(n), block_rows=100).collect() for n in (1, 5)]
    assert most[0] < 180  # 31 blocks of about 100
    one, two = (sorted((str(r["doc_id"]), r["taken"]) for r in p) for p in plan)
    assert one == two and len(one) == 3_050
    target = next(r["target"] for r in plan[0] if r["source"] == "a")
    assert abs(sum(r["taken"] for r in plan[0] if r["source"] == "a") - target) <= 3


def test_pivot_keeps_the_mass():
    r = random.Random(4)
    for n in (1, 2, 7, 500):
        p = [r.random() for _ in range(n)]
        out, rest = mixing._pivot([(x, r.random()) for x in p], False)
        assert sum(x or 0 for x in out) + rest == pytest.approx(sum(p))
        assert sum(x is None for x in out) <= 1
    mean = sum(mixing._pivot([(0.3, r.random()), (0.3, r.random())], True)[0][0] for _ in range(4000)) / 4000
    assert abs(mean - 0.3) < 0.03


def test_mix_odd_rows(spark):
    found = mixing.plan(docs_of(spark, ODD + [(9, "a b", None)])).collect()
    assert len(found) == len(ODD) + 1
    assert all(r["size"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert mixing.plan(docs_of(spark, [])).collect() == []
    mixed = mixing.mix(docs_of(spark, [(5, "one two", "a")] * 6 + [(6, "x", "a")])).collect()
    planned = mixing.plan(docs_of(spark, [(5, "one two", "a")] * 6 + [(6, "x", "a")])).collect()
    assert len(mixed) == sum(r["copies"] for r in planned)


# ---- 3 ------------------------------------------------------------------------------------------


def test_scores_against_counts(spark):
    rows = [(i, sentence(i % 40, 30) + (" Rare%d" % i), "a") for i in range(120)]
    for head in (1_000_000, 20):
        found = by_id(scoring.score(docs_of(spark, rows), head_words=head).collect())
        lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t).split() + ["\n"]
        count = collections.Counter()
        for i, t, _ in rows:
            if zlib.crc32(str(i).encode()) % 7 != 2:
                count.update(lower(t))
        total, vocabulary = sum(count.values()), len(count)
        for i, t, _ in rows:
            r, words = found[i], lower(t)
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
            assert r["n_tokens"] == len(words) and r["train_tokens"] == total
            assert r["n_known"] == sum(count[w] > 0 for w in words)
            base = sum(math.log10((count[w] + 1) / (total + vocabulary + 1)) for w in words)
            assert r["base_score"] == pytest.approx(base)
            assert r["score"] <= 0
        held = [r for r in found.values() if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_score_uses_every_count(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(scoring, "BITS_PER_ENTRY", 1024)  # no false hits
    rows = [(i, " ".join(f"w{i % 3}{j % (5 + i % 11)} v{i * j % 37}" for j in range(40)) + f" only{i}", "a") for i in range(60)]
    rows += [(i + 60, rows[i][1], "a") for i in range(5)]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    words_of = {i: ["\n", *t.split(), "\n"] for i, t, _ in rows}
    one, two = collections.Counter(), collections.Counter()
    for i, w in words_of.items():
        if i not in held:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
    assert min(one.values()) == min(two.values()) == 1
    places = sum(one.values()) + len(one) + 1

    def bounds(count):
        if not count:
            return 0, 0
        low, high = scoring.count_bounds(scoring.levels_of(np.array([count]), 1), 1)
        return low[0], high[0]

    def expected(w):
        total = 0
        for a, b in zip(w, w[1:]):
            low2, share = bounds(two[a, b])[0], (bounds(one[b])[0] + 1) / places
            total += math.log10(low2 + scoring.MU * share) - math.log10(max(bounds(one[a])[1], low2) + scoring.MU)
        return total

    # all n-grams in the filter, all but pairs seen once, only frequent ones, none
    entries = lambda counts: int(scoring.levels_of(np.array(list(counts)), 1).sum())
    often = entries(c for c in two.values() if c > 1)
    for room in (1 << 16, 2 * entries(one.values()) + often, entries(one.values()), 0):
        found = by_id(scoring.score(docs_of(spark, rows), max_bytes=room * 128, head_words=20).collect())
        assert len(found) == len(rows)
        for i, w in words_of.items():
            assert found[i]["score"] == pytest.approx(expected(w)), (room, i)


def test_score_does_not_follow_the_filter_size(spark):
    """With the real constants, a filter that holds a part of the n-grams scores as one that holds all."""
    import numpy as np

    r = random.Random(12)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 4000}"
    rows = [(i, " ".join(word() for _ in range(60)), "a") for i in range(1500)]
    df = docs_of(spark, rows)
    grams = scoring.counts(df)
    _, blocks, least = scoring.build_filter(grams)
    assert least == {1: 1, 2: 1}
    full = by_id(scoring.score(df).collect())
    for part in (8, 40):
        limit = blocks * scoring.BLOCK_BITS // 8 // part
        bits, _, least = scoring.build_filter(grams, limit)
        assert least[2] > 1 and 0 < len(bits) <= limit + 64
        assert sum(bin(b).count("1") for b in bits) < 0.2 * 8 * len(bits)
        found = by_id(scoring.score(df, max_bytes=limit).collect())
        # about one probe in a thousand is a false hit, and a document asks for some 180
        absent = np.random.default_rng(part).integers(0, 1 << 63, 200_000).astype(np.uint64)
        blocks_here = len(bits) * 8 // scoring.BLOCK_BITS
        assert (scoring.probe(np.frombuffer(bits, np.uint8), absent, blocks_here) > 0).mean() < 0.001
        apart = sorted(abs(found[i]["score"] / full[i]["score"] - 1) for i in full)
        assert apart[len(apart) // 2] < 1e-9 and sum(apart) / len(apart) < 0.003 and apart[-1] < 0.06


def test_filter_levels():
    import numpy as np

    keys = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = np.random.default_rng(4).integers(1, 5000, 20_000)
    levels = scoring.levels_of(counts, 1)
    blocks = 20_000 * scoring.BITS_PER_ENTRY * 12 // scoring.BLOCK_BITS
    raw = b"".join(
        scoring.segment_bytes(entry[at == s], blocks, s)
        for entry in [scoring.entries(keys, levels)]
        for at in [scoring.block_of(entry, blocks) // scoring.SEGMENT_BLOCKS]
        for s in range(-(-blocks // scoring.SEGMENT_BLOCKS))
    )
    found = scoring.probe(np.frombuffer(raw, np.uint8), keys, blocks)
    assert (found >= levels).all() and (found == levels).mean() > 0.97
    low, high = scoring.count_bounds(levels, 1)
    assert ((low <= counts) & (counts <= high)).all()


def test_score_in_chunks_and_parts(spark, monkeypatch):
    """Chunks and parts follow the tokens, scores do not follow them, and nothing is sent to all executors."""
    import numpy as np

    def refused(*_):
        raise AssertionError("no broadcast")

    monkeypatch.setattr(scoring, "BITS_PER_ENTRY", 1024)  # no false hits
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    rows = [(i, " ".join(f"w{i * j % 53} v{j % (3 + i % 7)}" for j in range(30)) + f" only{i}", "a") for i in range(80)]
    rows += [(None, "w1 W2  w3", "a"), (7, None, "b"), (8, " ".join(f"w{j}" for j in range(900)), "a")] + rows[:4]
    df = docs_of(spark, rows)
    whole = collections.Counter(map(repr_of, scoring.score(df).collect()))
    monkeypatch.setattr(scoring, "CHUNK", 500)
    made = scoring.chunks(df)
    tokens = [sum(r["lengths"]) for r in made.collect()]
    assert len(tokens) > 8 and sorted(tokens)[-2] <= 1000 and max(tokens) < 1500
    words_of = [["\n", *(t or "").lower().split(), "\n"] for _, t, _ in rows]
    learned = [w for (i, _, _), w in zip(rows, words_of) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(x for w in learned for x in w[1:])
    answered = scoring.answers(made, 16).collect()
    assert sum(r["vocabulary"] for r in answered) == len(one) and len({r["part"] for r in answered}) == 16
    # a part answers its share of the n-grams that the chunks hold, a byte each and the words' exact counts
    sent = [len(r["levels"]) + len(r["pair_levels"]) for r in answered]
    by_part = collections.Counter()
    for r, n in zip(answered, sent):
        assert len(r["counts"]) == 8 * len(r["levels"])
        by_part[r["part"]] += n
    assert max(by_part.values()) < 2 * sum(sent) / 16
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in answered])
    assert counts.max() == max(one.values())
    for settings in ({"head_words": 300}, {"max_bytes": 0}):
        assert collections.Counter(map(repr_of, scoring.score(df, **settings).collect())) == whole


def repr_of(row):
    return repr([f"{x:.9g}" if isinstance(x, float) else x for x in row])


def test_packed_numbers():
    import numpy as np

    for size, most in ((0, 1), (1, 1), (1000, 200), (5000, 1 << 32)):
        numbers = np.random.default_rng(size).integers(0, most, size)
        assert (scoring.unpack_numbers(scoring.pack_numbers(numbers), size) == numbers).all()
    assert len(scoring.pack_numbers(np.arange(50_000) % 256)) < 10_000


def test_scores_of_odd_rows(spark):
    found = scoring.score(docs_of(spark, ODD)).collect()
    assert len(found) == len(ODD)
    assert by_id(found)[1]["n_tokens"] == 1
    assert scoring.score(docs_of(spark, [])).collect() == []
    # nothing to learn from
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    lone = scoring.score(docs_of(spark, [(held, "a b")])).collect()[0]
    assert lone["train_tokens"] == 0 and lone["n_known"] == 0 and math.isfinite(lone["score"])


# ---- 4 ------------------------------------------------------------------------------------------


def brute_contamination(text, items):
    import hashlib
    import re

    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    w, hit, ids = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        m = min(13, len(v))
        for j in range(len(v) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[j : j + m]:
                    hit.update(range(i, i + m))
                    ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_brute_force(spark):
    items = [(10, sentence(50, 30)), (2, sentence(51, 13)), (3, sentence(52, 6)), (4, "solo"), (5, None), (6, ""), (7, "a-b c"), (2, sentence(51, 13))]
    texts = [
        sentence(60, 40) + " " + sentence(50, 30) + " " + sentence(61, 40),
        "X, " + sentence(50, 30).upper().replace(" ", "... ") + " " + sentence(62, 500),
        sentence(51, 12), sentence(51, 13), sentence(63, 300) + " " + sentence(52, 6), "Solo solo é solo", "a b c a b", None, "", sentence(64, 90),
        sentence(50, 30) * 2,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (100, texts[0])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, window string, pos int")
    found = decontamination.report(docs_of(spark, rows), df).collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_contamination(text, items)
    clean = decontamination.drop_contaminated(docs_of(spark, rows), df)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in found if not r["contaminated"])
    none = decontamination.report(docs_of(spark, rows), df.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert decontamination.report(docs_of(spark, []), df).collect() == []


# ---- 5 ------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        "http://a.b.net/x", "https://EXAMPLE.net/en/1?q=/", "https://example.net/en", "http://x.example.com/de/#a", "http://example.com/d",
        "http://net", "http://net/", "x://org/fr/y", "http://notorg/fr/", "ftp", None, "", "://", "http://a.org?/fr/", "http://h/a://b.net/",
    ]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("example.com", "/d", "allow")]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p")], "page_id long, url string, host string, path string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(found) == len(urls) + 1

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        stop = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, tail = rest[:stop].lower(), rest[stop:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0] or [len(tail)])]
        fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]])
    none = url_filter.judge(pages, spark.createDataFrame([], "host string, path string, action string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


# ---- 6 ------------------------------------------------------------------------------------------


def test_salvage_of_damaged_archives(spark, tmp_path):
    import io

    big = "x" * 1500
    pages = [(i, f"http://h/{i}", f"page {i} " + sentence(i, 300)) for i in range(20)] + [(30, None, big), (31, "u", big), (32, "u", None), (None, "u", big)]
    df = spark.createDataFrame([(*p, "s") for p in pages], "page_id long, url string, html string, sha1 string")
    found = warc.round_trip(df).collect()
    assert len(found) == len(pages)
    rows = by_id(found, "page_id")
    assert rows[30]["record_type"] == "revisit" and rows[30]["refers_to"] == 31 and rows[30]["payload_bytes"] == 1500
    assert rows[31]["record_type"] == "response" and rows[None]["refers_to"] == 31 and rows[32]["payload_bytes"] == 0
    files = warc.write(warc.plan(df.coalesce(1)), scratch_path(spark, "w")).collect()
    data = bytearray(open(files[0]["path"].removeprefix("file:"), "rb").read())
    parts = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
    assert [p[0] for p in parts] == ["record"] * len(pages)
    # a flipped byte, and a stretch of another file with the magic number in it
    _, start, end, *_ = parts[3]
    data[(start + end) // 2] ^= 0xFF
    _, cut, *_ = parts[8]
    data[cut:cut] = b"\x1f\x8b\x08 not a member " * 3
    parts = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
    gaps = [(a, b) for kind, a, b, *_ in parts if kind == "gap"]
    assert gaps == [(start, end), (cut, cut + 51)]
    assert sum(p[0] == "record" for p in parts) == len(pages) - 1
    assert [p[1] for p in parts[1:]] == [p[2] for p in parts[:-1]]
    # uncompressed records, one of them with a wrong length
    plain = [warc.page_record(i, "u", "response", None, f"body {i}".encode(), "00" * 20, str(i)) for i in range(4)]
    plain[1] = plain[1].replace(b"Content-Length: ", b"Content-Length: 9")
    data = b"junk" + b"".join(plain)
    parts = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [p[0] for p in parts] == ["gap", "record", "gap", "record", "record"]
    # read through Spark, gaps included
    path = scratch_path(spark, "w")
    where = path.removeprefix("file:")
    pyarrow.fs.LocalFileSystem().create_dir(where)
    open(f"{where}/a.warc", "wb").write(data)
    listed = spark.createDataFrame([(f"{where}/a.warc" if where == path else f"file:{where}/a.warc", len(data))], "path string, bytes long")
    assert listed.count() and collections.Counter(r["kind"] for r in warc.read(listed.withColumn("path", F.concat(F.lit("file:"), F.regexp_replace("path", "^file:", "")))).collect()) == {"record": 3, "gap": 2}
    assert warc.round_trip(df.limit(0)).collect() == []


def test_long_heads_come_back(spark):
    urls = {1: "http://h/1", 2: "http://h/" + "p" * 1_100_000, 3: None, 4: "http://h/" + "é" * 300_000}
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.round_trip(df).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("hold", [1 << 10, 4 << 20])
def test_members_of_many_records(monkeypatch, hold):
    import gzip
    import io

    monkeypatch.setattr(warc, "HOLD", hold)
    monkeypatch.setattr(warc, "CHUNK", 1 << 12)

    def made(i, n=900):
        body = sentence(i, n).encode()
        return warc.page_record(i, "u", "response", None, body, "00" * 20, str(i))

    def found(data):
        parts = list(warc.salvage(io.BytesIO(data), len(data)))
        return [int(p[3]["x-page-id"]) for p in parts if p[0] == "record"], [p for p in parts if p[0] == "gap"]

    whole = [made(i) for i in range(30)]
    # a file compressed as a whole, and two members of several records
    assert found(gzip.compress(b"".join(whole))) == (list(range(30)), [])
    two = gzip.compress(b"".join(whole[:2])) + gzip.compress(whole[2]) + gzip.compress(b"".join(whole[3:9]))
    assert found(two) == (list(range(9)), [])
    # a broken record inside a whole member: the others count, the gap has its place in the inflated bytes
    broken = [*whole[:4], whole[4].replace(b"Content-Length: ", b"Content-Length: 9"), *whole[5:]]
    data = gzip.compress(b"".join(broken)) + gzip.compress(whole[0])
    ids, gaps = found(data)
    before = sum(map(len, broken[:4]))
    assert ids == [*range(4), *range(5, 30), 0] and [g[5:] for g in gaps] == [(before, before + len(broken[4]))]
    # a member that breaks off, and one with a flipped byte: records before the damage carry their digest
    first = gzip.compress(b"".join(whole))
    ids, gaps = found(first[: len(first) // 2])
    assert 5 < len(ids) < 30 and ids == list(range(len(ids))) and len(gaps) == 1
    hurt = bytearray(first)
    hurt[len(first) * 2 // 3] ^= 0x55
    ids, gaps = found(bytes(hurt) + gzip.compress(whole[0]))
    assert ids[:10] == list(range(10)) and ids[-1] == 0 and len(ids) < 31 and [g[1:3] for g in gaps] == [(0, len(first))]
    # records that name no digest count only in whole members
    bare = [b"\r\n".join(x for x in r.split(b"\r\n") if not x.startswith(b"WARC-Block-Digest")) for r in whole]
    assert found(gzip.compress(b"".join(bare))) == (list(range(30)), [])
    assert found(gzip.compress(b"".join(bare))[:-200])[0] == []
    # a member of something else, an empty one, and a version line whose head is no head
    other = gzip.compress(b"x" * 50_000) + gzip.compress(b"") + b"WARC/1.1\r\nno field\r\n" + gzip.compress(whole[1])
    ids, gaps = found(other)
    assert ids == [1] and len(gaps) == 1 and gaps[0][1] == 0


# ---- 7 ------------------------------------------------------------------------------------------


def bag(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(rows):
    bags = [bag(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()) - 1e-9:
                label[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return sorted((d, min(ids[root(i)])) for i, (d, _) in enumerate(rows))


def test_near_duplicates_brute_force(spark):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = sentence(g, 60 + 40 * g).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(10_000)
            rows.append((len(rows), " ".join(w)))
            if r.random() < 0.2:
                base = w  # a chain of edits
    rows += [(1000, "one two"), (1001, "one  two"), (1002, "one two three"), (1003, "a b " * 400), (1004, "a b " * 390), (1005, "a b " * 200)]
    found = near_dedup.classes(docs_of(spark, rows))
    assert sorted((x["doc_id"], x["class_id"]) for x in found.collect()) == brute_classes(rows)
    kept = near_dedup.keep_one(docs_of(spark, rows))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_signature_agreement_is_the_weighted_similarity():
    import numpy as np

    g = np.random.default_rng(2)
    a = g.integers(0, 1 << 63, 300).astype(np.uint64)
    x = np.concatenate([a, np.concatenate([a[:240], g.integers(0, 1 << 63, 60).astype(np.uint64)]), np.repeat(a[:60], 3), np.repeat(a[:60], 8)])
    s = near_dedup.signatures(x, np.array([0, 300, 600, 780, 1260]), 6000)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.03
    assert abs((s[2] == s[3]).mean() - 3 / 8) < 0.03
    assert abs((s[0] == s[2]).mean() - 60 / 420) < 0.03


def test_near_duplicates_odd_rows(spark):
    found = near_dedup.classes(docs_of(spark, ODD)).collect()
    assert len(found) == len(ODD)
    rows = by_id(found)
    assert rows[1]["class_id"] == 1 and rows[2]["class_id"] == 2 and rows[5]["class_id"] == 4 and rows[5]["class_docs"] == 3
    assert near_dedup.classes(docs_of(spark, [])).collect() == []
    kept = near_dedup.keep_one(docs_of(spark, ODD)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "6", "7", "None"]
    same = near_dedup.keep_one(docs_of(spark, [(5, "one two")] * 4)).collect()
    assert len(same) == 1


# ---- 8 ------------------------------------------------------------------------------------------


def test_passages_brute_force(spark):
    shared, tail = sentence(70, 75), sentence(71, 50)
    rows = [
        (1, sentence(80, 40) + " " + shared + " " + sentence(81, 30)),
        (2, shared + " " + sentence(82, 200) + " " + tail),
        (3, sentence(83, 10) + " " + tail),
        (4, sentence(84, 90)), (5, sentence(84, 90)),
        (6, sentence(85, 49)), (7, sentence(85, 49)),
        (8, sentence(86, 60) + " " + sentence(86, 60)),
        (9, " ".join(shared.split()[5:54])),
        (10, None), (11, ""),
    ]
    found = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.spans(docs_of(spark, rows)).collect())
    assert found == [(1, 40, 115), (2, 0, 75), (2, 275, 325), (3, 10, 60), (4, 0, 90), (5, 0, 90)]
    assert suffix_dedup.spans(docs_of(spark, [])).collect() == []
    hot = [(i, sentence(1000 + i, 30) + " " + shared + " " + sentence(2000 + i, 20)) for i in range(60)]
    found = suffix_dedup.spans(docs_of(spark, hot)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == {(i, 30, 105) for i in range(60)}


# ---- 9 ------------------------------------------------------------------------------------------


def test_grammar_round_trip():
    import numpy as np

    g = np.random.default_rng(6)
    for base, top in ((50_257, 300), (200_000, 199_999), (50_257, 2)):
        lengths = g.integers(0, 400, 200)
        lengths[:3] = 0
        ids = g.zipf(1.5, lengths.sum()).clip(0, top).astype(np.uint32)
        shard = grammar.Shard(grammar.pack(ids, lengths, base))
        assert (shard.all_ids() == ids).all() and (shard.lengths == lengths).all()
        ends = np.cumsum(lengths)
        for i in (0, 3, 57, 199):
            assert (shard.document(i) == ids[ends[i] - lengths[i] : ends[i]]).all()
        assert len(shard.rules) and len(shard.symbols) < 0.9 * len(ids)
        assert (shard.sizes == [len(x) for x in grammar._expansions(shard.rules, base)]).all()


def test_no_pair_stays_frequent():
    import numpy as np

    g = np.random.default_rng(8)
    passage = g.integers(0, 5_000, 300)
    ids = np.concatenate([np.concatenate([passage, g.integers(0, 5_000, 40)]) for _ in range(50)] + [np.zeros(5_000, int)]).astype(np.uint32)
    lengths = np.array([340] * 50 + [5_000])
    symbols, counts, rules = grammar.compress(ids, lengths, 50_257)
    sizes = grammar.expansion_lengths(rules, 50_257)
    # the shared passage ends up as one symbol, equal ids as powers of two
    assert sizes.max() >= 256 and len(symbols) < 50 * 60
    at, left = 0, collections.Counter()
    for n in counts:
        row = symbols[at : at + n].tolist()
        at += n
        # equal neighbours overlap: count them left to right without overlap
        i = 0
        while i + 1 < len(row):
            left[row[i], row[i + 1]] += 1
            i += 2 if row[i] == row[i + 1] else 1
    assert max(left.values()) < grammar.MIN_COUNT
    assert (grammar.decode(symbols, rules, sizes, 50_257) == ids).all()


def test_frequent_pairs_and_new_runs():
    import numpy as np

    for least in (1, 2, 3, 16):
        for size in (0, 1, 2, 15, 16, 400, 5000):
            keys = np.sort(np.random.default_rng(size).integers(0, 60 + size // 40, size).astype(np.uint32))
            count = collections.Counter(keys.tolist())
            found, often = grammar._frequent(keys, least)
            assert dict(zip(found.tolist(), often.tolist())) == {k: c for k, c in count.items() if c >= least}
            assert found.tolist() == sorted(found.tolist())
    # a run is encoded when it is first met, also beside many known ones; runs over two lines are not kept
    encoder, asked = grammar.Encoder(queries.tokenizer_path()), []
    tokenize = encoder._tokenize
    encoder._tokenize = lambda mapped: asked.append(mapped) or tokenize(mapped)
    text = "one zwqx zwqx, two\nzwqx 12-7 zwqx \u00fcber zwqx"
    first = encoder.encode(text).tolist()
    assert first == encoder._t.encode(text, add_special_tokens=False).ids
    assert len([x for x in asked if x.endswith("zwqx") and len(x) > 4]) == 1 and "two\nzwqx" not in encoder._runs
    del asked[:]
    assert encoder.encode(text).tolist() == first and not [x for x in asked if x.endswith("zwqx")]


def test_a_word_is_remembered_once():
    encoder = grammar.Encoder(queries.tokenizer_path())
    asked = []
    tokenize = encoder._model_ids
    encoder._model_ids = lambda mapped: asked.append(mapped) or tokenize(mapped)
    texts = [
        "lorem ipsum ipsum, (dolor) l'eau 12 a.b\nipsum. \u00e9t\u00e9, \u4e2d\u6587 end!", "ipsum? \u00e9t\u00e9", " lead", "trail ", "two  blanks",
        "line \nend", "line\n end", "a\n\nb c", "tab\tx y", "no\u00a0break x", "x\n", "\n", "\x85 x", "\u200b z", "ipsum,\nipsum, ipsum",
    ]
    for text in texts * 2:
        assert encoder.encode(text).tolist() == encoder._t.encode(text, add_special_tokens=False).ids, text
    assert len(asked) == len(set(asked))
    # with and without the marks after it, a word's ids are kept under one key
    assert not {x.strip() for x in encoder._words if x.startswith(" ")} & set(encoder._runs)


def test_documents_ends_hold_no_pair():
    import numpy as np

    lengths = np.array([0, 1, 2, 0, 3, 1] * 40)
    ids = np.full(lengths.sum(), 7)
    shard = grammar.Shard(grammar.pack(ids, lengths, 300))
    assert (shard.all_ids() == ids).all() and shard.lengths.tolist() == lengths.tolist()
    assert [len(shard.document(i)) for i in range(shard.docs)] == lengths.tolist()
    keys, across = grammar._pairs(ids.astype(np.uint16), np.cumsum(lengths[lengths > 0]))
    assert across == (lengths > 0).sum() - 1 == (keys == 0xFFFFFFFF).sum()


def test_token_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [
        "it's  two   blanks", " lead", "trail ", "a\n b", "a \nb\n\n c\td", "x\u00a0y z", "Élan déjà-vu, n'est-ce pas?!", "1234 56,7 8", "...! ?",
        "<|endoftext|> a <|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\n<|endoftext|", "日本 語 text", "🙂 🙂🙂 a", "don't we'll I'M", "a\x1cb \x1c c", "é e\u0301 ñ", None, "", sentence(1, 3000), "A B\u2003C \u2003 D",
    ]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(None, "null key"), (4, "same key"), (4, "same key")]
    found = grammar.encode_and_read(docs_of(spark, rows), path, shard_tokens=500).collect()
    assert len(found) == len(rows)
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None] + sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        texts_of = [t for d, t in rows if d == r["doc_id"]]
        options = []
        for t in texts_of:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
            options.append((len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        assert (r["n_tokens"], r["ids_crc32"]) in options
    assert grammar.encode_and_read(docs_of(spark, []), path).collect() == []


# ---- 10 -----------------------------------------------------------------------------------------


def test_hilbert_index_is_a_curve(spark):
    for dims, bits in ((2, 3), (3, 2)):
        df = spark.range((1 << bits) ** dims)
        steps = [F.floor(F.col("id") / (1 << (bits * i))) % (1 << bits) for i in range(dims)]
        rows = df.select(sharding.hilbert_index(steps, bits).alias("h"), *[s.cast("int").alias(f"x{i}") for i, s in enumerate(steps)]).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(rows)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(dims)) == 1


def test_shards(spark, tmp_path):
    rows = [(i % 180, sentence(i, i % 30), f"s{i % 3}") for i in range(200)] + [(None, None, None), (1000, "", "s1")]
    found = sharding.assign(docs_of(spark, rows), slice_rows=10).collect()
    per = collections.defaultdict(list)
    for r in found:
        per[r["shard"]].append(r)
    sizes = [len(x) for x in per.values()]
    assert len(found) == 202 and set(per) == set(range(24)) and max(sizes) - min(sizes) <= 1
    last = -1
    for s in range(24):
        part = sorted(per[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        assert last <= part[0]["curve_index"] and [r["curve_index"] for r in part] == sorted(r["curve_index"] for r in part)
        last = part[-1]["curve_index"]
    for r in found:
        texts = [t for d, t, _ in rows if d == r["doc_id"]]
        assert (r["size"], r["text_crc32"]) in [(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts]
    assert sharding.assign(docs_of(spark, [])).collect() == []
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs_of(spark, rows), path, "doc_id", ["source", "doc_id"], shards=6)
    back = spark.read.parquet(path)
    assert back.count() == 202
    # a shard spans a part of the plane, not a strip of it
    spans_ = back.groupBy("shard").agg(F.countDistinct("source").alias("s"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    assert sum(r["s"] / 3 * min(1, ((r["b"] or 0) - (r["a"] or 0)) / 180) for r in spans_) / len(spans_) < 0.6


def test_strings_count_whole_and_dates_are_numbers(spark):
    rows = spark.range(500).select(
        "id", F.format_string("https://site%02d.example.org/a/very/long/path", F.col("id") % 50).alias("host"),
        F.expr("date_add(date'2020-01-01', cast(id % 90 as int))").alias("day"), (F.col("id") % 2 == 0).alias("flag"),
        F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 100)").alias("at"),
    )
    one, total = sharding.order(rows, ["id"], ["host"])
    # sixteen steps of whole hosts, in their order
    steps = one.groupBy("__cell").agg(F.min("host").alias("a"), F.max("host").alias("b")).orderBy("__cell").collect()
    assert total == 500 and len(steps) == 16 and all(x["b"] < y["a"] for x, y in zip(steps, steps[1:]))
    for dims in (["host", "day"], ["day", "at", "flag"], ["host", "id", "day"]):
        found, _ = sharding.order(rows, ["id"], dims, slice_rows=7)
        ranks = [(r["__rank"], r["__cell"]) for r in found.orderBy("__rank").collect()]
        assert [r for r, _ in ranks] == list(range(500))
        assert [c for _, c in ranks] == sorted(c for _, c in ranks) and len({c for _, c in ranks}) > 8


def test_cells_equal_a_plain_count(spark):
    """Steps from sorted values, ranks from sorting all rows by cell: one dimension at a time."""
    r = random.Random(6)
    rows = [(i, r.choice([None, "", "a", "ab", "b" * 300, "common-prefix-1", "common-prefix-2", "z"])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, s string")
    found = {x["id"]: x["__cell"] for x in sharding.order(df, ["id"], ["s"])[0].collect()}
    values = sorted((s for _, s in rows), key=lambda s: (s is not None, s or ""))
    first = {}
    for at, s in enumerate(values):
        first.setdefault(s, at * 16 // len(values))
    cuts = {}
    for s, step in first.items():
        if s is not None and step > 0:
            cuts[step] = min(s, cuts.get(step, s))
    for i, s in rows:
        assert found[i] == (0 if s is None else sum(c <= s for c in cuts.values()))


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix_sources", "token_ids"]
    kept = docs.join(quality_rules.judge(docs).where("kept").select("doc_id"), "doc_id", "left_semi")
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = {c for _, c in brute_classes(rows)}
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    clean = {d: t for d, t in rows if d in single and not brute_contamination(t, bench)[4]}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    plan = mixing.plan(docs.where(F.col("doc_id").isin(list(clean)))).collect()
    assert {r["doc_id"] for r in plan} == set(clean) and {r["source"] for r in plan} <= set(source.values())
    want = collections.Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(r["doc_id"] for r in found) == want
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))

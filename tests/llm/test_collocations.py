import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelane.llm import collocations as c


def brute(rows, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[k : k + m])) for m in range(1, longest + 1) for k in range(len(words) - m + 1))
    known = {k: a for k, a in f.items() if a >= least}
    inside = lambda p, q: len(p) < len(q) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
    out = defaultdict(list)
    for (lang, p), a in known.items():
        if len(p) < 2 or any(la == lang and inside(p, q) and b >= a for (la, q), b in known.items()):
            continue
        score, k = min((1000 * a * n[lang] // (known[lang, p[:k]] * known[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, known[lang, p[:k]], known[lang, p[k:]], n[lang]))
    return sorted((lang, rank, p.decode(), a, left, right, total, -s) for lang, rows in out.items() for rank, (s, _, p, a, left, right, total) in enumerate(sorted(rows)[:top], 1))


def rows(n=150, seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "The", "a", "x", "Über", "naïve", "ß", "#1", "x-y"]
    out = [(None, "a a a a a a a"), ("en", None), ("en", ""), ("de", " \t\n"), ("en", "a.b,c;d:e!f?g\nh\x0bi\x0cj\rk"), ("und", "a a a\ta  a")]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n"]) for _ in range(rng.randint(1, 60)))
        out.append((rng.choice(["en", "en", "de", None]), text))
    return [*out, *[("en", "one two three four five six. one two three four five")] * 30]


@pytest.mark.parametrize(("part_bytes", "step"), [(c.PART_BYTES, c.STEP), (700, 64)])
def test_against_brute_force(spark, part_bytes, step):
    data = rows()
    docs = spark.createDataFrame([(i % 7, t, la, "x", 1) for i, (la, t) in enumerate(data)], "doc_id long, text string, lang string, phrase string, a int")
    got = c.collocations(docs, least=12, top=40, part_bytes=part_bytes, step=step)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(data, 12, 5, 40)


def test_ties_go_to_larger_counts_and_smaller_phrases(spark):
    data = [("en", f"{a} {b}.") for a, b in [("z", "é"), ("z2", "e"), ("ö", "y")] for _ in range(10)]
    docs = spark.createDataFrame([(t, la) for la, t in data], "text string, lang string")
    assert [r.phrase for r in c.collocations(docs, least=10).orderBy("rank").collect()] == ["z é", "z2 e", "ö y"]


def test_long_text_and_empty_table(spark):
    text = " ".join(["very long text indeed"] * 60_000)
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    got = c.collocations(docs).collect()
    assert sorted(map(tuple, got)) == brute([("en", text)], 100, 5, 2000)
    assert c.collocations(docs.limit(0)).count() == 0 == c.collocations(docs.limit(1).selectExpr("CAST(NULL AS STRING) AS text", "lang")).count()


def test_counts_and_products_beyond_64_bits(spark):
    keys = np.array([1, 5, 9], np.uint64) << np.uint64(40)
    sums = c.summing(100, 5)
    import pyarrow as pa

    big = np.array([1 << 40, 99, 60], np.uint64)
    table = pa.table({"bucket": pa.array([0, 0], pa.int32()), "part": pa.array([7, 2], pa.int32()), "payload": [c.message(keys, np.array([1, 1, 2]), big), c.message(keys[[0, 2]], np.array([1, 2]), np.array([1 << 41, 40], np.uint64))]})
    got = {(r["part"], r["length"]): c.read_message(r["payload"]) for r in sums(None, table).to_pylist()}
    assert {k: (v[0].tolist(), v[2].tolist()) for k, v in got.items()} == {(2, 1): ([keys[0]], [3 << 40]), (7, 1): ([keys[0]], [0]), (2, 2): ([keys[2]], [100]), (7, 2): ([keys[2]], [0])}
    # The score's expression, on counts whose products pass 64 bits.
    row = spark.sql("SELECT (1000BD * a * n) div (CAST(l AS DECIMAL(19, 0)) * r) AS s FROM VALUES (4000000000000L, 900000000000000L, 4000000000001L, 5000000000000L) AS t(a, n, l, r)").first()
    assert row.s == 1000 * 4000000000000 * 900000000000000 // (4000000000001 * 5000000000000)


def test_bitmaps_are_shifted_across_blocks():
    places = c.Places.__new__(c.Places)
    n = 100
    places.tokens = np.where(np.arange(n) % 3 == 0, np.uint64(11), np.uint64(22))
    places.place, places.lang, places.langs = np.arange(n), np.zeros(n, np.int64), ["en"]
    known = c.Known([c.message(np.sort(c.phrase_keys(np.array([[11], [22]], np.uint64))), np.ones(2), np.ones(2, np.uint64))])
    bitmaps = c.Bitmaps(places, known)
    (group,) = bitmaps.groups()
    pairs = group.extended()
    got = {tuple(bitmaps.tokens[w].tolist()): k for w, k in zip(pairs.words, pairs.counts().tolist())}
    plain = Counter(zip(places.tokens.tolist(), places.tokens[1:].tolist()))
    assert got == dict(plain)

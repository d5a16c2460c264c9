import random
import re

import pytest

from tidelane.llm.quality_rules import FEATURES, STATISTICS, Condition, learned, quality_rules, rule_text, statistics, verdict

SPACE = re.compile(r"[ \t-\r]+")


def plain(text):
    """The base statistics of a text, counted one by one."""
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dups, "n_repeat_words": len(covered)}


def texts(n=120, seed=5):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "a", "a a", "a a a", "a a a a", "a b c a b c", "x\x0by\x0cz\rw", "é ß ü ö 😀", "l\nl\n\nl \n \nl", "#*$%&|<> ### |", "a b c d a b c", "one two three one two\nthree"]
    for _ in range(n):
        words = [rng.choice(["the", "of", "a", "b", "Ça", "x#", "9", "ok."]) for _ in range(rng.randint(1, 90))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    return out


def test_statistics_against_brute_force(spark):
    rows = [(k, t, "mine", 3) for k, t in enumerate(texts())] + [(7, "a b", "x", 1), (None, "c d e", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window string, n_words int")
    got = statistics(docs).collect()
    assert sorted((r.doc_id or -1, *(r[c] for c in STATISTICS[:5])) for r in got) == sorted((i or -1, *(plain(t)[c] for c in STATISTICS[:5])) for i, t, _, _ in rows)


def test_long_text(spark):
    words = [str(k % 50_000) for k in range(120_000)]
    row = statistics(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert row.n_words == row.n_repeat_words == 120_000 and row.n_distinct_words == 50_000


def labelled(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "symbols", "shout"])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        if kind == "symbols":
            words = [w + rng.choice(["##", "*"]) for w in words]
        if kind == "shout":
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == "good")))
    return docs, labels


def test_held_out_rows_and_rules(spark):
    docs, labels = labelled()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (1, 5), (None, 0), (2, None), (10**6, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_rules(*frames).collect()}
    truth = dict(labels)
    assert len(rows) == len(docs)
    for i, text in docs:
        p = plain(text)
        assert rows[i].base_failed == (p["n_words"] < 50 or 100 * p["n_repeat_words"] > 50 * p["n_words"])
    judged = [r for r in rows.values() if not r.base_failed and r.held_out]
    assert len(judged) > 50 and sum(r.kept == bool(truth[r.doc_id]) for r in judged) > 0.97 * len(judged)
    assert {r.rule is None for r in rows.values() if r.kept} == {True}
    assert len({r.rule for r in rows.values()} - {None}) >= 2  # a rule a kind


def test_learned_list_is_ordered_and_pruned(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        s = dict.fromkeys(STATISTICS, 10) | {"n_words": 100, "word_chars": 500, "n_lines": 10}
        s["n_symbols"], s["n_digits"] = rng.randint(0, 100), rng.randint(0, 500)
        bad = s["n_symbols"] > 60 and s["n_digits"] > 250
        rows.append((*(s[c] for c in STATISTICS), int(bad != (rng.random() < 0.02)), i % 3 == 0))
    frame = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in STATISTICS) + ", bad int, pruning boolean")
    rules = learned(frame)
    assert rules and {c.feature for c in rules[0]} == {"symbols_per_word", "digit_share"} and all(c.above for c in rules[0])
    wrong = frame.filter((verdict(rules).isNotNull()).cast("int") != frame["bad"]).count()
    assert wrong < 80
    assert rule_text(rules[0]).count(" and ") == len(rules[0]) - 1


def test_given_rules_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 60), (2, " ".join(f"w{k}" for k in range(60))), (3, " ".join(f"w{k}#" for k in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    first, second = (Condition("symbols_per_word", True, 0.5),), (Condition("n_words", True, 50.0),)
    got = {r.doc_id: (r.kept, r.rule) for r in quality_rules(docs, none, rules=[first, second]).collect()}
    assert got == {1: (False, "n_words > 50"), 2: (False, "n_words > 50"), 3: (False, "symbols_per_word > 0.5")}
    assert {r.doc_id: r.kept for r in quality_rules(docs, none).collect()} == {1: False, 2: True, 3: True}
    assert quality_rules(docs.limit(0), none).count() == 0


def test_no_python_on_the_path(spark):
    docs, labels = labelled(30)
    plan = quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and set(FEATURES) >= {"symbols_per_word"}


@pytest.mark.parametrize("rule", [(Condition("n_words", False, 3.0), Condition("upper_share", True, 0.25))])
def test_rules_read_as_sentences(rule):
    assert rule_text(rule) == "n_words <= 3 and upper_share > 0.25"

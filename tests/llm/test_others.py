import itertools

import numpy as np
import pytest

from tidelane.llm.chat_format import ENDING, FOOTER, HEADER, NEXT, ROLES, START, STEPS, block_matrix, edges, format_conversations, least_cost, repair
from tidelane.llm.license_scan import GAIN, LOSS, TEMPLATES, TemplateIndex, aligned, needed, scan, winnowed
from tidelane.llm.top_k import Best, Blocks, products, top_k


def cheapest(roles):
    """The least cost of any legal sequence, from the costs as they are said: 2 for another role, 1 to merge with an equal
    role and 3 with another, 3 for an empty turn; every sequence that can be made is looked at."""
    made = {(): 0}
    for role in roles:
        after = {}
        for seq, cost in made.items():
            own = [((r,), 0 if r == role else 2) for r in ROLES]
            ways = [*own, *(((x, *r), c + 3) for x in ROLES for r, c in own), *([((), 1 if seq[-1] == role else 3)] if seq else [])]
            for more, c in ways:
                after[seq + more] = min(cost + c, after.get(seq + more, 99))
        made = after
    found = []
    for seq, cost in made.items():
        for n in range(3):
            for added in itertools.product(ROLES, repeat=n):
                whole = (seq + added)[(seq + added)[:1] == ("system",) :]
                if whole and whole == ("user", "assistant") * (len(whole) // 2):
                    found.append(cost + 3 * n)
    return min(found)


def cost_of(roles, size):
    blocks = [roles[k : k + size] for k in range(0, len(roles), size)]
    ways = edges([block_matrix(b) for b in blocks])
    total, made = 0, []
    for b, (entry, exit_) in zip(blocks, ways):
        at = entry
        for role, (_, turns) in zip(b, repair(b, entry, exit_)):
            after = at if not turns else ROLES.index(turns[-1]) + 1
            total += STEPS[role if role in ROLES else None][at, after][0]
            at = after
            made += turns
        assert at == exit_
    return total + ENDING[exit_][0], made + list(ENDING[exit_][1])


@pytest.mark.parametrize("size", [1, 2, 100])
def test_repairs_are_cheapest_and_legal(size):
    for n in range(1, 6):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            cost, made = cost_of(list(roles), size)
            assert cost == least_cost([block_matrix(list(roles[k : k + size])) for k in range(0, n, size)])
            if n < 4:
                assert cost == cheapest(roles)
            state = START
            for role in made:
                state = NEXT[state][role]
            assert state == 3


def test_rendered_conversations(spark):
    turns = [(1, 0, "user", "Hi"), (1, 1, "user", "there"), (1, 2, "assistant", None), (2, 0, "assistant", "first"), (3, 5, "tool", "x"), (3, 5, "tool", "x"), (None, 0, "user", "lost")]
    turns += [(4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(50)]
    rows = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, action string")
    for size in (800, 1 << 20):
        got = sorted(format_conversations(rows, block_bytes=size).collect(), key=lambda r: (r.conv_id, r.position, r.part))
        text = {c: "".join(r.rendered for r in got if r.conv_id == c) for c in (1, 2, 3, 4)}
        h = {r: HEADER.format(role=r) for r in ROLES}
        assert {(r.conv_id, r.cost) for r in got} == {(1, 1), (2, 3), (3, 4), (4, 0)}
        assert text[1] == h["user"] + "Hi\nthere" + FOOTER + h["assistant"] + FOOTER
        assert text[4] == "".join(h[("user", "assistant")[k % 2]] + f"t{k}" + FOOTER for k in range(50))
        assert text[2].startswith(h["user"]) and text[2].count("first") == 1 and text[3].count("x") == 2
        assert {r.conv_id for r in got} == {1, 2, 3, 4}
    assert format_conversations(rows.limit(0)).count() == 0


def test_license_spans(spark):
    mit = TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any charge").replace("publish, ", "")
    docs = [(0, "intro\n" + mit + "\nend"), (1, changed), (2, mit[:200]), (3, "Released under the MIT License. " * 3), (4, None), (5, ""), (6, "see the License for the terms"), (7, "word " * 50_000 + TEMPLATES["ISC"]), (None, TEMPLATES["CC-BY-NC-4.0-notice"])]
    rows = scan(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, coverage int")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {0, 1, 3, 7, None}
    (a,) = found[0]
    assert a.coverage == 1 and docs[0][1].encode()[a.start_byte : a.end_byte] == mit.rstrip(".").encode()
    assert found[1][0].license == "MIT" and 0.9 < found[1][0].coverage < 1
    assert [r.license for r in found[3]] == ["MIT-notice"] * 3 and found[7][0].start_byte == 250_000
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def whole_table(template, text):
    """The most points of an alignment of the whole template, by all cells, and every number of matched words that reaches it."""
    above = [{(0, 0)}] * (len(text) + 1)
    for w in template:
        row = [{(s - LOSS, m) for s, m in above[0]}]
        for j, x in enumerate(text):
            ways = {(s + GAIN, m + 1) if w == x else (s - LOSS, m) for s, m in above[j]} | {(s - LOSS, m) for s, m in above[j + 1] | row[j]}
            top = max(s for s, _ in ways)
            row.append({c for c in ways if c[0] == top})
        above = row
    top = max(s for cell in above for s, _ in cell)
    return {m for cell in above for s, m in cell if s == top}


def test_alignment_is_that_of_the_whole_table():
    rng = np.random.default_rng(6)
    for _ in range(60):
        template = rng.integers(0, 40, 30)
        text = [*rng.integers(0, 40, 15), *(w for w in template for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 1, 2]))), *rng.integers(0, 40, 15)]
        text = np.array([w if rng.random() > 0.1 else 99 for w in text])
        matched, first, last = aligned(template, text, np.array([15, 15]), np.array([0, 0]), np.array([len(text)] * 2), len(text))
        assert matched[0] == matched[1] and matched[0] in whole_table(template, text.tolist()) and 0 <= first[0] < last[0] <= len(text)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_license_recall_by_length_and_change(spark, share):
    """Every template with words changed anywhere is found as long as it meets the threshold, its ends included."""
    rng = np.random.default_rng(int(100 * share))
    templates = TEMPLATES | {f"t{n}": " ".join(f"w{n}x{k}" for k in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 10, 11, 25, 60)}
    docs, want = [], {}
    for name, text in templates.items():
        n = len(TemplateIndex({name: text}).words[0])
        for _ in range(30):
            words = "".join(c if c.isalnum() else " " for c in text).split()
            changed = rng.choice(n, min(n - needed(n), max(int(share * n), int(rng.integers(0, 2)))), replace=False)
            for k in changed:
                words[k] = "other"
            want[len(docs), name] = n - len(changed)
            docs.append((len(docs), " ".join(["before"] * int(rng.integers(0, 4)) + words + ["after"] * int(rng.integers(0, 4)))))
    got = {(r.doc_id, r.license): r.matched_words for r in scan(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert all(got.get(k, 0) >= m for k, m in want.items())


def test_licenses_with_added_and_missing_words_and_repeats(spark):
    gpl = TEMPLATES["GPL-3.0-or-later"]
    words = gpl.split()
    docs = [(1, " ".join(w for k, w in enumerate(words) if k % 8 != 5)), (2, " ".join(w + (" really" if k % 20 == 3 else "") for k, w in enumerate(words))), (3, f"{gpl} {gpl}\n{gpl}"), (3, f"{gpl} {gpl}\n{gpl}"), (4, " ".join(words[: len(words) // 2]))]
    got = sorted((r.doc_id, r.license, r.matched_words) for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    n = len(TemplateIndex({"a": gpl}).words[0])
    assert [g[0] for g in got if g[1] == "GPL-3.0-or-later"] == [1, 2, *[3] * 6] and all(m == n for d, _, m in got if d > 1) and scan(spark.createDataFrame(docs, "doc_id long, text string"), {"none": " ,. "}).count() == 0


def test_winnowing_keeps_one_in_every_window():
    h = np.random.default_rng(2).integers(0, 50, 200).astype(np.uint64)
    kept = winnowed(h, 4)
    assert all(any(k <= p < k + 4 for p in kept) for k in range(197)) and len(kept) < 120


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    x = (rng.integers(-3, 4, (300, 8)) / 4).tolist()
    rows = [(k, v, 1) for k, v in enumerate(x)] + [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (None, x[0], 1), (1000, [2.0], 1), (1100, [], 1), (7, x[7], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in top_k(table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(k, [*np.floor(1024 * np.array(v, dtype=float)), *[0] * (8 - len(v))]) for k, v, _ in rows if k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q in (0, 100, 200, 1000, 1100):
        mine = next(v for k, v in whole if k == q)
        want = sorted((-int(np.dot(mine, v)), k) for k, v in whole if k != q)[:10]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(want)]
    assert set(got) == {0, 100, 200, 1000, 1100}
    assert top_k(table.limit(0), table).count() == 0 and top_k(table, table.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact_and_overflow_is_an_error(spark):
    rng = np.random.default_rng(4)
    x = [[float(v) for v in rng.integers(-(1 << 20), 1 << 20, 6)] for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    whole = [[int(1024 * v) for v in row] for row in x]
    got = {}
    for r in top_k(table, table.filter("vec_id % 100 = 0"), 5, group_queries=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 100):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in enumerate(whole) if k != q)[:5]
        assert max(-s for s, _ in want) > 1 << 53
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(want)]
    big = np.full((1, 2), 1 << 31)
    assert products(np.array([[1 << 31, -(1 << 31) + 1]]), big[0]).tolist() == [1 << 31]
    with pytest.raises(OverflowError):
        products(big << 1, big[0])


def test_blocks_are_pruned_where_rows_are_alike():
    """Of rows in clusters a twentieth of the blocks or so is scored; the scores of all rows give the same."""
    rng = np.random.default_rng(3)
    x = np.floor(np.repeat(rng.normal(0, 1000, (40, 16)), 64, axis=0) + rng.normal(0, 5, (2560, 16))).astype(np.int64)
    ids, queries = np.arange(2560), np.arange(0, 2560, 100)
    blocks, best = Blocks(ids, x), Best(queries, 10)
    blocks.improve(best, 0, x[queries])
    share = blocks.scored / (len(queries) * len(blocks.at))
    print("blocks scored", share)
    assert share < 0.1
    for i, q in enumerate(queries.tolist()):
        want = sorted((-int(x[q] @ x[k]), k) for k in range(2560) if k != q)[:10]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == want


def test_components_out_of_range_are_an_error(spark):
    table = spark.createDataFrame([(0, [0.001, 0.0]), (1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large to be scaled exactly"):
        top_k(table, table.filter("vec_id = 0")).collect()

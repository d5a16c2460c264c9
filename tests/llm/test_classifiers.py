import random

import numpy as np
import pytest

from tidelane.llm.quality import FEATURES, AdditiveModel, features_of, quality
from tidelane.llm.toxicity import Lexicon, folded, toxicity, without_toxic

WORDS = [f"{a}{b}" for a in ("an", "er", "th", "ou", "in") for b in ("ti", "re", "sh", "nd", "ea", "wh")]


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "1di0t", "scum", "ѕcum", "SCUM"])
        text = " ".join(w)
        docs.append((i, text.upper() + "!!!" if low else text, "en", i % 2))
        if i % 3:
            labels.append((i, int(not low), int(toxic)))
    extra = [(n, None, None, 0), (n + 1, "", "x", 0), (n + 2, "idiot " * 50_000, "x", 0), (n + 3, "a clown fish idiot proof", "x", 0), (None, "scum scum", "x", 0), (n, None, None, 0)]
    return docs + extra, labels + [(1, 1, 0), (None, 1, 1), (2, None, None), (n + 99, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding():
    assert folded("1D10T  ѕсum! Réeux") == " idiot  scum  reeux "
    lexicon = Lexicon({" idiot": 3.0, " scum ": 2.0}, ("idiot proof",))
    assert lexicon.weigh("an 1diots scum, idiot-proof scummy") == (5.0, 2, 6)
    assert lexicon.weigh(None) == (0.0, 0, 0)


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.95
    by = {r.doc_id: r for r in rows}
    assert by[602].predicted == 1 and by[600].predicted == by[601].predicted == by[603].predicted == 0 and by[None].predicted == 1
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([p == t for p, t in held]) > 0.95


def test_without_labels_or_rows(tables):
    docs, labels = tables
    assert max(r.score for r in toxicity(docs, labels.limit(0)).collect()) < 1e-6
    assert all(r.predicted == 0 for r in quality(docs, labels.limit(0)).collect())
    assert toxicity(docs.limit(0), labels).count() == 0 and quality(docs.limit(0), labels).count() == 0


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel().fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.9
    assert len(features_of("A b\nb b|!")) == len(features_of(None)) == len(FEATURES)


def test_lexicon_against_a_plain_search():
    """Every place where an entry begins counts its heaviest entry, unless an exception phrase covers the place."""
    rng = random.Random(11)
    vocabulary = ["idiot", "idiots", "scum", "scu", "clown", "fish", "proof", "an", "sc", "idi"]
    weights = {" idiot": 2.5, " idiot ": 3.0, " scum ": 2.0, " clown ": 1.5, " scu": 0.5, " idio": 1.0}
    exceptions = ("idiot proof", "clown fish", "an idiot an")
    lexicon = Lexicon(weights, exceptions)
    for _ in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "-", "\n"]) for _ in range(rng.randint(0, 25)))
        text = "".join(rng.choice([c, c.upper(), {"i": "1", "o": "0", "s": "ѕ", "c": "с"}.get(c, c)]) for c in text)
        plain = folded(text)
        at = {k: max(w for e, w in weights.items() if plain.startswith(e, k)) for k in range(len(plain)) if any(plain.startswith(e, k) for e in weights)}
        phrases = [" " + " ".join(folded(p).split()) + " " for p in exceptions]
        covered = {s for p in phrases for k in range(len(plain)) if plain.startswith(p, k) for s in range(k, k + len(p) - 1)}
        kept = {k: w for k, w in at.items() if k not in covered}
        weight, n, words = lexicon.weigh(text)
        assert weight == pytest.approx(sum(kept.values())) and n == len(kept) and words == len(plain.split())


def test_tables_are_the_sums_of_their_trees():
    """The trees of each feature and pair as they were grown, added up one by one, and scored row by row."""
    grown, paired = [], []

    class Kept(AdditiveModel):
        def _tree(self, g, h, leaves=3):
            step = super()._tree(g, h, leaves)
            if leaves == 3:
                grown.append(step)
            return step

        def _pair_tree(self, g, h):
            found = super()._pair_tree(g, h)
            paired.append(found[1].copy())
            return found

    rng = np.random.default_rng(3)
    x = rng.random((400, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] > 0.3)).astype(float)
    model = Kept(rounds=15, pair_rounds=6, n_pairs=3).fit(x, y)
    assert len(grown) == 15 * 4 and len(paired) == 6 + 6 * len(model.pairs)  # six pairs are ranked first
    for k, table in enumerate(model.tables):
        assert np.allclose(table, model.rate * sum(grown[k::4]))
    for m, grid in enumerate(model.pairs.values()):
        assert np.allclose(grid, model.rate * sum(paired[6 + m :: len(model.pairs)]))
    for row, score in zip(x[:50], model.score(x[:50])):
        z = model.intercept + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(model.tables, model.edges, row))
        z += sum(grid[sum(e <= row[i] for e in model.pair_edges[i]), sum(e <= row[j] for e in model.pair_edges[j])] for (i, j), grid in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-z)))

"""Scores and shards against plain definitions."""

import random
from collections import Counter

import numpy as np
import pytest
from test_llm import VOCABULARY, words

from revpanel.llm import common, sharding, toxicity


def plain_score(model, text):
    """The factorization machine by its definition: every pair of slots present."""
    sums = Counter()
    for w, n in Counter(common.alnum_words(text.lower() if text else None)).items():
        for s in toxicity._slots(w):
            sums[s] += n
    present = {s * len(toxicity.LEVELS) + i for s, n in sums.items() for i, least in enumerate(toxicity.LEVELS) if n >= least}
    at = [k for k, s in enumerate(model.slots.tolist()) if s in present]
    z = model.bias + sum(model.weights[k] for k in at)
    z += sum(float(model.factors[a] @ model.factors[b]) for n, a in enumerate(at) for b in at[:n])
    return 1 / (1 + np.exp(-z))


def test_scores_are_sums_over_all_pairs():
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(300)]
    terms = toxicity._Terms()
    rows = [np.sort(terms(t)) for t in texts]
    labels = np.array([float(("w1 " in t + " ") or ("w2 " in t and "w3 " in t)) for t in texts])
    model = toxicity.FactorizationMachine.fit(rows, labels, least=0.5, epochs=60)
    assert len(model.slots) > 50 and np.abs(model.factors).max() > 0.05
    asked = [*texts[:80], None, "", "unknown words only", " ".join(VOCABULARY)]
    assert toxicity.Scorer(model)(asked) == pytest.approx([plain_score(model, t) for t in asked])


def test_shards_of_a_small_case_cut_few_edges(spark):
    """Groups of copies that fit into shards whole, so that the least cut is none: the shards cut few of their links."""
    rng = random.Random(2)
    rows, n = [], 0
    for size in [6, 5, 4, 4, 3, 3, 3, 2, 2, 2, 2, 2] * 3 + [1] * 86:
        text = words(rng, 20)
        for _ in range(size):
            rows.append((n, text))
            n += 1
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    text = dict(rows)
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(out) == len(rows)
    kept = Counter((text[r["doc_id"]], r["shard"]) for r in out)
    links = lambda k: k * (k - 1) // 2
    whole = sum(links(c) for c in Counter(text.values()).values())
    cut = sharding.edges_cut(spark.createDataFrame(out)).first()
    assert cut["edges"] == whole and cut["cut"] == whole - sum(links(c) for c in kept.values())
    assert whole - sum(links(c) for c in kept.values()) <= 0.25 * whole

"""The skip-chain field: learning, inference, odd texts."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import pii

SIZE = len(pii.KINDS) + 1


def exact_marginals(unary, fixed, near, skip, model):
    total = np.zeros_like(unary)
    for labels in itertools.product(range(SIZE), repeat=len(unary)):
        if any(f and f != y for f, y in zip(fixed, labels, strict=True)):
            continue
        score = sum(unary[i, y] for i, y in enumerate(labels) if not fixed[i])
        score += sum(model["near"][labels[i], labels[j]] for i, j in near) + sum(model["skip"][labels[i], labels[j]] for i, j in skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def random_model(rng, scale=1.0):
    skip = rng.normal(size=(SIZE, SIZE)) * scale
    return {"near": rng.normal(size=(SIZE, SIZE)) * scale, "skip": (skip + skip.T) / 2}


def test_propagation_is_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(1)
    for near, skip, tolerance in (([(0, 1), (1, 2), (2, 3)], [], 1e-3), ([(0, 1), (1, 2)], [(1, 3)], 1e-3), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.1)):
        for fixed in ([0, 0, 0, 0], [2, 0, 0, 0], [0, 1, 0, 3]):
            model, unary = random_model(rng, 0.7), rng.normal(size=(4, SIZE))
            got = pii.marginals(unary, fixed, near, skip, model)
            assert np.abs(got - exact_marginals(unary, fixed, near, skip, model)).max() < tolerance


def test_pseudo_likelihood_gradient_equals_differences():
    rng = np.random.default_rng(2)
    rows = [[0, 1], [1], [2, 0], [2]]
    y, near, skip = np.array([0, 1, 1, 3]), np.array([(0, 1), (1, 2), (2, 3)]), np.array([(0, 3), (1, 3)])
    model = {"weights": rng.normal(size=(3, SIZE))} | random_model(rng)
    _, steps = pii.pseudo_gradient(model, rows, y, near, skip)
    for name, step in zip(("weights", "near", "skip"), steps, strict=True):
        for at in itertools.product(*map(range, model[name].shape)):
            both = []
            for by in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in model.items()}
                moved[name][at] += by
                if name == "skip" and at[0] != at[1]:
                    moved[name][at[::-1]] += by
                both.append(pii.pseudo_gradient(moved, rows, y, near, skip)[0])
            want = (both[0] - both[1]) / 2e-5 / (2 if name == "skip" and at[0] != at[1] else 1)
            assert abs(step[at] - want) < 1e-6


def personal(rng):
    ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
    digits = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
    phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    return {"email": f"ann.{rng.randint(10, 99999)}@mail{rng.randint(0, 9)}.example.com", "ip": ip, "card": card, "phone": phone}


def corpus(rng, n, prose):
    texts = []
    for i in range(n):
        own = personal(rng)
        picked = rng.sample(sorted(own), rng.randint(0, 2))
        words = prose(7000 + i, 40).split()
        for kind in picked:
            words.insert(rng.randint(0, len(words)), own[kind])
        if rng.random() < 0.5:
            words.insert(rng.randint(0, len(words)), "".join(str(rng.randint(0, 9)) for _ in range(16)))
        texts.append(" ".join(words))
    return texts


def test_mentions_that_patterns_miss_are_added(spark, prose):
    rng = random.Random(4)
    model = pii.learn(corpus(rng, 400, prose))
    planted = found = false = alone = 0
    for i, text in enumerate(corpus(rng, 300, prose)):
        base = pii.base_spans(text)
        if not base:
            continue
        kind, s, e = base[i % len(base)]
        mention = pii.disguised(kind, text[s:e], i)
        whole = f"{text} and again {mention} there"
        added = [x for x in pii.find_spans(whole, model)[1] if x not in pii.base_spans(whole)]
        want = (kind, len(text) + 11, len(text) + 11 + len(mention))
        planted, found, false = planted + 1, found + (want in added), false + len([x for x in added if x != want])
        _, spans = pii.find_spans(f"nothing but {mention} here", model)
        alone += len(spans)
    assert planted > 100 and found >= 0.9 * planted and false <= 0.02 * planted and alone <= 0.02 * planted
    # The base stays as it is whatever the field adds.
    for text in corpus(rng, 50, prose):
        base, spans = pii.find_spans(text, model)
        assert base == pii.base_spans(text) and set(base) <= set(spans)


def test_odd_digits_do_not_fail(spark):
    texts = ["0" * 5000 + "1.1.1.1", "mail ².a.b.c@d now", "x ²²²²²²² +²²²²²²²²², 1.²3.4.5@x.y", "1." * 3000 + "1", "@" * 50, "(" * 3000 + "1234567", "10.0.0.7", "10.0.0.07 and 10-0-0-7"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("extra"))
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    assert [(s.kind, s.start, s.end) for s in got[0].base] == [("ip", 0, 5007)]
    assert [(s.kind, s.start, s.end) for s in got[6].base] == [("ip", 0, 8)]
    assert pii.candidates("10.0.0.7") == [(0, 8)]

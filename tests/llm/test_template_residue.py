"""The classifier finds residue on hosts it has not seen, spares texts that talk about it, and scores as defined."""

import random

import numpy as np
import pytest

from passagemill.llm import template_residue as R

SCHEMA = "doc_id long, text string, source string, score string"


def made(seed, n):
    """(id, text, host) and whether each holds residue."""
    rng = random.Random(seed)
    names = ["".join(rng.choices(["kra", "fel", "mon", "tis", "bou", "ven"], k=3)).title() for _ in range(60)]

    def plain():
        a, b = rng.sample(names, 2)
        return rng.choice([
            f"The {a} office reviewed the load of {b} Growth Fund on {rng.randint(1, 28)} May {rng.randint(2001, 2025)}.",
            f"Units of {a} Fund cost {rng.randint(10, 999)}.{rng.randint(10, 99)} each, and {b} keeps the records.",
            f"Holders who wrote to {a} got an answer from {b} within {rng.randint(2, 40)} days.",
        ])

    out, truth = [], set()
    for i in range(n):
        text = [plain() for _ in range(rng.randint(1, 6))]
        kind = rng.random()
        if kind < 0.12:
            words = text[0].split()
            words[rng.randrange(len(words))] = rng.choice(["{{ name }}", "${nav_date}", "[[plan]]", "%(plan)s", "<%= name %>", "[insert date]", "________", "@@PLAN_NAME@@"])
            text[0] = " ".join(words)
            truth.add(i)
        elif kind < 0.24:
            text = [rng.choice(["404 Not Found", "Access denied", "Please enable JavaScript to view this page", "Your heading here. Sample text goes here.", "Lorem ipsum dolor sit amet", "Seite nicht gefunden"])]
            truth.add(i)
        elif kind < 0.34:
            text.append(rng.choice([f"The help page explains that a field such as `{{{{name}}}}` stands for {names[0]} Fund in a letter.", f"The report of {names[1]} says that many readers of {names[2]} Fund keep scripts switched off.", "Notes [1] to [4] give the ratio (a/b) and the rule x < y."]))
        out.append((i, rng.choice([" ", "\n"]).join(text), f"host{rng.randrange(40)}", None))
    return out, truth


@pytest.fixture(scope="module")
def fitted(spark):
    rows, _ = made(1, 2500)
    return R.train(spark.createDataFrame(rows, SCHEMA))


def test_unseen_hosts(spark, fitted):
    assert fitted.held_out["precision"] > 0.9 and fitted.held_out["recall"] > 0.9
    rows, truth = made(2, 1500)
    rows = [(i, t, f"new {h}", s) for i, t, h, s in rows]
    got = {r.doc_id for r in R.residue(spark.createDataFrame(rows, SCHEMA), classifier=fitted).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    assert len(got & truth) >= 0.95 * len(got)


def test_scores_are_those_of_the_features(fitted):
    rows, _ = made(3, 200)
    texts = [t for _, t, *_ in rows] + ["", None, "\n\n", "...", "title\nIn line two. Third! last", "😀 {{x}}", "a" * 5000]
    got = R._Scorer(fitted).scores(texts)
    for t, s in zip(texts, got):
        want = max((fitted.weights[R._buckets(tokens, title)].sum() for tokens, _, _, title in R.sentences(t or "")), default=-np.inf)
        assert s == want or abs(s - want) < 1e-6


def test_empty_and_repeated(spark, fitted):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "", "h", None), (3, " \n", "h", None), (4, "404 Not Found", None, None), (4, "404 Not Found", None, None)], SCHEMA)
    assert [r.doc_id for r in R.residue(df, classifier=fitted).collect()] == [4]
    assert R.residue(df.limit(0)).count() == 0


def test_weak_labels():
    found = lambda t: [t[a:b] for a, b in R.labelled_places(t)]
    assert found("paid {{ date }} on") == ["{{ date }}"]
    assert found("a field such as `{{name}}` or '${NAME}'") == []
    assert found("the figure was undefined for one plan") == [] and found("begin at undefined.") == ["undefined"]
    assert found("text text text text text")
    assert not found("Too many requests reached the Kramon counter on 2 May 2019, so a second desk was opened for holders of Felmon Gold Fund.")


def test_optimiser_separates():
    rng = np.random.default_rng(0)
    label = rng.random(400) < 0.3
    rows = [np.r_[rng.integers(100, 200, 5), 7 if x else 8] for x in label]
    w = R.fit_logistic(np.concatenate(rows), np.full(400, 6), label)
    score = np.array([w[r].sum() for r in rows])
    assert ((score > 0) == label).all() and w[7] > 1 > -1 > w[8]

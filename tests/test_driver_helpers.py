"""Fetching, replies and reports, with stand-ins for everything outside."""

import pytest

from passagemill.operators import evaluate as E
from passagemill.plans import generate as M, reports
from passagemill.plans.fixtures import GRID
from passagemill.sources import pages

LISTED = {"https://a.example/x/"}


def test_fetch_tries_again_and_checks_redirects():
    answers, waits = [OSError("down"), ("https://a.example/x", "no", 503), ("https://a.example/x", "<p>", 200)], []

    def get(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert pages.fetch("https://a.example/x", LISTED, get, sleep=waits.append) == ("<p>", 200) and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        pages.fetch("https://a.example/x", LISTED, lambda u: (u, "", 500), sleep=waits.append)
    asked = []
    for url, final in (("https://b.example", ""), ("https://blog.medium.com/x", ""), ("https://a.example/x", "https://medium.com/x")):
        with pytest.raises(pages.NotAllowed):
            pages.fetch(url, LISTED, lambda u, final=final: asked.append(u) or (final, "", 200), sleep=waits.append)
    assert asked == ["https://a.example/x"]


def test_one_repair_only():
    seen = []

    def model(replies):
        return lambda history, temperature, most: seen.append(len(history)) or replies.pop(0)

    good = '{"answer": " yes ", "sources": ["u", "u", "w"], "refused": false}'
    r = M.generate(model([good]), M.messages("q", "b"), ["u"])
    assert (r.answer, r.sources, r.attempts, r.repaired) == ("yes", ["u"], 1, False)
    r = M.generate(model(["broken", good]), M.messages("q", "b"), ["u"])
    assert (r.attempts, r.repaired) == (2, True)
    r = M.generate(model(["broken", '{"answer": 3}', good]), M.messages("q", "b"))
    assert r.refused and r.attempts == 2 and seen == [2, 2, 4, 2, 4]


def test_waits_between_errors():
    left, waits = [M.ModelError("rate_limit"), M.ModelError("timeout")], []

    def ask():
        if left:
            raise left.pop()
        return M.Reply("ok")

    assert M.with_waits(ask, waits.append).answer == "ok" and waits == [8, 20]
    with pytest.raises(M.ModelError):
        M.with_waits(lambda: (_ for _ in ()).throw(M.ModelError("auth")), waits.append)


def test_reports(spark):
    g = spark.createDataFrame(GRID, "cell_no int, strategy string, size int, recall_at_5 double, n_chunks int, mean_chars double, max_tokens int, skipped boolean")
    text = reports.grid(g, E.grid_winner(g))
    assert "| 5 | 1 |" in text and text.rstrip().endswith("| 1 | recursive | 600 | 1.0 | 152 | 480.5 | 249 | False |")
    assert reports.markdown(g, 2).rstrip().endswith("(more than 2 rows)")
    assert reports.write_back("a:\n  size: 400  # chars\n  name: x\n", {"size": 600, "name": "y"}) == "a:\n  size: 600  # chars\n  name: y\n"
    with pytest.raises(KeyError):
        reports.write_back("size: 4\n", {"other": 1})

"""Rules by hand, segmentation by exhaustive search, and the verdict's score by hand."""
import itertools
import math

import pytest

from veiltab.llm.urls import RULES, judge, viterbi, word_counts

URLS = ["http://a.example.org/es/1", "http://example.org/en/12", "http://Example.ORG/en/2", "https://x.com/fr/", "https://x.com/de/a?b", "http://x.com", "http://x.net/es/1", None, "nothing",
        "http://notexample.org/es/1", "http://x.org?q=/es/", "a://b://c.com/fr/", "http://goodbooks.net/en/3", "http://spamcasino.com/en/9", "http://" + "ab" * 200 + ".net/x", "http://é.com/de/", "://", "http://x.org"]


def expected(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fits, key=lambda r: len(r[0] + r[1])) if fits else None


def pages(spark):
    html = "<p class='x'>good books Good</p> spam casino casino"
    train = [(100 + i, f"http://goodbooks.com/fr/{i}", html) for i in range(20)] + [(200 + i, f"http://spamcasino.com/de/{i}", None) for i in range(10)]
    return spark.createDataFrame([(i, u, html) for i, u in enumerate(URLS)] + [(3, URLS[3], html)] + train, "page_id long, url string, html string")


def test_judge(spark):
    got = judge(pages(spark)).collect()
    assert len(got) == len(URLS) + 31
    for r in got:
        if r.page_id < 100:
            host, path, rule = expected(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
            assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict[12] == "allow" and verdict[13] == "block"
    empty = judge(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0


def test_words(spark):
    got = {r.word: r.n for r in word_counts(pages(spark).where("page_id = 0")).collect()}
    assert got == {"good": 2, "books": 1, "spam": 1, "casino": 2}


@pytest.mark.parametrize("label", ["goodbooks", "goodbook", "spamcasino", "xspam", "a", "oodgood"])
def test_viterbi(label):
    counts = {"good": 5, "books": 3, "book": 1, "spam": 4, "casino": 2, "go": 1, "od": 1, "s": 2}
    total = sum(counts.values())
    found = [(i, w, n) for w, n in counts.items() for i in range(len(label)) if label.startswith(w, i)]

    def price(parts):
        unknown = -math.log(total) - 8
        out = 0.0
        for p in parts:
            if p in counts:
                out += math.log(counts[p] / total)
            elif len(p) == 1:
                out += unknown
            else:
                return -math.inf
        return out

    every = []
    for cuts in itertools.product([0, 1], repeat=len(label) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
        every.append([label[a:b] for a, b in zip(at, at[1:])])
    assert abs(price(viterbi(label, found, total)) - max(map(price, every))) < 1e-9

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from scanmill.llm import frames
from scanmill.llm.url_filter import Rule, filter_urls

RULES = [Rule("net/", False), Rule("example.net/en/", True), Rule("org/fr/", True), Rule("org/fr/x", False)]


def judged(spark, urls, rules=RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = filter_urls(pages.selectExpr("page_id", "url", "1 AS host", "2 AS score"), rules)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    return {r.page_id: r for r in found.collect()}


def test_parts_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/1?x=/q#f",
        "https://x.net/",
        "https://x.net",
        "http://examplenet/en/",
        "http://a.org/fr/xy#z",
        "http://a.org/fr/y",
        "//no.scheme/x",
        None,
        "ftp://host?q=1://b",
        "http://a.org/FR/",
        "http://a.org/fr/y",
        "",
    ]
    got = judged(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.example.net", "/en/1", "example.net/en/"),
        ("x.net", "/", "net/"),
        ("x.net", "", None),
        ("examplenet", "/en/", None),
        ("a.org", "/fr/xy", "org/fr/x"),
        ("a.org", "/fr/y", "org/fr/"),
        ("", "", None),
        ("", "", None),
        ("host", "", None),
        ("a.org", "/FR/", None),
        ("a.org", "/fr/y", "org/fr/"),
        ("", "", None),
    ]
    assert [got[i].verdict for i in (0, 1, 4, 5)] == ["allow", "block", "block", "allow"]
    assert got[5].score == got[10].score and got[7].score == got[11].score != got[6].score


def said(url):
    """The whole URL, up to the host's end in lower case."""
    url = url or ""
    found = re.match(r"(?s:.*?)://[^/?#]*", url)
    upto = found.end() if found else 0
    return re.sub("[A-Z]", lambda m: m.group().lower(), url[:upto]) + url[upto:]


def ratio(texts, order=4):
    """Witten-Bell by the definition, with counts in dictionaries."""
    counts = {c: defaultdict(Counter) for c in (True, False)}
    for text, accepted in texts:
        if accepted is None:
            continue
        marked = "\x02" * order + text + "\x03"
        for i in range(len(text) + 1):
            for k in range(order + 1):
                counts[accepted][marked[i + order - k : i + order]][marked[i + order]] += 1

    def p(c, context, char):
        shorter = p(c, context[1:], char) if context else 1 / 256
        seen = counts[c][context]
        total = sum(seen.values())
        return (seen[char] + len(seen) * shorter) / (total + len(seen)) if total else shorter

    def score(text):
        marked = "\x02" * order + text + "\x03"
        parts = [(marked[i : i + order], marked[i + order]) for i in range(len(text) + 1)]
        return sum(math.log(p(True, *x)) - math.log(p(False, *x)) for x in parts) / len(parts)

    return score


def half_of(text):
    return zlib.crc32(text.encode()) % 2


def plain(urls, rules):
    """(rule, verdict, score) of each URL, by the definition of each step."""
    decided = []
    for url in urls:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        decided.append(max(fits, key=lambda r: len(r.text)) if fits else None)
    training = [(said(u), r.allow) for u, r in zip(urls, decided) if r]
    crossed = [ratio([t for t in training if half_of(t[0]) != h]) for h in (0, 1)]
    bins = Counter()
    for text, allow in training:
        bins[math.floor(abs(b := max(-20, min(20, crossed[half_of(text)](text))) * 50) + 0.5) * (1 if b >= 0 else -1), allow] += 1
    good, bad = (sum(n for (_, a), n in bins.items() if a == kind) for kind in (True, False))
    cut, best, g, b = 0.0, -1.0, 0, 0
    places = sorted({k for k, _ in bins})
    for here, after in zip(places, places[1:] if good and bad else []):
        g, b = g + bins[here, True], b + bins[here, False]
        if (good - g) / good + b / bad > best:
            best, cut = (good - g) / good + b / bad, (here + after) / 2 / 50
    score = ratio(training)
    result = []
    for url, rule in zip(urls, decided):
        value = score(said(url))
        allow = rule.allow if rule else value >= cut
        result.append((rule and rule.text, "allow" if allow else "block", value))
    return result


def same(got, expected):
    for i, (rule, verdict, score) in enumerate(expected):
        assert (got[i].rule, got[i].verdict) == (rule, verdict)
        assert got[i].score == pytest.approx(score, abs=1e-9)


def test_operator_equals_plain_version_and_separates(spark):
    good = [f"http://a{i}.org/fr/page{i}" for i in range(20)]
    bad = [f"http://casino{i}.net/win{i}" for i in range(20)]
    unknown = ["http://casino77.com/win", "http://a77.com/fr/page", "http://x/", "http://naïve.com/é", "mailto:casino", "a/b", None, ""]
    # Hot URLs weigh as many pages as they have.
    urls = good + bad + unknown + good[:1] * 30 + bad[:2] * 20 + unknown[:1] * 25
    got = judged(spark, urls)
    same(got, plain(urls, RULES))
    assert got[40].verdict == "block" and got[41].verdict == "allow"
    assert got[44].score != got[46].score


def test_equal_scores_of_both_classes(spark):
    urls = [f"http://a{i % 3}.{'org/fr' if i % 2 else 'net'}/same" for i in range(24)] + ["http://b.com/same"]
    same(judged(spark, urls), plain(urls, RULES))


def test_no_rules_and_no_rows(spark):
    assert {r.verdict for r in judged(spark, ["http://a/", None], []).values()} == {"allow"}
    assert judged(spark, []) == {}


def test_query_and_fragment_count(spark):
    good = [f"http://a{i}.org/fr/p?page={i}#top" for i in range(20)]
    bad = [f"http://b{i}.net/p?redirect=casino{i}" for i in range(20)]
    unknown = ["http://c.com/p?redirect=casino5", "http://c.com/p?page=5#top", "http://c.com?a=\n/x", "HTTPS://c.com/P"]
    got = judged(spark, good + bad + unknown)
    same(got, plain(good + bad + unknown, RULES))
    assert got[40].verdict == "block" and got[41].verdict == "allow"
    assert (got[40].host, got[40].path) == (got[41].host, got[41].path)


def test_hot_urls_are_split_from_the_join(spark, monkeypatch):
    urls = ["http://a.org/fr/x"] * 40 + [None] * 30 + [f"http://c{i}.com/" for i in range(40)]
    whole = {i: (r.verdict, round(r.score, 9)) for i, r in judged(spark, urls).items()}
    monkeypatch.setattr(frames, "_SMALL_BYTES", 1)
    monkeypatch.setattr(frames, "_HOT_SHARE", 10)
    assert {i: (r.verdict, round(r.score, 9)) for i, r in judged(spark, urls).items()} == whole

"""URL filter: rules against plain Python, segmentation, and unwanted hosts."""

import math
import random
import re

from tessera.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, name in urls.RULES:
        own, rest = name.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((len(name), name, verdict))
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_rules(spark):
    r = random.Random(1)
    parts = ["http", "://", "://", "example.", "net", "org", "com", "Example.NET", "/", "/en/", "/de/", "/fr/", "?", "#", "x", ".", "É", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "http://x.net"), (9003, "http://net/"), (9003, "http://net/"), (None, "a://org/fr/")]
    got = urls.judged(spark.createDataFrame([(i, u, "w", 1) for i, u in rows], "page_id long, url string, words string, salt int")).collect()
    assert len(got) == len(rows)
    by = {(i, u) for i, u in rows}
    urls_of = {i: u for i, u in by}
    for x in got:
        host, path, rule, verdict = brute(urls_of[x.page_id])
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict in ((verdict,) if verdict else ("allow", "block")), x


def all_splits(name):
    if not name:
        yield []
    for k in range(1, len(name) + 1):
        for rest in all_splits(name[k:]):
            yield [name[:k], *rest]


def test_viterbi_is_the_most_likely_split():
    counts, total = {"free": 9, "fr": 2, "ee": 3, "bets": 5, "bet": 4, "s": 6, "ebets": 1}, 100.0
    cost = lambda w: math.log(total / counts[w]) if w in counts else (len(w) + 1) * math.log(total)
    for name in ("freebets", "beets", "xyz", "", "freefree"):
        best = min(sum(map(cost, s)) for s in all_splits(name))
        found = urls.viterbi(name, counts, total)
        assert "".join(found) == name and abs(sum(map(cost, found)) - best) < 1e-9


def test_unwanted_hosts(spark):
    r = random.Random(2)
    good = [f"https://{r.choice(['www', 'blog', 'm'])}.{r.choice(['citybooks', 'school-news', 'gardenhome'])}.example.org/es/{i}.html" for i in range(300)]
    bad = [f"https://www.{h}.example.org/es/{i}" for i, h in enumerate(["casinowin", "spam-farm", "adultx", "freebets", "cheap-pills"] * 6)]
    got = urls.judged(spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")).collect()
    assert all(x.verdict == "allow" for x in got if x.page_id < 300) and all(x.verdict == "block" for x in got if x.page_id >= 300)
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_bayes_finds_hosts_without_seeds(spark):
    """Words that keep seeds' company condemn hosts that spell no seed; clean hosts that share one such word stay."""
    r = random.Random(5)
    good = [f"https://www.{r.choice(['citybooks', 'schoolnews', 'wheelrepair'])}.example.org/es/{r.choice(['repair', 'lesson', 'review'])}-{i}.html" for i in range(300)]
    bad = [f"https://www.casino{r.choice(['luckyspin', 'goldwheel'])}.example.org/es/lucky-spin-gold-{i}" for i in range(100)]
    hidden = [f"https://www.{h}.example.org/es/spin-{i}" for i, h in enumerate(["luckyspin", "goldspin", "luckygold"])]
    assert not any(s in u for u in hidden for s in urls.SEEDS)
    got = {x.page_id: x.verdict for x in urls.judged(spark.createDataFrame(list(enumerate(good + bad + hidden)), "page_id long, url string")).collect()}
    assert all(got[i] == "allow" for i in range(300)) and all(got[i] == "block" for i in range(300, 403))


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "https://a.example.org/x", "h", "p", 3)] * 3 + [(None, "https://b.com/", None, None, None)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string, path string, score int")).collect()
    assert sorted((x.page_id or 0, x.host, x.path) for x in got) == [(0, "b.com", "/"), *[(1, "a.example.org", "/x")] * 3]

"""Secret scan against plain Python."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

from tessera.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return Counter(k for *_, k in found), ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def entropy(word, window):
    return max(-sum(c / window * math.log2(c / window) for c in Counter(word[i : i + window]).values()) for i in range(len(word) - window + 1))


def test_base_spans(spark, tmp_path):
    r = random.Random(2)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", '"', "'", " ", ":", "=", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ffffffff", "é", "🚀", "\n", ".", "x/y+z"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(4000)] + [(5000, "secret: token: abcdefgh"), (5001, None), (5002, ""), (5003, "token=" + "a" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for x in secrets.op7(spark, str(tmp_path)).collect():
        counts, joined = brute(dict(rows)[x.doc_id] or "")
        assert (x.n_assign, x.n_access, x.n_hex, x.base_sha256) == (counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined.encode()).hexdigest()), x
        assert set(joined.split(",")) - {""} <= set(x.spans.split(","))


def test_entropy(spark):
    r = random.Random(4)
    words = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (5, 19, 20, 21, 60)] + ["aaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for x in df.select("w", secrets.top_entropy(df.w, 20).alias("h")).collect():
        assert (x.h is None) if len(x.w) < 20 else abs(x.h - entropy(x.w, 20)) < 1e-9


def test_entropy_spans_and_allow_list(spark):
    key = "q7Rz0LmX4vBt9KcW2yHn8PfD3sGj"
    rows = [(1, f"see {key} here"), (2, "Donaudampfschifffahrtsgesellschaftskapitaen"), (3, "12345678901234567890123"), (4, "123e4567-e89b-12d3-a456-426614174000"), (5, f"example{key}"), (6, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, hex string")).collect()}
    assert [(s.start, s.end) for s in got[1].entropy_base64] == [(4, 4 + len(key))]
    assert not any(got[i].entropy_base64 or got[i].entropy_hex for i in (2, 3, 4, 5))
    assert len(got[6].entropy_hex) == 1 and not got[6].entropy_base64
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hex_next_to_names(spark):
    r = random.Random(6)
    marks = ["HMAC=", "HMAC_KEY=", "key/", "hmac-", "k_", "a+", " "]
    rows = []
    for i in range(84):
        word = "".join(r.choice("0123456789ABCDEF") for _ in range((20, 23, 32, 64)[i % 4]))
        rows.append((i, f"see {marks[i % 7]}{word}{('', ' ', '/x', '=', '-z', '_')[i % 6]}", word))
    want = {i: (t.index(w, 4 + len(marks[i % 7])), len(w)) for i, t, w in rows if entropy(w, 20) >= 2.9 and not w.isdigit() and not w.isalpha()}
    got = {x.doc_id: [(s.start, s.end - s.start) for s in x.entropy_hex] for x in secrets.scan(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).select("doc_id", "entropy_hex").collect()}
    assert len(want) > 60 and {i: v for i, v in got.items() if v} == {i: [v] for i, v in want.items()}
    glued = spark.createDataFrame([(1, "x9F86D081884C7D659A2FEAA0z"), (2, "G9F86D081884C7D659A2FEAA0")], "doc_id long, text string")
    assert not any(x.entropy_hex for x in secrets.scan(glued).select("entropy_hex").collect())


def test_long_runs_and_many_matches(spark):
    """The work is linear in the length of a run and, but for blocks, in the number of matches."""
    r = random.Random(9)
    run = "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(100_000))
    flat = "ab12" * 25_000
    many = " ".join(f"token={i:06d}x AKIA{'Z' * 14}{i % 90 + 10}" for i in range(10_000))
    rows = [(1, f"data:{run} end"), (2, many), (3, f"x {flat} y"), (4, None), (4, ""), (None, "a " * 50_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, runs int")
    began = time.monotonic()
    got = {(x.doc_id, i): x for i, x in enumerate(secrets.scan(df).collect())}
    assert time.monotonic() - began < 60
    by = {k[0]: x for k, x in got.items() if k[0] in (1, 2, 3)}
    assert [(s.start, s.end) for s in by[1].entropy_base64] == [(5, 5 + len(run))]
    assert [(s.start, s.end) for s in by[2].assign] == [m.span() for m in ASSIGN.finditer(many)] and len(by[2].assign) == 10_000
    assert [(s.start, s.end) for s in by[2].access] == [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", many)]
    assert not by[3].entropy_base64 and len(got) == 6


#: Words that the operator holds no list of.
PROSE = "machine learning basics guide harbour travel winter recipes quantum gardening notes budget kitchen football museum history energy climate server update release photo gallery library music festival education policy market review summer training analysis health design paper award student village river bridge castle".split()


def clean_runs(r):
    """What ordinary URLs, paths and code have."""
    words = lambda n: [r.choice(PROSE) for _ in range(n)]
    slug = lambda: "-".join(words(r.randint(3, 7)))
    camel = lambda: "".join(w.capitalize() for w in words(3))
    kinds = [
        lambda: f"https://example.org/articles/{r.randint(1990, 2025)}/{slug()}-{r.randint(1, 99)}", lambda: f"https://site.test/{'/'.join(words(4))}/{r.randint(1, 12):02d}/{slug()}_{r.randint(1000, 99999)}", lambda: f"/usr/share/{camel()}/{'_'.join(words(3))}{r.randint(1, 30)}/lib64", lambda: f"{words(1)[0]}{camel()}Factory{r.randint(1, 9)}Builder",
        lambda: f"https://cdn.test/{slug()}/3rd-edition-{r.randint(2, 9)}nd-print-v{r.randint(1, 20)}", lambda: f"https://shop.test/orders/{r.getrandbits(32):08x}-{r.getrandbits(16):04x}-4{r.getrandbits(12):03x}-a{r.getrandbits(12):03x}-{r.getrandbits(48):012x}/{slug()}", lambda: f"https://video.test/watch/{slug()}/{''.join(r.choice(string.ascii_letters + string.digits) for _ in range(11))}", lambda: f"backup_{'_'.join(words(2))}_20240{r.randint(1, 9)}15T0930{r.randint(10, 59)}Z", lambda: "_".join(words(4)).upper() + f"_{r.randint(1, 999)}",
    ]
    return r.choice(kinds)()


def test_precision_and_recall(spark):
    """At most 2 % of ordinary texts are flagged, at least 95 % of planted keys found."""
    r = random.Random(12)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
    clean = [f"See {clean_runs(r)} and {clean_runs(r)}." for _ in range(1500)]
    keys = ["".join(r.choice(r.choice(alphabets[:1]) if i in (0, n - 1) else r.choice(a)) for i in range(n)) for a, n in ((r.choice(alphabets), r.choice([24, 28, 32, 40, 44, 64])) for _ in range(600))]
    planted = [f"{r.choice(PROSE)} {k} {clean_runs(r)}" for k in keys]
    docs = spark.createDataFrame(list(enumerate(clean + planted)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.entropy_base64 + x.entropy_hex] for x in secrets.scan(docs).select("doc_id", "entropy_base64", "entropy_hex").collect()}
    flagged = sum(bool(got[i]) for i in range(len(clean)))
    found = sum((t.index(k), t.index(k) + len(k)) in got[len(clean) + i] for i, (t, k) in enumerate(zip(planted, keys)))
    assert flagged <= 0.02 * len(clean) and found >= 0.95 * len(keys), (flagged, found)

"""Rules and model scores against a plain version."""

import math
import re
from collections import Counter, defaultdict

from marginalia.llm import op05_urls as op

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def plain_rule(host, path):
    best = None
    for r, say in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = r, say
    return best or (None, None)


def plain_scores(rows):
    """rows: (folded text, verdict or None)."""
    grams = lambda t: ["^^^"[: 3] and ("^^^" + t + "$")[i : i + 4] for i in range(len(t) + 1)] if t else []
    model = {}
    for say in ("allow", "block"):
        follow = defaultdict(Counter)
        for t, v in rows:
            if v == say:
                for g in grams(t):
                    for k in range(4):
                        follow[g[3 - k : 3]][g[3]] += 1
        model[say] = follow

    def chance(follow, g):
        p = 1 / 41
        for k in range(4):
            own = follow.get(g[3 - k : 3])
            if own:
                p = (own[g[3]] + len(own) * p) / (sum(own.values()) + len(own))
        return p

    return [sum(math.log(chance(model["allow"], g) / chance(model["block"], g)) for g in grams(t)) / len(grams(t)) if t else 0.0 for t, _ in rows]


def test_equals_plain(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    urls += [None, "", "x.com/en/1", "http://COM/en/7", "HTTP://a.Example.COM/en/7#x", "http://example.net/de/8?q", "ftp://É.net/de/", "http://", "://net/de/x", "http://notcom/en/", "http://a?b://c", "http://org/es/\n9"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in op.judged(pages).collect()}
    assert len(got) == len(urls)
    split = [plain_parts(u) for u in urls]
    said = [plain_rule(*x) for x in split]
    fold = lambda h, p: re.sub(r"[^a-z0./_%&=+:@-]", "~", re.sub("[1-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h + p)))
    rows = [(fold(*x), v) for x, (_, v) in zip(split, said, strict=True)]
    want = plain_scores(rows)
    by = {say: [s for s, (_, v) in zip(want, rows, strict=True) if v == say] for say in ("allow", "block")}
    mean = {k: sum(v) / len(v) for k, v in by.items()}
    wide = {k: math.sqrt(sum((x - mean[k]) ** 2 for x in v) / len(v)) + 1e-9 for k, v in by.items()}
    cut = (mean["allow"] * wide["block"] + mean["block"] * wide["allow"]) / (wide["allow"] + wide["block"])
    for i, (x, (rule, say), s) in enumerate(zip(split, said, want, strict=True)):
        r = got[i]
        assert (r.host, r.path, r.rule) == (*x, rule), urls[i]
        assert abs(r.score - s) < 1e-9
        assert r.verdict == (say or ("allow" if s >= cut else "block"))


def test_no_training_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x"), (None, None), (1, "http://a.de/x")], "page_id long, url string")
    assert [r.verdict for r in op.judged(pages).collect()] == ["allow"] * 3
    assert op.judged(pages.limit(0)).count() == 0

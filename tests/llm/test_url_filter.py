"""Hosts, paths and rules against plain string work; the models against a scalar version."""

import random
from collections import Counter

import numpy as np

from tideline.llm import url_filter as uf
from tideline.llm.queries import RULES


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    cut = min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:cut]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def urls():
    rng = random.Random(2)
    pieces = ["http", "://", "HTTPS://", "a.", "Example.org", "example.com", "com", ".org", "org", "/", "/es/", "/en/1", "/fr/", "/de/", "?x=/", "#", ":80", "@", "É", "\n", " "]
    return [None, "", "://", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(600))]


def test_parts_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls())] + [(5, "http://a.org/", "x")] * 2, "page_id long, url string, host string")
    rows = uf.filter_urls(pages, RULES).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r["host"], r["path"]) == parts(r["url"])
        rule = rule_of(r["host"], r["path"])
        assert r["rule"] == (rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_calibration_scores_come_from_the_other_fold(spark):
    """Against counts in dictionaries of whole contexts."""
    rng = random.Random(6)
    pages = [(k, f"http://x{rng.randint(0, 9)}.{rng.choice(['org', 'com/de'])}/{rng.choice(['a', 'bb', 'c/d'])}{rng.randint(0, 9)}") for k in range(80)]
    df = uf.with_folds(uf.with_rules(spark.createDataFrame(pages, "page_id long, url string"), RULES)).drop("host", "path", "rule")
    rows = df.collect()
    scored = {r["page_id"]: r["cross_score"] for r in uf.score(df.drop("fold"), uf.train(df.drop("fold"))).collect()}

    def grams(url):
        data = b"\0" * (uf.ORDERS - 1) + url.encode()
        for i in range(uf.ORDERS - 1, len(data)):
            yield [(data[i - o : i], data[i]) for o in range(uf.ORDERS)]

    def likelihood(url, texts):
        pair, context, total = Counter(), Counter(), 0.0
        for t in texts:
            for orders in grams(t):
                pair.update(enumerate(orders))
                context.update((o, c) for o, (c, _) in enumerate(orders))
        for orders in grams(url):
            p = 1 / 256
            for o, g in enumerate(orders):
                p = (pair[o, g] + uf.WEIGHT * p) / (context[o, g[0]] + uf.WEIGHT)
            total += np.log(p)
        return total / len(url)

    for r in rows:
        allow, block = ([x["url"] for x in rows if x["ruled"] == c and x["fold"] != r["fold"]] for c in ("allow", "block"))
        assert abs(scored[r["page_id"]] - likelihood(r["url"], allow) + likelihood(r["url"], block)) < 1e-9


def test_held_out_urls_are_told_apart(spark):
    rng = random.Random(1)
    good = [f"https://{rng.choice(['news', 'blog'])}.site{k}.org/{rng.choice(['story', 'post'])}/{k}" for k in range(200)]
    bad = [f"http://win{k}.example.org/en/1{rng.choice(['casino', 'bonus'])}?id={k}" for k in range(200)]
    unruled = [("g", f"https://news.site{k}.test/story/{k}") for k in range(50)] + [("b", f"http://win{k}.example.test/en/1casino?id={k}") for k in range(50)]
    pages = spark.createDataFrame([("r", u) for u in good + bad] + unruled, "page_id string, url string")
    verdicts = Counter((r["page_id"], r["verdict"]) for r in uf.filter_urls(pages, RULES).where("page_id <> 'r'").collect())
    assert verdicts["g", "allow"] >= 48 and verdicts["b", "block"] >= 48


def test_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in uf.filter_urls(pages, []).collect()} == {"allow"}
    assert uf.filter_urls(pages.where("false"), RULES).count() == 0


def test_scores_are_exact_with_many_grams(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-_%é") for _ in range(n))
    ends = [("allow", "org"), ("block", "com/de"), (None, "net")]
    pages = [(k, f"http://{text(9)}.{ends[k % 3][1]}/{text(60)}", ends[k % 3][0]) for k in range(6000)] + [(-1, None, None), (-2, "", None)]
    pair, context = {}, {}
    for c in ("allow", "block"):
        pair[c], context[c] = Counter(), Counter()
        for _, u, ruled in pages:
            if ruled == c:
                data = b"\0" * (uf.ORDERS - 1) + u.encode()
                for i in range(uf.ORDERS - 1, len(data)):
                    for o in range(uf.ORDERS):
                        pair[c][data[i - o : i + 1]] += 1
                        context[c][o, data[i - o : i]] += 1
    assert len(pair["allow"]) > 100_000

    def want(url):
        data, total = b"\0" * (uf.ORDERS - 1) + (url or "").encode(), 0.0
        for i in range(uf.ORDERS - 1, len(data)):
            p = {"allow": 1 / 256, "block": 1 / 256}
            for o in range(uf.ORDERS):
                p = {c: (pair[c][data[i - o : i + 1]] + uf.WEIGHT * p[c]) / (context[c][o, data[i - o : i]] + uf.WEIGHT) for c in p}
            total += np.log(p["allow"]) - np.log(p["block"])
        return total / max(len((url or "").encode()), 1)

    df = spark.createDataFrame([(k, u) for k, u, _ in pages], "page_id long, url string")
    for hot in (uf.HOT, 50):  # with few grams broadcast, the others are joined
        monkeypatch.setattr(uf, "HOT", hot)
        got = {r["page_id"]: r["lm_score"] for r in uf.filter_urls(df, RULES).collect()}
        assert len(got) == len(pages) and np.allclose([got[k] for k, _, _ in pages], [want(u) for _, u, _ in pages], atol=1e-9)

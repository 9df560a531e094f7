"""The URL filter's counts, scores and verdicts against a plain version; very long hosts."""

import math
import re
from collections import Counter

from docloom.llm import queries, urlfilter
from tests.oracle import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(pages):
    """(host, path, rule, verdict, score) of each (url, html)."""
    words = Counter(w for _, html in pages for w in re.findall("[a-z]+", (html or "").translate(LOWER)) if len(w) <= urlfilter.WORD)
    total = sum(words.values())
    rows = []
    for url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest).group()
        host, path = raw.translate(LOWER), re.match(r"[^?#]*", rest[len(raw) :]).group()
        fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        tokens = [f"h:{w}" for label in re.split("[^a-z]+", host) if label for w in urlfilter.viterbi(label, words, total)]
        tokens += [f"p:{t}" for t in re.split("[^0-9a-z\x80-\U0010ffff]+", re.sub("[0-9]+", "0", path.lower())) if t]
        rows.append((host, path, rule, tokens))
    seen = {v: Counter(t for *_, rule, tokens in rows if rule and rule[2] == v for t in tokens) for v in ("block", "allow")}
    n = {v: sum(1 for *_, rule, _ in rows if rule and rule[2] == v) for v in seen}
    kinds = len({t for *_, tokens in rows for t in tokens})
    out = []
    for host, path, rule, tokens in rows:
        score = 0.0
        if n["block"] and n["allow"]:
            score = math.log(n["block"] / n["allow"])
            for t in tokens:
                score += math.log((seen["block"][t] + urlfilter.ALPHA) / (sum(seen["block"].values()) + urlfilter.ALPHA * kinds))
                score -= math.log((seen["allow"][t] + urlfilter.ALPHA) / (sum(seen["allow"].values()) + urlfilter.ALPHA * kinds))
        out.append((host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if score > 0 else "allow", None if rule else score))
    return out


def same(got, want):
    assert len(got) == len(want)
    for r, (host, path, rule, verdict, score) in zip(got, want, strict=True):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert (r["score"] is None) == (score is None)
        if score is None or abs(score) > 1e-6:
            assert r["verdict"] == verdict
        if score is not None:
            assert abs(r["score"] - score) < 1e-6


def test_query_against_plain_version(spark):
    pages = sorted((r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    got = {r["page_id"]: r for r in urlfilter.filter_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    same([got[p] for p, _, _ in pages], plain([(u, h) for _, u, h in pages]))
    digest = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.QUERIES["op6_url_filter"](spark, SF).collect()}
    assert digest == {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}


def test_trained_scores_and_long_hosts(spark):
    long = "wordpress" * 4000
    urls = ["http://spam.net/casino/1", "http://spamcasino.net/a", "http://news.org/fr/nouvelle", "http://goodnews.org/fr/2", "http://spamnews.com/casino", f"http://{long}.com/x", None, "nothing"]
    pages = [(u, "spam casino casino news good word press wordpress") for u in urls]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id int, url string, html string")
    got = sorted(urlfilter.filter_urls(df).collect(), key=lambda r: r["page_id"])
    same(got, plain(pages))
    assert got[4]["score"] != got[6]["score"]

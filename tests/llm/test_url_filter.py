"""URL filters against a plain version of the whole, exhaustive splits and planted hosts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from prefgraph.llm import queries, url_filter

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    best = None
    for r in RULES:
        name, _, start = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(r) > len(best)):
            best = r
    return best


def runs(text, most=None):
    out = [m for m in re.findall(r"[^\W\d_]+", text.lower())]
    return [m[a : a + most] for m in out for a in range(0, len(m), most)] if most else out


def score_of_split(words, counts, total):
    s = 0.0
    for w in words:
        known = counts.get(w, 0) if len(w) <= url_filter.LONGEST else 0
        s += math.log(known / total) if known else math.log(10 / total) - len(w) * math.log(10)
    return s


def test_split_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(300):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 500) for _ in range(12)}
        total = sum(counts.values()) * 50
        splits = []
        for mask in range(2 ** (len(name) - 1)):
            cuts = [0, *(k + 1 for k in range(len(name) - 1) if mask >> k & 1), len(name)]
            splits.append([name[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        got = url_filter.best_split(name, counts, math.log(total))
        assert "".join(got) == name
        assert score_of_split(got, counts, total) == pytest.approx(max(score_of_split(s, counts, total) for s in splits))
    assert url_filter.best_split("cheappillsonline", {"cheap": 5, "pills": 5, "online": 5, "pill": 9}, math.log(1000)) == ["cheap", "pills", "online"]
    assert url_filter.best_split("", {}, 1.0) == [] and url_filter.best_split("q" * 64, {}, 9.0) == ["q" * 64]


def plain(pages):
    counts = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", html or "")
        counts.update(w for w in runs(text) if len(w) <= url_filter.LONGEST)
    for w in url_filter.SEEDS:
        counts[w] += url_filter.SEED_COUNT
    total = sum(counts.values())
    parsed = [(i, *parse(u)) for i, u, _ in pages]
    keys = {tuple(runs(h, url_filter.NAME) + runs(p, url_filter.NAME)) for _, h, p in parsed}
    split = {n: url_filter.best_split(n, counts, math.log(total)) for k in keys for n in k}
    words = {k: [w for n in k for w in split[n]] for k in keys}
    bad = {k: any(w in url_filter.SEEDS for w in words[k]) for k in keys if k}
    seen = defaultdict(lambda: [0, 0])
    for k in bad:
        for w in words[k]:
            seen[w][0 if bad[k] else 1] += 1
    b, g = (sum(v[x] for v in seen.values()) for x in (0, 1))
    mass = min(b, g)
    prior = math.log(sum(bad.values()) / (len(bad) - sum(bad.values()))) if 0 < sum(bad.values()) < len(bad) else 0.0

    def odds(w):
        p = mass * sum(seen[w]) / (b + g)
        return math.log((seen[w][0] + p) / (b + mass)) - math.log((seen[w][1] + p) / (g + mass)) if mass else 0.0

    out = []
    for i, h, p in parsed:
        k = tuple(runs(h, url_filter.NAME) + runs(p, url_filter.NAME))
        score, r = sum(map(odds, words[k])) + prior if k else 0.0, rule(h, p)
        out.append((str(i), h, p, str(r), RULES[r] if r else "block" if score > 0 else "allow", round(score, 6)))
    return sorted(out)


def collected(df):
    return sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"], round(r["score"], 6)) for r in df.collect())


def test_op11_equals_plain_version(spark, sf):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert collected(queries.op11_url_filter(spark, sf)) == plain(pages)


@pytest.fixture(scope="module")
def crawl():
    html = "<p>Cheap pills and free bets; the river garden music house and the school for green stone bridge</p><script>var cheappills</script>" * 5
    nice = ["river", "garden", "music", "house", "school", "green", "stone", "bridge"]
    rng = random.Random(3)
    rows = [(k, f"https://{rng.choice(['www.', ''])}{''.join(rng.sample(nice, 2))}.{rng.choice(['com', 'org'])}/{rng.choice(['news', 'about', 'en'])}/{k}.html", html) for k in range(300)]
    rows += [(1000 + k, f"http://{h}.com/buy/{k}", html) for k, h in enumerate(["cheappills", "cheap-pills", "freebets", "CasinoBonus", "thecasinohouse", "shop.cheappillshouse"])]
    rows += [(2000 + k, u, None) for k, u in enumerate([None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "http://net/x", "http://xnet/", "ftp://Example.NET/en/1?q=://x/y#z", "http://example.net/de/", "http://b.example.com/de/x", "http://B.ORG/fr/", "http://b.org?x/fr/", "x://y://z/p", "http://" + "q" * 300 + ".com/" + "z" * 5000, "http://riverhouse.com/#/casino", "http://ü.org/fr/ä"])]
    return rows + [(None, "http://cheappills.com/x", ""), (1000, rows[300][1], html)]


def test_odd_urls_and_planted_hosts(spark, crawl):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in crawl], "page_id long, url string, html string, host string, score double").repartition(5)
    got = collected(url_filter.judge(df))
    assert got == plain(crawl)
    verdicts = {r[0]: r[4] for r in got}
    assert all(verdicts[str(k)] == "allow" for k in range(300)) and all(verdicts[str(1000 + k)] == "block" for k in range(6)) and verdicts["None"] == "block"
    by_id = {r[0]: (r[1], r[2], r[3]) for r in got}
    assert by_id["2008"] == ("example.net", "/en/1", "example.net/en/") and by_id["2004"] == ("a.net", "", "None") and by_id["2005"][2] == "net/" and by_id["2007"][2] == "None"
    assert by_id["2013"] == ("y:", "//z/p", "None") and by_id["2012"] == ("b.org", "", "None") and by_id["2000"] == ("", "", "None")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, seeds=("nosuchword",), rules=()).collect()} == {"allow"}

"""URL filters: rules by host and path, and for other URLs the words in host and path, scored by multinomial naive Bayes.

Words. Runs of letters of host and path (of both together the distinct ones) are names, often of several words written together. Each name is split
by the unigram model's best path (Viterbi): a word of the pages' visible text costs its negative log frequency, a stretch of k letters in no
known word costs as if it were seen 10 / 10**k times. Frequencies are counts over the whole text of all pages, plus ``SEED_COUNT`` for each
seed word. The counts are never gathered in one place: the substrings of all distinct names (up to ``LONGEST`` letters) are joined to
them, and each name's path is found from its own substrings. Names of more than ``NAME`` letters are cut into stretches of that many.

Scores. Distinct (host, path words) are the training rows, so that a host with a third of all pages counts no more than its paths differ. Rows whose
words include a seed are examples of unwanted URLs, the others of wanted ones. A word's log-odds compare its share in both, with pseudo-counts
in proportion to its overall share: words that wanted rows alone have never speak for blocking. A URL is blocked if the sum over all its words and the log of the
classes' sizes is above 0. Rules come first: the longest one that fits decides.

Edge cases: null URLs, and those without ``://``, have an empty host and path and no words; without unwanted examples nothing but rules blocks; null
ids stay; repeated rows are judged alike; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import ship_package, staged

LONGEST, NAME, SEED_COUNT = 24, 64, 100
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that mark unwanted hosts and paths (a parameter).
SEEDS = tuple(
    """ad ads adserver adult adverts affiliate bets betting bingo blackjack bonus camgirls casino cheap cialis clickbait clicks coupon crack cracked dating
    doorway escort escorts fake free gambling hacked hentai hookup jackpot jackpots keygen lottery malware mlm nude nudes payday pharma pharmacy phishing pills pirate
    poker popup porn porno promo ransomware replica roulette scam scams sex sexy slots spam spyware torrent torrents tracker tracking trojan viagra virus warez weightloss
    xanax xxx""".split()
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are a list of (verdict, host/path) in the plan; they are a few
    up to some hundred, chosen by hand."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def visible_words(html: Column) -> Column:
    """Lower-cased runs of letters outside of scripts, styles, comments and tags."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def names_of(text: Column) -> Column:
    """Runs of letters, lower-cased, those beyond ``NAME`` letters in stretches."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{1,{NAME}}})"), 1)


def word_counts(pages: DataFrame, html_col: str = "html", seeds=SEEDS) -> DataFrame:
    """(word, n) over the visible text of all pages, and the seeds."""
    words = pages.select(F.explode(visible_words(F.col(html_col))).alias("word")).where(F.length("word") <= LONGEST)
    extra = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, m long")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(extra, "word", "full").select("word", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def best_split(name: str, known: dict[str, float], log_total: float) -> list[str]:
    """The words of the path of highest probability; stretches outside known words are one word each. ``known``: counts of substrings."""
    n, ten = len(name), math.log(10)
    # best score up to a place, closed or inside an unknown stretch, and where its last word began
    closed, closed_from = [0.0] + [-math.inf] * n, [0] * (n + 1)
    inside, inside_from = [-math.inf] * (n + 1), [0] * (n + 1)
    for end in range(1, n + 1):
        begin = closed[end - 1] + ten - log_total - ten
        inside[end], inside_from[end] = max((inside[end - 1] - ten, inside_from[end - 1]), (begin, end - 1))
        closed[end], closed_from[end] = inside[end], inside_from[end]
        for start in range(max(0, end - LONGEST), end):
            count = known.get(name[start:end])
            if count:
                score = closed[start] + math.log(count) - log_total
                if score > closed[end]:
                    closed[end], closed_from[end] = score, start
    out, end = [], n
    while end:
        out.append(name[closed_from[end] : end])
        end = closed_from[end]
    return out[::-1]


def _splitter(log_total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known").to_pylist()
            words = [best_split(name, {k["word"]: k["n"] for k in ks or ()}, log_total) for name, ks in zip(batch.column("name").to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names of at most ``NAME`` letters."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("a"))
    spans = starts.select("name", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("a") + 1))).alias("k"))
    parts = spans.select("name", F.substring(F.col("name"), F.col("a"), F.col("k")).alias("word")).distinct()
    # at most NAME * LONGEST words a name
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return names.join(known, "name", "left").select("name", "known").mapInArrow(_splitter(math.log(total)), "name string, words array<string>")


def log_odds(rows: DataFrame, strength: float | None = None) -> DataFrame:
    """(word, odds) from (word, bad, good): multinomial log-odds with pseudo-counts in proportion to the word's overall share. ``strength``: their
    sum, by default the smaller class's words."""
    sums = rows.agg(F.sum("bad").alias("_bad"), F.sum("good").alias("_good"))
    # one row
    joined = rows.join(F.broadcast(sums))
    mass = F.least("_bad", "_good").cast("double") if strength is None else F.lit(float(strength))
    prior = mass * (F.col("bad") + F.col("good")) / (F.col("_bad") + F.col("_good"))
    share = lambda c, t: (F.col(c) + prior) / (F.col(t) + mass)
    odds = F.when(mass > 0, F.log(share("bad", "_bad")) - F.log(share("good", "_good"))).otherwise(F.lit(0.0))
    return joined.select("word", odds.alias("odds"))


def judge(pages: DataFrame, *, rules=RULES, seeds=SEEDS, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the verdict of each URL; score is the words' sum of log-odds, also where a rule decides."""
    ship_package(pages.sparkSession)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = staged(parsed.withColumn("names", F.concat(names_of(F.col("host")), names_of(F.col("path")))).withColumn("key", F.concat_ws(" ", "names")), "url-parsed")
    rows = keyed.select("key", "names").groupBy("key").agg(F.first("names").alias("names"))
    uses = staged(rows.select("key", F.explode("names").alias("name")), "url-names")
    split = staged(split_names(uses.select("name").distinct(), staged(word_counts(pages, html_col, seeds), "url-counts")), "url-words")
    marked = split.withColumn("seeded", F.exists("words", lambda w: w.isin(*seeds)) if seeds else F.lit(False))
    used = uses.join(marked, "name")
    unwanted = used.groupBy("key").agg(F.max("seeded").alias("bad"))
    sizes = unwanted.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    counted = uses.join(unwanted, "key").groupBy("name").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    words = split.join(counted, "name").select(F.explode("words").alias("word"), "bad", "good").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = log_odds(staged(words, "url-odds"))
    by_name = split.select("name", F.explode("words").alias("word")).join(odds, "word").groupBy("name").agg(F.sum("odds").alias("odds"))
    scores = uses.join(by_name, "name").groupBy("key").agg(F.sum("odds").alias("score"))
    prior = math.log(sizes["bad"] / sizes["good"]) if sizes["bad"] and sizes["good"] else 0.0
    out = keyed.join(scores, "key", "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    score = F.coalesce(F.col("score") + prior, F.lit(0.0))
    verdict = F.coalesce("_rule.verdict", F.when(score > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))

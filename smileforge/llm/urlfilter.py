"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Host, path and rule are column expressions.  The regression is trained on the
driver from a small labelled table and scores in Arrow batches.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words by label (1: block), of which labelled URLs are made.
TOPICS = {
    0: ("news", "wiki", "library", "museum", "garden", "recipes", "science", "school", "music", "maps", "health", "forum", "travel", "weather", "history", "sports", "books", "city", "docs", "code", "blog", "university"),
    1: ("casino", "poker", "jackpot", "slots", "betting", "viagra", "pills", "pharma", "porn", "xxx", "sex", "cams", "warez", "crack", "keygen", "torrent", "malware", "phishing", "payday", "replica", "backlinks", "clickbait"),
}


#: Parts of the invented names of sites about nothing in particular.
SYLLABLES = ("ka", "lo", "mi", "tor", "ven", "shi", "ru", "den", "bal", "ner", "so", "pi", "gra", "fel", "um", "tha", "ing", "est", "or")
NEUTRAL_SITES = 120


def topic_urls() -> tuple[tuple[str, int], ...]:
    """Three URLs a topic, alike for both labels: only the words tell them apart; and sites of invented names, which are allowed."""
    out = []
    for k in range(NEUTRAL_SITES):
        name = "".join(SYLLABLES[(k * step + k // 7) % len(SYLLABLES)] for step in (1, 5, 11)[: 2 + k % 2])
        out.append((f"http{'s' * (k % 2)}://{('', 'www.', 'm.', 'blog.')[k % 4]}{name}.example.{('com', 'org', 'net')[k % 3]}/{('en', 'de', 'fr', 'es')[k // 3 % 4]}/{997 * (k + 2) % 20_011}{('', '.html', '/')[k // 4 % 3]}", 0))
    for label, words in TOPICS.items():
        for k, word in enumerate(words):
            other, end, lang, number = words[(k + 5) % len(words)], ("com", "org", "net")[k % 3], ("en", "de", "fr", "es")[k % 4], 1009 * (k + 3) % 20_011
            out += [(f"https://{word}.example.{end}/{lang}/{number}", label), (f"http://www.example.{end}/{word}/{other}", label), (f"https://{word}-{other}.example.{end}/{lang}/{number}.html", label)]
    return tuple(out)


#: Labelled URLs (1: block).  Invented hosts under reserved names.
LABELLED_URLS = (
    ("https://news.example.com/fr/4711.html", 0), ("https://blog.example.com/de/15882", 0),
    ("http://www.example.org/en/articles/history-of-bridges", 0), ("https://docs.example.org/guide/install", 0),
    ("https://library.example.net/es/catalogue/2931", 0), ("http://museum.example.org/fr/collection/88", 0),
    ("https://m.example.org/de/5680", 0), ("https://m.example.net/fr/13965.html", 0),
    ("https://wiki.example.net/en/Algebra", 0), ("https://forum.example.com/es/thread/30156", 0),
    ("http://school.example.org/courses/physics/", 0), ("https://garden.example.net/tips/roses", 0),
    ("https://www.example.com/about", 0), ("https://recipes.example.com/fr/soupe-a-l-oignon", 0),
    ("https://science.example.org/papers/2021/0042", 0), ("http://city.example.net/en/transport/timetable", 0),
    ("https://blog.example.net/en/20214/", 0), ("http://letters.example.org/en/3344", 0),
    ("https://health.example.org/de/ratgeber/1203", 0), ("https://music.example.com/es/17777", 0),
    ("about:blank", 0), ("http://localhost/", 0),
    ("https://maps.example.net/fr/paris", 0), ("https://code.example.org/project/readme.html", 0),
    ("https://casino-bonus.example.com/win/jackpot", 1), ("http://free-casino.example.net/slots/spin?bonus=1", 1),
    ("http://cheap-pills.example.org/buy/viagra-online", 1), ("https://pharma-discount.example.net/order/pills", 1),
    ("http://adult-cams.example.com/live/xxx", 1), ("https://xxx-video.example.org/porn/watch/99", 1),
    ("http://tracker.ads.example.com/click?id=5", 1), ("https://ads.example.net/banner/redirect", 1),
    ("http://login-verify-account.example.com/secure/update", 1), ("https://secure-bank-login.example.org/verify/password", 1),
    ("http://download-crack.example.net/keygen/full-version.exe", 1), ("https://warez.example.com/torrent/crack.zip", 1),
    ("http://win-prize-now.example.org/claim/free-gift", 1), ("https://crypto-doubler.example.net/invest/profit", 1),
    ("http://spam-links.example.com/seo/cheap-backlinks", 1), ("https://replica-watches.example.org/shop/discount", 1),
    ("http://payday-loans.example.net/apply/fast-cash", 1), ("https://sex-dating.example.com/join/free", 1),
    ("http://poker-online.example.org/bet/bonus", 1), ("https://betting-tips.example.net/win/odds", 1),
    ("http://clickbait.example.com/you-wont-believe/ads", 1), ("https://malware-update.example.org/flash-player.exe", 1),
    *topic_urls(),
)
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
PENALTY = 1e-4
BLOCK_FROM = 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    cut = min(ends, default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    stops = [k for k in map(tail.find, "?#") if k >= 0]
    return host, tail[: min(stops, default=len(tail))]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """``split_url`` as column expressions."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else null; of equally long ones the first by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda x: (-len(x[1] + x[2]), x[1] + x[2]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Bucket of every character n-gram of the marked host and of the marked path, the two apart from each other."""
    out = []
    for kind, text in (("h", f"^{host}$"), ("p", f"{path}$")):
        data = text.encode()
        for n in SIZES:
            out += [zlib.crc32(data[k : k + n], ord(kind) * 257 + n) % BUCKETS for k in range(len(data) - n + 1)]
    return np.unique(np.array(out, np.int64))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, host: str, path: str) -> float:
        """Probability of block; n-grams weigh as a unit vector."""
        g = grams(host, path)
        z = self.bias + (self.weights[g].sum() / np.sqrt(len(g)) if len(g) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def fit(urls=LABELLED_URLS, rounds: int = 2000, rate: float = 2.0) -> Model:
    """Gradient descent over the labelled table; deterministic.  Without labels of both kinds nothing is blocked."""
    y = np.array([label for _, label in urls], float)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS), -10.0)
    x = np.zeros((len(urls), BUCKETS), np.float32)
    for row, (url, _) in zip(x, urls, strict=True):
        g = grams(*split_url(url))
        row[g] = 1 / np.sqrt(max(len(g), 1))
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used].astype(float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ d / len(y) * 10 + PENALTY * w)
        b -= rate * d.mean() * 10
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, b)


def judge(pages: DataFrame, rules=RULES, urls=LABELLED_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block) of every row of ``pages``.

    The longest rule that fits decides; without one the regression does, from
    a probability of 0.5.  A null url, or one without ``://``, has an empty host
    and path and is judged by the regression like any other.  Very long urls are
    taken whole.  Repeated rows give repeated rows, an empty table an empty
    result; other columns are not read.
    """
    model = fit(urls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = split.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    model_says = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model_says).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages"))

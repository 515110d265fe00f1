"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame expressions. The model is one array of `dims` doubles, so what is carried to the
tasks has a fixed size whatever the data; the labelled table is bounded by `max_labelled`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, numbers

#: Ordinary words of hosts that filter lists block (gambling, pills, adult, spam, advertising), and of hosts that they don't.
BLOCKED_WORDS = (
    "casino poker slots roulette jackpot bingo betting bets lottery wager gamble blackjack viagra pills pharma cialis tramadol steroids "
    "adult porn xxx sex nude escort webcam camgirls dating hookup spam phish scam clickbait backlink linkfarm seo traffic "
    "adserver advert ads adclick popunder popup banner tracker tracking pixel affiliate promo cheap free win prize bonus loan payday crypto "
    "replica warez crack keygen torrent malware"
).split()
ALLOWED_WORDS = (
    "news science docs blog wiki library museum university school recipes weather sport travel music health forum support developer code "
    "photos garden history law journal review poetry language maps events film economy times herald gazette tribune guardian observer "
    "hospital clinic city council county parliament ministry archive institute academy college research physics chemistry biology math "
    "astronomy engineering robotics railway airport harbour bridge mountain river ocean forest valley island theatre opera orchestra "
    "gallery painting sculpture design architecture kitchen bakery coffee bicycle running tennis football chess puzzle novel author "
    "books reader writer teacher student children family parents history heritage church culture society charity foundation community "
    "zeitung rundschau stadt verein wissenschaft schule reise wetter nachrichten journal ville mairie ecole sante voyage cuisine lecture "
    "diario ciudad escuela ciencia salud viaje cocina lectura heidelberg toulouse salamanca northampton thornton edinburgh ashland "
    "stanton hathaway brinton sheridan andersen ellington rothenberg tewkesbury hereford whitney easton tolland"
).split()
_PATHS = ("/", "/index.html", "/about", "/en/{n}", "/fr/{n}/", "/de/{n}.html", "/es/{n}", "/{n}/{m}/page", "/p/{n}?ref=a", "/item.php?id={n}", "/articles/{w}-{v}", "/{w}/{v}.html")
_ENDS = ("com", "net", "org", "info", "co.uk", "de", "fr", "es", "io")


def labelled_urls() -> list[tuple[str, int, str]]:
    """(url, block, stem of the host): words and pairs of words as hosts with common starts and endings, and paths of both kinds; two hosts that are allowed to each blocked one."""
    out = []
    for block, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, w in enumerate(words):
            for k in range(3):
                v, other = words[(i * 7 + 5 * k + 3) % len(words)], ALLOWED_WORDS[(i * 11 + k * 17 + 1) % len(ALLOWED_WORDS)]
                stem = (w, f"{w}-{v}", f"{w}{v}" if k % 2 else f"{w}-{other}")[k]
                for j in range(2):
                    n = i * 3 + k * 2 + j
                    path = _PATHS[n % len(_PATHS)].format(n=(n * 37) % 997, m=n % 12 + 1, w=w, v=v)
                    start = ("", "www.", "m.", "blog.", "en.")[(n * 3 + k) % 5]
                    out.append((f"{('http', 'https')[n % 2]}://{start}{stem}.{_ENDS[(n * 5 + i) % len(_ENDS)]}{path}", block, stem))
    return out


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lowered; '' for null or without '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]], max_rules: int = 1000) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null. A rule fits its host and all subdomains if the path starts with the rule's.

    Of rules of one length the first in code-point order wins. `rules` is configuration and becomes part
    of the plan, so more than `max_rules` of them are refused.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} fit into a plan")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(mark: Column, chars: Column, n: int, dims: int) -> Column:
    """Hashed n-grams of an array of characters; taken by position, so a url of any length costs in proportion to it."""
    at = F.when(F.size(chars) >= max(n, 3), F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(mark, *[F.get(chars, i + k) for k in range(n)]), F.lit(dims)).cast("int"))


def features(host: Column, path: Column, dims: int, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Distinct hashed character n-grams of host and path (digits as one) as sorted bucket numbers from 0; empty if both are empty."""
    grams = []
    for mark, part in (("h", host), ("p", F.regexp_replace(path, "[0-9]+", "0"))):
        framed = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        for n in sizes:
            grams.append(_grams(F.lit(mark), framed, n, dims))
    return F.array_distinct(F.flatten(F.array(*grams)))


def _score(found: Column, weights: list[float]) -> Column:
    """Weights' sum over the features found, divided by the root of their number, plus the last weight as bias."""
    w = numbers([float(x) for x in weights[:-1]], "double")
    total = F.aggregate(found, F.lit(0.0), lambda acc, i: acc + F.element_at(w, i + 1))
    return total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")) + F.lit(float(weights[-1]))


def train(labelled: DataFrame, dims: int = 4096, rounds: int = 60, step: float = 16.0, bias_step: float = 2.0, ridge: float = 1e-4, max_labelled: int = 20_000) -> list[float]:
    """Fit by accelerated gradient descent; each round is one aggregate over the labelled rows. Returns dims weights and a bias.

    A feature's share of a url is small, so weights move by a longer step than the bias.
    labelled: (url string, block int 0/1); rows with null or other labels are left out. Of more than
    `max_labelled` rows those with the smallest hash are taken. An empty table gives a model of zeros.
    """
    rows = labelled.where("block in (0, 1)").select("url", F.col("block").cast("double").alias("y")).orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled)
    data = rows.select("y", features(host_of(F.col("url")), path_of(F.col("url")), dims).alias("f")).persist()
    try:
        count = data.count()
        weights, ahead, momentum = [0.0] * (dims + 1), [0.0] * (dims + 1), 1.0
        for _ in range(rounds if count else 0):
            err = data.select("f", (F.lit(1.0) / (F.lit(1.0) + F.exp(-_score(F.col("f"), ahead))) - F.col("y")).alias("e"))
            spread = err.select(F.explode(F.concat("f", F.array(F.lit(dims)))).alias("i"), "e", F.size("f").alias("n"))
            share = F.when(F.col("i") == dims, F.col("e")).otherwise(F.col("e") / F.sqrt(F.greatest("n", F.lit(1)).cast("double")))
            slope = {r["i"]: r["g"] for r in spread.groupBy("i").agg(F.sum(share).alias("g")).collect()}  # dims + 1 rows at most
            pace = [step] * dims + [bias_step]
            after = [(1 - s * ridge) * a - s * slope.get(i, 0.0) / count for i, (a, s) in enumerate(zip(ahead, pace, strict=True))]
            momentum, last = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2, momentum
            ahead = [a + (last - 1) / momentum * (a - w) for a, w in zip(after, weights, strict=True)]
            weights = after
    finally:
        data.unpersist()
    return weights


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(url, block) for url, block, _ in labelled_urls()], "url string, block int")


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score and verdict ('allow' or 'block').

    A rule's verdict stands; else a url is blocked if the model's probability reaches the threshold. A
    url that is null or without '://' has an empty host and path, fits no rule, has the bias as score.
    Repeated rows are judged alike and all returned, an empty table gives no rows, and a url of any length counts as a whole.
    Columns of `pages` that carry one of these names give way to the new ones; others stay.
    """
    dims = len(weights) - 1
    new = ("host", "path", "rule", "score", "verdict")
    base = pages.select(*[pages[c] for c in pages.columns if c not in new], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    found = base.select("*", rule.alias("rule"), verdict.alias("__by_rule"), features(F.col("host"), F.col("path"), dims).alias("__found"))
    scored = found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-_score(F.col("__found"), weights))))
    return scored.withColumn("verdict", F.coalesce("__by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))).drop("__by_rule", "__found")

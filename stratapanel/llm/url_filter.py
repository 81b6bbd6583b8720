"""Allow or block URLs (operator 8), with DataFrame and SQL functions only.

Given rules come first: a rule holds for its host and all subdomains where the path starts with the rule's path; the longest rule
that fits decides. For all other URLs a logistic regression over hashed character n-grams of host and path decides. It is
trained on a small table of labelled URLs; its weights, `SIZE` numbers, are a constant of the query, so every URL is judged where
it is and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store

SIZE = 4096
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path and verdict.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)

#: Names and paths that are combined into the labelled URLs: what a reviewer would block, and what not.
BLOCKED_NAMES = (
    "casino-royal", "free-casino", "casino-bonus", "win-casino", "online-bets", "bets-online", "free-spins", "poker-bonus", "sportsbets", "free-bets24",
    "win-free-cash", "win-prizes", "jackpot-slots", "lucky-slots", "adult-video", "adult-chat", "sex-cams", "porn-tube", "xxx-movies", "adult-xx",
    "nude-pics", "escort-dating", "spam-mail", "spam-links", "link-farm", "content-farm", "seo-farm", "spamfarm", "cheap-pills", "diet-pills",
    "casino-games", "grand-casino", "casino-online", "big-wins", "slot-wins", "winners-club", "bingo-bonus", "roulette-win", "blackjack-live", "betting-odds",
    "dating-now", "hot-singles", "webcam-girls", "pills-online", "weight-loss-pills", "crypto-doubler", "click-bank", "mail-spammer", "spam-site", "bonus-cash",
    "viagra-shop", "payday-loans", "instant-loans", "warez-crack", "fake-rolex", "free-iphone", "ads-click", "popup-ads", "ad-tracker", "track-clicks",
)
ALLOWED_NAMES = (
    "library", "university", "news", "gazette", "science", "weather", "museum", "history", "garden", "kitchen",
    "thermal", "theater", "nation", "therapy", "thread", "station", "harbour", "mountain", "cycling", "railway",
    "gutenberg", "opensource", "hospital", "parliament", "orchestra", "farmers-market", "fishing", "tionland", "adulthood", "bettering",
    "thesis", "theses", "there", "other", "thirteen", "north", "healthnotes", "mathematics", "athens", "southern",
    "heathland", "stones", "rivers", "bridges", "houses", "forests", "castles", "recipes", "series", "essays",
    "city-guide", "open-data", "old-maps", "book-club", "bird-watch", "east-coast", "field-notes", "art-school", "rain-radar", "home-work",
)
PREFIXES = ("", "www.", "blog.", "m.")
SUFFIXES = ("example.com", "example.net", "example.org")
PATHS = ("/en/123", "/de/45.html", "/fr/678/", "/es/9")


#: Hosts that say nothing, and ways in which a name stands in a path.
PLAIN_HOSTS = ("riverside", "hillview", "oakwood", "maplegate", "silverlake", "brookfield", "stonegate", "fairview", "lakeshore", "greenmill")
PLACES = ("/{}", "/{}/12", "/en/{}.html", "/pages/{}/index", "/fr/{}/", "/a/{}-3")


def labelled_urls() -> list[tuple[str, int]]:
    """Every name as a host with each prefix, and as a path in several places; what goes with it takes turns, so that it says nothing."""
    out = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for i, name in enumerate(names):
            for k, prefix in enumerate(PREFIXES):
                out.append((f"https://{prefix}{name}.{SUFFIXES[(i + k) % 3]}{PATHS[(i // 3 + k) % 4]}", label))
                host = f"{PREFIXES[(i + k) % 4]}{PLAIN_HOSTS[(i + 3 * k) % 10]}.{SUFFIXES[(i // 2 + k) % 3]}"
                out.append((f"https://{host}{PLACES[(i + k) % 6].format(name)}", label))
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def buckets(host: str, path: str) -> str:
    """SQL: the distinct buckets of the n-grams of two columns; n-grams of host and path never share one by being equal."""
    parts = []
    for tag, column in (("h", host), ("p", path)):
        letters = f"split(concat('^', {column}, '$'), '')"
        for n in GRAMS:
            gram = "concat(" + ", ".join(f"c[i + {k}]" for k in range(n)) + ")"
            parts.append(
                f"flatten(transform(array({letters}), c -> case when size(c) < {n} then array() else "
                f"transform(sequence(0, size(c) - {n}), i -> pmod(xxhash64('{tag}', {gram}), {SIZE})) end))"
            )
    return f"array_distinct(concat({', '.join(parts)}))"


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]], strength: float = 0.003) -> tuple[list[float], float]:
    """Weights and intercept. `labelled` is a small list (url, 1 for block); it is a constant of the job."""
    rows = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in labelled]))
    rows = spark.range(0, 1, 1, 1).select(rows.alias("x")).select("x.label", host_of(F.col("x.url")).alias("host"), path_of(F.col("x.url")).alias("path"))
    rows = rows.withColumn("grams", F.expr(buckets("host", "path"))).cache()
    dense = F.expr(f"transform(sequence(0, {SIZE - 1}), b -> case when array_contains(grams, cast(b as bigint)) then 1.0D else 0.0D end)")
    vectors = rows.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=strength, maxIter=60, standardization=False).fit(vectors)
    rows.unpersist()
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] | None = None,
) -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict, block_score.

    Null URLs and those without `://` have an empty host and path; without a host the method says allow, with score 0. Of two
    rules of one length the one with the longer host holds. Repeated rows are judged each; other columns are ignored; an
    empty table gives an empty result.
    """
    weights, intercept = train(pages.sparkSession, labelled if labelled is not None else labelled_urls())
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.withColumn("grams", F.expr(buckets("host", "path")))
    total = F.aggregate("grams", F.lit(intercept), lambda a, b: a + F.get(table, b.cast("int")))
    base = base.withColumn("block_score", F.when(F.col("host") == "", 0.0).otherwise(1 / (1 + F.exp(-total))))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return base.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "block_score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(store.table(spark, sf_dir, "pages"))

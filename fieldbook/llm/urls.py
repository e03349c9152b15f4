"""URL filters: allow and block rules, then logistic regression on hashed character n-grams of host and path.

A rule names a host and a path prefix and fits the host and its subdomains. The longest fitting rule decides; a URL that
no rule fits is judged by a model trained from a small labelled table of URLs. Built-in functions and MLlib only.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the model like any other
(an empty URL has no n-gram: the intercept decides). Repeated rows give repeated results; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Rules are settings, held in the plan; more are refused.
MOST_RULES = 10_000
FEATURES, GRAMS = 1 << 14, (3, 4, 5)

#: The labelled table: sites to block, and sites to allow.
BLOCKED = """
casino-royal.example.com/bonus casino-win.example.net/en/12 www.online-casino.example.org/slots winbig-casino.example.com/en/4 casino-jackpot.example.net/de/7
cheap-pills.example.org/en/9 www.cheap-pills-shop.example.net/buy buy-pills.example.com/es/31 pills-cheap.example.org/fr/2 m.discount-pills.example.com/order
free-bets.example.net/en/3 www.free-bets-now.example.org/odds best-bets.example.com/en/88 m.bets-free.example.net/fr/5 sport-bets.example.org/es/6
adult-x.example.org/en/1 www.adult-video.example.com/watch xxx-adult.example.net/en/77 adult-cams.example.org/de/4 m.adult-chat.example.com/fr/8
spam-farm.example.com/en/20 link-spam.example.net/page www.spam-seo.example.org/en/6 linkfarm-spam.example.com/fr/71 content-farm.example.net/de/9
ads-track.example.net/en/15 track-ads.example.com/pixel www.ads-server.example.org/click adtrack.example.com/en/90 m.ads-track-click.example.net/es/3
""".split()  # fmt: skip
ALLOWED = """
news.example.com/en/10 www.library.example.org/en/catalogue/5 blog.garden.example.net/en/33 weather.example.com/de/7 m.recipes.example.net/fr/12
university.example.org/en/courses/8 www.museum.example.com/es/9 history.example.net/en/41.html science.example.org/en/52 docs.software.example.com/en/6
travel.example.net/de/14 www.music.example.org/fr/8 art.example.com/en/71 blog.cooking.example.net/es/62 health.example.org/en/93
m.city.example.com/en/5 forum.hiking.example.net/en/17 school.example.org/de/28 www.theatre.example.com/fr/39 books.example.net/en/44
photo.example.org/es/51 www.trains.example.com/en/66 birds.example.net/fr/73.html blog.thread.example.org/en/85 m.north.example.com/de/92
theory.example.net/en/101 www.thing.example.org/en/112 other.example.com/en/123 nation.example.net/es/134 blog.station.example.org/en/145
www.table.example.com/en/156.html three.example.net/fr/167 m.thin.example.org/de/178 earth.example.com/en/189 thanks.example.net/en/190
blog.then.example.org/en/201 mother.example.com/es/212 www.north-east.example.net/en/223 tent.example.org/fr/234 mountain.example.com/de/245
house.example.net/en/256 www.shelter.example.org/en/267 whale.example.com/en/278 blog.river.example.net/en/289 lion.example.org/es/300
m.wheat.example.com/en/311 season.example.net/de/322 www.letter.example.org/fr/333 ocean.example.com/en/344.html winter.example.net/en/355
""".split()  # fmt: skip


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    there = F.coalesce(url.contains("://"), F.lit(False))
    after = F.substr(url, F.locate("://", url) + 3)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def ngrams(text: Column, mark: str) -> Column:
    """Character n-grams of a text between two edges, each with a mark of its field."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    none = F.array().cast("array<string>")

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(framed) - (n - 1))
        return F.when(F.length(framed) >= n, F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substr(framed, i, F.lit(n))))).otherwise(none)

    grams = [of_size(n) for n in GRAMS]
    return F.when(text == "", none).otherwise(F.concat(*grams))


def _featured(urls: DataFrame) -> DataFrame:
    """Adds ``features``, from columns host and path."""
    both = urls.withColumn("grams", F.concat(ngrams(F.col("host"), "h"), ngrams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(both)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and label (1: block) of the small table."""
    rows = [F.struct(F.lit(f"https://{u}").alias("url"), F.lit(y).alias("label")) for y, urls in ((1.0, BLOCKED), (0.0, ALLOWED)) for u in urls]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> LogisticRegressionModel:
    host, path = host_and_path(F.col("url"))
    known = _featured(labelled.select(host.alias("host"), path.alias("path"), "label")).select("features", "label")
    return LogisticRegression(maxIter=60, regParam=1e-4, standardization=False).fit(known)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and ``risk``, the model's probability of a URL to block."""
    host, path = host_and_path(F.col("url"))
    given = _featured(pages.select("page_id", host.alias("host"), path.alias("path")))
    scored = model.transform(given).withColumn("risk", vector_to_array("probability")[1])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("risk") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "risk")

"""The first of many pattern rules that fits a text, without trying all rules on all texts.

Every rule names a token, a run of ASCII letters and digits in lower case, that
a text must hold for its pattern to fit.  An index from tokens to rules gives
each distinct text its few candidates; only their patterns are tried, and the
fitting rule of least number wins.  A rule with the empty token is a candidate
for every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules go to every task: a set beyond this has to be split by its caller.
MOST_RULES = 100_000
RULE_KIND = "rule_no int, token string, pattern string, label string"


@dataclass(frozen=True)
class Rule:
    token: str
    pattern: str
    label: str

    def __post_init__(self):
        if not re.fullmatch("[a-z0-9]*", self.token):
            raise ValueError(f"not a token: {self.token!r}")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules in order, numbered from 1."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return spark.createDataFrame([(n, r.token, r.pattern, r.label) for n, r in enumerate(rules, 1)], RULE_KIND)


def tokens_of(text: Column) -> Column:
    """Distinct tokens of a text, and the empty one."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def first_rules(texts: DataFrame, rules: DataFrame, column: str = "text") -> DataFrame:
    """(text, rule_no, label, part) of every distinct text that is not null.

    ``part`` is the pattern's first group, null where there is none.  A text
    without a fitting rule has nulls.  Each rule's pattern needs one group at
    least.
    """
    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    # One row for each token of a text that some rule asks for; the text is tried where it is.
    spread = distinct.select("text", F.explode(tokens_of(F.col("text"))).alias("token"))
    tried = spread.join(F.broadcast(rules), "token", "left")
    fits = F.col("pattern").isNotNull() & F.regexp_like("text", F.col("pattern"))
    part = F.expr("nullif(regexp_extract(text, pattern, 1), '')")
    best = F.min(F.when(fits, F.struct("rule_no", "label", part.alias("part")))).alias("best")
    return tried.groupBy("text").agg(best).select("text", "best.rule_no", "best.label", "best.part")


def with_first_rule(df: DataFrame, rules: DataFrame, column: str, out: str, other: str = "Other") -> DataFrame:
    """``df`` with the label of the first fitting rule of a text column, tried once for each distinct text."""
    found = first_rules(df, rules, column).select(F.col("text").alias("text_"), F.col("label").alias("label_"))
    joined = df.join(found, F.col(column) == F.col("text_"), "left")
    return joined.select(*df.columns, F.when(F.col(column).isNotNull(), F.coalesce("label_", F.lit(other))).alias(out))


# Products that name themselves as Name/version.  The order decides: products
# that carry the names of others for compatibility come last.
PRODUCTS = (
    "Googlebot bingbot YandexBot Baiduspider DuckDuckBot AhrefsBot SemrushBot MJ12bot DotBot PetalBot Applebot Twitterbot "
    "facebookexternalhit LinkedInBot Slackbot Discordbot TelegramBot Pinterestbot UptimeRobot Pingdom "
    "curl Wget libcurl HTTPie PostmanRuntime okhttp axios aiohttp httpx Scrapy Nutch Jakarta Go "
    "EdgA EdgiOS Edg Edge OPR Opera OPiOS OPT Vivaldi YaBrowser SamsungBrowser UCBrowser UBrowser MiuiBrowser HuaweiBrowser "
    "HeyTapBrowser VivoBrowser QQBrowser MQQBrowser Sogou Maxthon Brave DuckDuckGo Whale Puffin Silk Coast Dolphin "
    "Kiwi Cent Iron Epiphany Konqueror Falkon Midori QupZilla Otter Waterfox PaleMoon SeaMonkey Iceweasel IceCat K "
    "Focus Klar FxiOS Firefox CriOS GSA Chromium HeadlessChrome Chrome Trident MSIE Version Safari AppleWebKit Mozilla"
).split()
MAJOR_VERSIONS = (1, 2, 3)


def product_rules(products: list[str] = PRODUCTS, digits: tuple[int, ...] = MAJOR_VERSIONS) -> list[Rule]:
    """For each product a rule for each length of its major version, and one for the product without a version."""
    out = []
    for product in products:
        token = product.lower()
        for n in digits:
            out.append(Rule(token, rf"(?i)(?:^|[^A-Za-z0-9]){product}/([0-9]{{{n}}})(?:[^0-9]|$)", f"{product} {'x' * n}"))
        out.append(Rule(token, rf"(?i)(?:^|[^A-Za-z0-9])({product})(?:[^A-Za-z0-9]|$)", product))
    return out

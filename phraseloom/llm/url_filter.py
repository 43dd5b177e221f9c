"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule allows or blocks a host with all its subdomains below a path; of the rules that fit a url the longest decides.
Where none fits, a logistic regression does, trained from a small labelled url table. Features are the 3- to 5-grams of
the host and of the path, each with marks at both ends, hashed. The threshold is set on urls of words that the model has not
seen. Everything is DataFrame operations and spark.ml on
DataFrames; scoring is a map over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, ORDERS = 1 << 14, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Words of hosts and of paths that speak for blocking (gambling, pills, bulk mail, adverts, adult offers),
#: words that speak against it, and words that sites of both kinds use. They are general words, not hosts of any given table.
BLOCK_WORDS = (
    "casino", "poker", "jackpot", "roulette", "betting", "slots", "viagra", "pills", "pharmacy-deals", "spam", "linkfarm", "clicktrack", "adserver",
    "popup", "adult", "xxx", "webcam-girls", "free-prizes", "payday-loans", "replica-watches", "fake-ids", "warez", "keygen", "miracle-diet",
)
ALLOW_WORDS = (
    "library", "weather", "gardening", "university", "cityhall", "recipes", "museum", "astronomy", "history", "clinic", "railway", "newspaper",
    "software", "mathematics", "cookbook", "travel", "poetry", "bicycles", "council", "orchestra", "school", "farming", "archive", "sailing",
)
SHARED_WORDS = ("", "my", "best", "online", "city", "world", "hub", "direct")
#: (scheme and start of the host, end of the host and start of the path, end of the path), the same for both labels.
FORMS = (("https://www.", ".example.com/en/", ""), ("http://blog.", ".example.net/fr/", ".html"), ("https://m.", ".example.org/es/", "/"), ("http://", ".example.net/de/", ""))
#: Hosts to allow for each host to block in the labelled table: most sites are harmless, and a host that no n-gram speaks for or against is
#: judged by that share.
ALLOWED_PER_BLOCKED = 2


def _labelled() -> list[tuple[str, int, str]]:
    """(url, 1 to block, the word in its host): each word in every form, with a shared word before or after it."""
    rows = []
    for words, label, times in ((BLOCK_WORDS, 1, 1), (ALLOW_WORDS, 0, ALLOWED_PER_BLOCKED)):
        for k, word in enumerate(words):
            for j in range(times * len(FORMS)):
                shared = SHARED_WORDS[(3 * k + j) % len(SHARED_WORDS)]
                name = "-".join(filter(None, (shared, word) if (k + j // 2) % 2 else (word, shared)))
                start, middle, end = FORMS[j % len(FORMS)]
                rows.append((f"{start}{name}{middle}{(37 * k + 11 * j) % 997}{end}", label, word))
    return rows


#: The labelled table: (url, 1 to block, word).
LABELLED = _labelled()
#: Folds of words, and the share of urls to allow with unseen words that the threshold may block.
FOLDS, FALSE_BLOCKS = 4, 0.02


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null; of equal length, block goes before allow, then by name."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    tests = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in order]
    return F.coalesce(*tests, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _pieces(mark: str, whole: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole) - (n - 1)))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """All n-grams of host and path, marked by which of the two they are from; the whole of one that is shorter."""
    ends = [("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))]
    return F.concat(*[_pieces(mark, whole, n) for mark, whole in ends for n in ORDERS])


_hashing = {"inputCol": "_grams", "outputCol": "_features", "numFeatures": BUCKETS, "binary": True}


def train(labelled: DataFrame, regularisation: float = 1e-3) -> LogisticRegressionModel:
    """Fit on a small table (url, label), label 1 to block."""
    host, path = host_and_path(F.col("url"))
    rows = HashingTF(**_hashing).transform(labelled.select(grams(host, path).alias("_grams"), F.col("label").cast("double").alias("label")).coalesce(1))
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=regularisation, standardization=False, maxIter=60, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted").fit(rows)


def out_of_fold(labelled: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(label, block_score) of every row of a small table (url, label, word), by a model that saw none of its word's urls."""
    parts = []
    for k in range(folds):
        own = F.pmod(F.xxhash64("word"), F.lit(folds)) == k
        scored = _scored(labelled.where(own).select("label", *[c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col("url")))]), train(labelled.where(~own)))
        parts.append(scored.select("label", _score().alias("block_score")))
    return reduce(DataFrame.unionByName, parts)


def threshold_of(scores: DataFrame, false_blocks: float = FALSE_BLOCKS) -> float:
    """The score, 0.5 or more, beyond which about the given share of the urls to allow lies; scores are those of out_of_fold.

    A host of words that the model hasn't seen is the common case, and a regression puts such hosts anywhere between the
    two labels, not at their share; so the threshold comes from scores of unseen words.
    """
    found = scores.where("label = 0").agg(F.percentile("block_score", 1 - false_blocks)).first()[0]
    return max(0.5, found or 0.5)


def _scored(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    return model.transform(HashingTF(**_hashing).transform(rows.withColumn("_grams", grams(F.col("host"), F.col("path")))))


def _score() -> Column:
    return F.round(vector_to_array("_probability")[1], 6)


def judge(pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): one row for each row of pages, in one pass without a shuffle.

    A url without "://", or a null one, has empty parts, which only a rule for the empty host would fit; the model
    judges it like any other. block_score is the model's, also where a rule decides.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored, score = _scored(rows, model), _score()
    own = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", own["rule"].alias("rule"), F.coalesce(own["verdict"], by_model).alias("verdict"), score.alias("block_score"))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled urls of this module; any table (url, label, word: what urls of one fold have in common) can take its place."""
    return spark.createDataFrame(LABELLED, "url string, label int, word string")

"""URL filter: explicit rules first, gradient-boosted trees for the rest.

The trees see lexical features of the URL (length, depth, digit ratio,
entropy, parameter counts, suffix statistics), all column expressions, and
are fitted by Spark ML on a bounded sample of labelled URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import written
from moodgauge.session import ensure_checkpoint_dir

# bound of the labelled sample the trees are fitted on
SAMPLE = 20_000
TREES, DEPTH = 10, 4
BLOCK_AT = 0.5
# weight of the overall rate in a suffix's rate
PRIOR = 20.0

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]

FEATURES = ["f_url_length", "f_host_length", "f_path_length", "f_depth", "f_digit_ratio", "f_entropy", "f_params",
            "f_host_labels", "f_hyphens", "f_secure", "f_suffix_rate", "f_suffix_count"]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(rules: list[tuple[str, str]], h: Column, p: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. A
    rule is ``host/path``; it fits its host and all subdomains where the path
    starts with its own. Of rules repeated with another verdict the first
    counts."""
    first: dict[str, str] = {}
    for r, verdict in rules:
        first.setdefault(r, verdict)
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    # shortest first: each longer rule goes in front of the shorter ones
    for r in sorted(first, key=len):
        own, slash, rest = r.partition("/")
        hit = ((h == own) | h.endswith("." + own)) & p.startswith(slash + rest)
        fit = F.when(hit, F.struct(F.lit(r).alias("rule"), F.lit(first[r]).alias("verdict"))).otherwise(fit)
    return fit


def suffix(h: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(h, r"([^.]*\.?[^.]*)$", 1)


def features(urls: DataFrame, url_col: str) -> DataFrame:
    """``urls`` with the lexical features; null URLs count as empty."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    h, p = host(F.col(url_col).cast("string")), path(F.col(url_col).cast("string"))
    n = F.greatest(F.length(u), F.lit(1))

    def count(chars: str, of: Column) -> Column:
        return (F.length(of) - F.length(F.translate(of, chars, ""))).cast("double")

    share = F.transform(F.filter(F.array_distinct(F.split(u, "")), lambda c: c != ""),
                        lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, x: acc - x * F.log2(x))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    params = F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0)
    return urls.withColumns({
        "f_url_length": F.length(u).cast("double"), "f_host_length": F.length(h).cast("double"),
        "f_path_length": F.length(p).cast("double"), "f_depth": count("/", p),
        "f_digit_ratio": count("0123456789", u) / n, "f_entropy": entropy, "f_params": params.cast("double"),
        "f_host_labels": count(".", h) + 1, "f_hyphens": count("-", h),
        "f_secure": u.startswith("https:").cast("double"), "f_suffix": suffix(h)})


def _with_suffix(rows: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    # at most one row per sampled URL
    j = rows.join(F.broadcast(rates), rows["f_suffix"] == rates["s"], "left")
    return j.withColumns({"f_suffix_rate": F.coalesce("rate", F.lit(overall)),
                          "f_suffix_count": F.log1p(F.coalesce("seen", F.lit(0)).cast("double"))}).drop("s", "rate", "seen")


class UrlModel:
    """Fitted trees and suffix statistics. Without labels of both kinds every
    URL gets the more frequent verdict (allow if there are none)."""

    def __init__(self, labelled: DataFrame, url_col: str = "url", label_col: str = "label"):
        """``labelled`` has a URL and a label: 1 to block, 0 to allow. Rows
        without a label are left out. Of more than SAMPLE rows those are
        taken whose URL hashes lowest."""
        ensure_checkpoint_dir(labelled.sparkSession)
        rows = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("double").alias("label"))
        sample = rows.where("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE)
        sample = written(features(sample, "url").coalesce(2), "urls")
        n, self.overall = sample.agg(F.count(F.lit(1)), F.avg("label")).first()
        self.overall = self.overall or 0.0
        self.rates = sample.groupBy(F.col("f_suffix").alias("s")).agg(
            ((F.sum("label") + F.lit(PRIOR * self.overall)) / (F.count(F.lit(1)) + PRIOR)).alias("rate"),
            F.count(F.lit(1)).alias("seen"))
        self.rates = written(self.rates.coalesce(1), "suffixes")
        self.trees = None
        self.assemble = VectorAssembler(inputCols=FEATURES, outputCol="f_all")
        if n and 0 < self.overall < 1:
            train = self.assemble.transform(_with_suffix(sample, self.rates, self.overall)).select("f_all", "label").coalesce(2)
            self.trees = GBTClassifier(featuresCol="f_all", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7,
                                       maxBins=32).fit(train)

    def score(self, urls: DataFrame, url_col: str) -> DataFrame:
        """``urls`` (whose columns must not start with ``f_``) with
        ``f_score``, the probability of a URL to be one to block."""
        keep = urls.columns
        if self.trees is None:
            return urls.withColumn("f_score", F.lit(float(self.overall >= 0.5)))
        x = self.assemble.transform(_with_suffix(features(urls, url_col), self.rates, self.overall))
        out = self.trees.setProbabilityCol("f_prob").setRawPredictionCol("f_raw").setPredictionCol("f_pred").transform(x)
        return out.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("f_prob")[1].alias("f_score"))


def judge(urls: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict (the
    rule's, else block if the model's score is 0.5 or more) and score.

    Null URLs and URLs without ``://`` have an empty host and path, fit no
    rule and are judged by the model as they are (null as empty). Ids may be
    null or repeated; other columns are not read. Row-local but for the
    broadcast suffix table (at most SAMPLE rows)."""
    u = F.col(url_col).cast("string")
    rows = urls.select(F.col(id_col).alias("id"), u.alias("url"))
    rows = model.score(rows, "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("fit", rule(rules, F.col("host"), F.col("path")))
    learned = F.when(F.col("f_score") >= BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
                       F.coalesce("fit.verdict", learned).alias("verdict"), F.col("f_score").alias("score"))

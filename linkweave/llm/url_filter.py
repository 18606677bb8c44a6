"""Operator 6, URL filters: host and path rules, and association rules for the URLs that no rule fits.

Rules of the table fit a host and its subdomains and a beginning of the path; the longest wins. URLs that a rule
judges are the labelled ones: FP-growth mines which combinations of URL tokens come with which verdict, and those
with MIN_SUPPORT of the labelled URLs, MIN_CONFIDENCE and a lift above one are kept. They are matched through an
inverted index: a rule stands under its rarest token only, and a URL's distinct set of tokens is looked up once,
however many URLs share it. The surest rule that matches decides (confidence, then support, then fewer tokens, then
block before allow); without one a URL is allowed.

Defined results: a null URL and one without `://` have an empty host and path and are judged by the method; repeated
rows are judged each for itself; without labelled URLs the method allows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common, simhash

#: (host and beginning of the path, verdict)
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8
VERDICT = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host, path, rules: list[tuple[str, str]] = RULES):
    """A struct of the longest rule that fits (its text and verdict), or null."""
    fits = []
    for text, verdict in rules:
        own_host, slash, own_path = text.partition("/")
        inside = (host == own_host) | F.endswith(host, F.lit("." + own_host))
        fits.append(F.when(inside & F.startswith(path, F.lit(slash + own_path)), F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def url_tokens(url, host, path):
    """Distinct tokens of a URL: scheme, labels of the host, words of the path, keys of the query, and an end mark."""
    tagged = lambda tag, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    words = F.filter(F.split(path, r"[/.]"), lambda x: ~x.rlike(r"^[0-9]*$"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    ends = F.array(F.when(F.endswith(path, F.lit("/")), "slash").otherwise(""), F.when(url.contains("#"), "fragment").otherwise(""))
    every = F.concat(tagged("scheme=", F.array(F.lower(scheme))), tagged("host=", F.split(host, r"\.")), tagged("path=", words), tagged("query=", keys), tagged("end=", ends))
    return F.array_sort(F.array_distinct(F.coalesce(every, F.array().cast("array<string>"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedent, verdict, confidence, support of the kept rules; `labelled` has tokens and verdict."""
    from pyspark.ml.fpm import FPGrowth

    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if not labelled.head(1):
        return labelled.sparkSession.createDataFrame([], schema)
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(VERDICT), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.withColumn("verdict", F.element_at("consequent", 1))
    found = found.where(F.startswith("verdict", F.lit(VERDICT)) & (F.col("lift") > 1))
    return found.select("antecedent", F.substring("verdict", len(VERDICT) + 1, 100).alias("verdict"), "confidence", "support")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens (a set of `sets`) with the rule that decides it, for the sets that a rule matches."""
    by_token = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    own = common.materialize(rules.withColumn("id", F.monotonically_increasing_id()), "rules")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    index = own.select("id", F.explode("antecedent").alias("token")).join(by_token, "token", "left").groupBy("id").agg(rarest.alias("least"))
    index = own.join(index, "id").select("antecedent", "verdict", "confidence", "support", F.col("least.token").alias("token"))
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(simhash.few_or_shuffled(index), "token")
    found = found.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", "support", (-F.size("antecedent")).alias("n"), "verdict", "antecedent")
    return found.groupBy("tokens").agg(F.max(order).alias("by"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and of the method antecedent and confidence."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    rows = common.materialize(rows.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"), "tokens"), "urls")
    labelled = rows.where("ruled is not null").select("tokens", F.col("ruled").alias("verdict"))
    kept = common.materialize(mine(labelled, min_support, min_confidence), "mined")
    # Only tokens that rules speak of tell sets apart. Each is frequent, so there are at most a URL's mean number of
    # tokens over min_support of them, whatever the number of URLs.
    used = sorted(r["token"] for r in kept.select(F.explode("antecedent").alias("token")).distinct().collect())
    spoken = F.array(*map(F.lit, used)) if used else F.array().cast("array<string>")
    rows = rows.withColumn("tokens", F.array_sort(F.array_intersect("tokens", spoken)))
    sets = rows.where("rule is null").select("tokens").distinct()
    by = common.materialize(matched(sets, kept), "matched")
    out = rows.join(by if by.count() > simhash.BROADCAST_ROWS // 10 else F.broadcast(by), "tokens", "left")
    verdict = F.coalesce("ruled", F.col("by.verdict"), F.lit("allow"))
    mined = lambda c: F.when(F.col("rule").isNull(), F.col(f"by.{c}"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), mined("antecedent").alias("antecedent"), mined("confidence").alias("confidence"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")

"""URL verdicts: explicit host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees (Spark ML) learn from URLs that a rule decides, and judge all others. Features are column expressions over the URL: lengths,
path depth, digit ratio, character entropy, parameters, labels of the host, and how often labelled URLs with the same host
suffix or the same first path part are blocked (smoothed; counted by grouping, so a frequent suffix is summed up where it
is read). The trees learn from at most about `SAMPLE_ROWS` distinct labelled URLs, half of them of each verdict and each weighted by its
copies; suffix statistics cover all rows.

Cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged like any other; of rules
that fit the longest wins, of equally long ones the first; without labelled URLs of both kinds the one label there is (else
`allow`) is the verdict of all; very long URLs are judged whole, like any other; repeated rows are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .language import bounded_sample

SAMPLE_ROWS = 20_000
#: A statistic starts from this many labelled URLs of average share.
SMOOTHING = 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = r"(?s)://([^/?#]*)([^?#]*)"
COUNTED = ("suffix", "opening")
LEXICAL = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "fragment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, UPPER.lower()), F.regexp_extract(url, PARTS, 2)


def fitting_rule(rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the columns `host` and `path`, else null. A rule is (verdict, host and path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features and the keys of the counted ones to rows with `address`, `host` and `path`."""
    url, host, path = F.col("address"), F.col("host"), F.col("path")
    many = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)

    def surprise(sum_: Column, letter: Column) -> Column:
        share = (F.length(url) - F.length(F.replace(url, letter, F.lit("")))) / many
        return sum_ - share * F.log2(F.greatest(share, F.lit(1e-9)))

    return rows.select(
        "*", F.length(url).cast("double").alias("length"), F.length(host).cast("double").alias("host_length"),
        F.size(F.split(host, r"\.")).cast("double").alias("labels"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double").alias("depth"),
        ((F.size(F.split(url, "[0-9]")) - 1) / many).alias("digit_ratio"), F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), surprise).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"), F.length(query).cast("double").alias("query_length"),
        (F.size(F.split(url, "-")) - 1).cast("double").alias("hyphens"), F.when(url.contains("#"), 1.0).otherwise(0.0).alias("fragment"),
        F.substring_index(host, ".", -1).alias("suffix"), F.regexp_extract(path, "(?s)^/([^/]*)", 1).alias("opening"))


def with_statistics(rows: DataFrame, labelled: DataFrame, average: float) -> DataFrame:
    """Adds the smoothed share of blocked URLs among the labelled ones with the same suffix and the same opening."""
    for key in COUNTED:
        counts = labelled.groupBy(key).agg(((F.sum("label") + SMOOTHING * average) / (F.count(F.lit(1)) + SMOOTHING)).alias(f"{key}_share"))
        rows = rows.join(counts, key, "left").withColumn(f"{key}_share", F.coalesce(f"{key}_share", F.lit(average)))
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: the id, `host`, `path`, `rule` (null where none fits) and `verdict`, allow or block."""
    host, path = host_and_path(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("address"), host.alias("host"), path.alias("path"))
    rows = lexical(parts.withColumn("found", fitting_rule(rules)))
    labelled = rows.where("found is not null").withColumn("label", F.when(F.col("found.verdict") == "block", 1.0).otherwise(0.0))
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0, total):
        judged = rows.withColumn("prediction", F.lit(1.0 if total and blocked else 0.0))
    else:
        average = blocked / total
        # Copies of one URL count by their number; of each verdict's distinct URLs a bounded sample, at least one, is drawn.
        distinct = labelled.groupBy("address", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"), *[F.first(c).alias(c) for c in (*LEXICAL, *COUNTED)])
        distinct = cut_lineage(distinct)
        chosen = bounded_sample(distinct, "address", "label", sample_rows // 2)
        assembler = VectorAssembler(inputCols=[*LEXICAL, *(f"{k}_share" for k in COUNTED)], outputCol="features")
        examples = assembler.transform(with_statistics(chosen, labelled, average)).select("features", "label", "weight")
        trees = GBTClassifier(maxIter=20, maxDepth=4, maxBins=64, stepSize=0.2, seed=5, weightCol="weight").fit(examples)
        judged = trees.transform(assembler.transform(with_statistics(rows, labelled, average)))
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce(F.col("found.verdict"), F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"))

"""Images, recipes and one-off backfills as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.answers import image_type
from ..functions.ids import stable_id, url_key
from ..functions.text import terms
from ..operators.skew import top_per_group


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


def register_images(images: DataFrame, max_bytes: int = 5_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, bytes, rejects). A fetched image is known by its address, a generated one by its content."""
    rows = images.withColumns({"sha256": F.sha2("content", 256), "mime_type": image_type(F.col("content")), "bytes": F.octet_length("content")})
    rows = rows.withColumn("id", F.when(F.col("origin") == "fetched", url_key(F.col("url"))).otherwise(F.col("sha256")))
    reason = F.when(F.col("mime_type").isNull(), F.lit("A PNG, JPEG, WebP or GIF image is required")).when(F.col("bytes") > max_bytes, F.lit("Image too large"))
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null").drop("reason")
    return good.drop("content"), good.select("scope", "id", "content"), judged.where("reason is not null").drop("content")


def readable_images(images: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """Images a scope may read, its own before the shared ones, newest first. asked: query_id, scope."""
    readable = asked.withColumn("readable", F.explode(F.when(F.col("scope") == "shared", F.array("scope")).otherwise(F.array("scope", F.lit("shared")))))
    rows = images.withColumnRenamed("scope", "readable").join(readable, "readable").withColumn("own", (F.col("readable") == F.col("scope")).cast("int"))
    return top_per_group(rows, ["query_id"], [F.col("stored_at").desc(), F.col("own").desc(), F.col("id")], limit, "place")


RECIPE = "struct<name:string,ingredients_text:array<string>,instructions:array<string>,yield_servings:double,yield_text:string,image_url:string>"


def valid_recipes(recipes: DataFrame) -> DataFrame:
    """Recipes (url, body) that pass the whitelist: a name, 1-100 texts of 1-6000 characters, 0 < servings ≤ 60."""
    def texts(c):
        return (F.size(c) >= 1) & (F.size(c) <= 100) & F.forall(c, lambda x: x.isNotNull() & (F.length(x) > 0) & (F.length(x) <= 6000))
    body = F.col("body")
    servings = body["yield_servings"].isNull() | ((body["yield_servings"] > 0) & (body["yield_servings"] <= 60))
    public = F.col("url").rlike(r"^https?://[^/?#@:]+(:\d+)?([/?#]|$)")
    ok = (F.trim(body["name"]) != "") & texts(body["ingredients_text"]) & texts(body["instructions"]) & servings & public
    return recipes.where(F.coalesce(ok, F.lit(False)))


def rejected_recipes(recipes: DataFrame) -> DataFrame:
    """The rows `valid_recipes` leaves out, whole, each once."""
    ok = valid_recipes(recipes.withColumn("__row", F.xxhash64("url", F.to_json("body")))).select("__row").distinct()
    return recipes.withColumn("__row", F.xxhash64("url", F.to_json("body"))).join(ok, "__row", "left_anti").drop("__row")


def recipe_graph(recipes: DataFrame, collection: str = "recipes", prefix: str = "lorekeep") -> tuple[DataFrame, DataFrame]:
    """One source and one document per address, each about the collection; running it again changes nothing."""
    rows = valid_recipes(recipes).dropDuplicates(["url"])
    source, document = stable_id("source", F.concat(F.lit("recipe:"), "url"), prefix), stable_id("document", F.concat(F.lit("recipe:"), "url"), prefix)
    root = stable_id("concept", F.lit(collection), prefix)
    text = F.to_json("body")
    nodes = (rows.select(source.alias("id"), F.lit("Source").alias("kind"), F.col("body.name").alias("label"), F.lit("").alias("text"), F.col("url").alias("uri"))
             .unionByName(rows.select(document.alias("id"), F.lit("Document").alias("kind"), F.col("body.name").alias("label"), text.alias("text"), F.col("url").alias("uri"))))
    edges = (rows.select(source.alias("src"), document.alias("dst"), F.lit("PROVIDES").alias("relation"))
             .unionByName(rows.select(document.alias("src"), root.alias("dst"), F.lit("ABOUT").alias("relation"))))
    return nodes, edges


def recipe_lookup(queries: DataFrame, recipes: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, id, shared, rank) by shared content words. Only recipes that share a word meet a query."""
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    held = recipes.select("id", F.explode(terms(F.col("text"))).alias("term"))
    shared = held.join(asked, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("shared"))
    return top_per_group(shared, ["query_id"], [F.col("shared").desc(), F.col("id")], limit)


def pending_backfill(rows: DataFrame, markers: DataFrame, name: str) -> DataFrame:
    """The rows of a one-off job while its marker is missing, none afterwards."""
    done = markers.where(F.col("name") == name).agg(F.count(F.lit(1))).scalar()
    return rows.where(done == 0)

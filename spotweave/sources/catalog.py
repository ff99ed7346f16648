"""Asset listings, lineups and title matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.text import basename, title_key
from spotweave.operators.skew import pick_by
from spotweave.settings import VIDEO_EXTENSIONS


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder; the file contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime"))


def playable_files(files: DataFrame) -> DataFrame:
    name = basename(F.col("path"))
    known = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(*VIDEO_EXTENSIONS)
    return files.filter(known).withColumn("name", name).orderBy("path")


def asset_catalog(files: DataFrame, existing: DataFrame, banner_sec: float = 10.0) -> DataFrame:
    """Ads found in a listing (path, probed_sec) that the inventory does not have.

    The ad id is the file name without extension; clips come before banners when ids collide.
    """
    named = files.withColumn("_name", basename(F.col("path"))).withColumn(
        "_ext", F.regexp_extract("_name", r"\.([^.]+)$", 1))
    ads = named.filter(F.col("_ext").isin("mp4", "jpg", "png")).select(
        F.expr("left(_name, length(_name) - length(_ext) - 1)").alias("ad_id"),
        F.when(F.col("_ext") == "mp4", F.lit("video_clip")).otherwise(F.lit("banner")).alias("ad_type"),
        F.col("path").alias("resource_path"),
        F.when(F.col("_ext") == "mp4", F.col("probed_sec")).otherwise(F.lit(banner_sec)).alias("duration_sec"),
        F.when(F.col("_ext") == "mp4", 0).when(F.col("_ext") == "jpg", 1).otherwise(2).alias("_rank"))
    first = pick_by(ads, ["ad_id"], [F.col("_rank"), F.col("resource_path")]).drop("_rank")
    return first.join(existing.select("ad_id"), "ad_id", "left_anti")


LINEUP_FIELDS = ("id", "title", "filename", "poster", "preview", "thumbnail", "job_id")


def lineup_entries(documents: DataFrame) -> DataFrame:
    """Entries of ``items[]`` of each JSON document (channel, body): position, fields and ``bad``.

    Documents are read as VARIANT, so an odd value costs its field only: a field that is no scalar is NULL. An entry that is
    no object comes as ``bad`` text with no field; so does, without position, a document that is no JSON or whose ``items`` is no list.
    ``listed`` says that the document has a list of items.
    """
    parsed = documents.select("channel", "body", F.try_parse_json("body").alias("doc"))
    parsed = parsed.withColumns({"given": F.try_variant_get("doc", "$.items", "variant"), "items": F.try_variant_get("doc", "$.items", "array<variant>")})
    # An empty or missing list still says whether the channel has one.
    rows = parsed.select("channel", F.col("items").isNotNull().alias("listed"),
                         F.when(F.col("doc").isNull() | (F.col("given").isNotNull() & ~F.is_variant_null("given") & F.col("items").isNull()), F.col("body")).alias("broken"),
                         F.posexplode_outer("items").alias("pos", "item"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")), F.lit(False))
    fields = [F.when(is_object, F.try_variant_get("item", f"$.{name}", "string")).alias(name) for name in LINEUP_FIELDS]
    bad = F.when(F.col("pos").isNotNull() & ~is_object, F.coalesce(F.to_json("item"), F.lit("null"))).otherwise(F.col("broken"))
    return rows.select("channel", "listed", F.col("pos").cast("long").alias("pos"), *fields, bad.alias("bad"))


def lineup(documents: DataFrame, completed: DataFrame) -> DataFrame:
    """Programme items per channel from JSON ``items[]``; entries that are no objects are left out (see lineup_entries).

    A channel none of whose documents has a list of items falls back to its completed jobs (channel, job_id, filename).
    """
    entries = lineup_entries(documents)
    listed = entries.filter("pos IS NOT NULL AND bad IS NULL").select("channel", "pos", *LINEUP_FIELDS)
    covered = entries.filter("listed").select("channel").distinct()
    empty = F.lit("")
    fallback = completed.join(covered, "channel", "left_anti").select(
        "channel", F.lit(None).cast("long").alias("pos"), F.col("job_id").cast("string").alias("id"),
        F.regexp_replace("filename", r"\.[^.]+$", "").alias("title"), "filename", empty.alias("poster"),
        empty.alias("preview"), empty.alias("thumbnail"), F.col("job_id").cast("string").alias("job_id"))
    return listed.unionByName(fallback)


GRAM = 3


def _grams(title: str, size: int) -> Column:
    """Distinct substrings of ``size`` characters; a shorter title is its own."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - size + 1, F.lit(1))),
                                        lambda at: F.substring(title, at, F.lit(size))))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of distinct titles, not empty, the first contained in the second.

    An inner title is filed once, under the rarest of its grams; an outer one looks up all of its own, which are at most
    ``GRAM`` for each of its characters. What meets is confirmed on the titles.
    """
    grams = F.array_distinct(F.flatten(F.array(*[_grams("outer", n + 1) for n in range(GRAM)])))
    asked = outer.filter("outer <> ''").select("outer", F.explode(grams).alias("gram"))
    usual = asked.groupBy("gram").agg(F.count("*").alias("n"))
    own = inner.filter("inner <> ''").select("inner", F.explode(_grams("inner", GRAM)).alias("gram"))
    # A title one of whose grams nobody has is contained in none.
    filed = (own.join(usual, "gram", "left").groupBy("inner")
             .agg(F.min(F.struct("n", "gram")).alias("key"), F.bool_and(F.col("n").isNotNull()).alias("known"))
             .filter("known").select("inner", F.col("key.gram").alias("gram")))
    return asked.join(filed, "gram").filter(F.contains("outer", "inner")).select("inner", "outer")


def match_titles(files: DataFrame, images: DataFrame) -> DataFrame:
    """First image (by list_pos) whose title contains, or is contained in, each file's title.

    Both directions go through an index of rare grams, on one row per distinct title. An empty title is contained in every title.
    """
    wanted = files.withColumn("_title", title_key(F.col("filename")))
    titles = wanted.select("_title").distinct()
    known = (images.withColumn("_image", title_key(F.col("image")))
             .groupBy("_image").agg(F.min("list_pos").alias("_pos")))
    file_side, image_side = titles.select(F.col("_title").alias("outer")), known.select(F.col("_image").alias("inner"))
    inside = _contained(image_side, file_side).select(F.col("outer").alias("_title"), F.col("inner").alias("_image"))
    around = _contained(file_side.withColumnRenamed("outer", "inner"), image_side.withColumnRenamed("inner", "outer")).select(
        F.col("inner").alias("_title"), F.col("outer").alias("_image"))
    found = inside.unionByName(around).join(known, "_image").groupBy("_title").agg(F.min("_pos").alias("_found"))
    first = known.agg(F.min("_pos").alias("p")).select("p").scalar()
    blank = known.agg(F.min(F.when(F.col("_image") == "", F.col("_pos"))).alias("p")).select("p").scalar()
    pos = F.when(F.col("_title").isNotNull(), F.least("_found", blank, F.when(F.col("_title") == "", first)))
    return (wanted.join(found, "_title", "left").withColumn("list_pos", pos).drop("_title", "_found")
            .join(images.select("list_pos", "image"), "list_pos", "left"))

"""Visual evidence (X11-X13, J12): pictures, page renders and figure candidates as one relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import figure_label, stripped


def pictures(docs: DataFrame) -> DataFrame:
    """X11: docs (content_hash, pictures array<struct<caption,page>>) to one record a picture; good with a caption."""
    each = docs.select("content_hash", F.posexplode("pictures").alias("n", "p"))
    caption = F.nullif(F.trim(F.coalesce("p.caption", F.lit(""))), F.lit(""))
    visual_id = F.concat(F.substring("content_hash", 1, 12), F.lit(":picture:"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return each.select("content_hash", visual_id.alias("visual_id"), F.col("p.page").alias("page"), caption.alias("caption"), figure_label(caption).alias("figure_label"), F.when(caption.isNotNull(), "good").otherwise("weak").alias("readiness"))


def page_renders(docs: DataFrame) -> DataFrame:
    """One weak record a page; none without pages."""
    page = F.explode(F.sequence(F.lit(1), F.col("page_count")))
    rows = docs.where("page_count > 0").select("content_hash", "artifact_dir", page.alias("page"))
    number = F.lpad(F.col("page").cast("string"), 4, "0")
    return rows.select("content_hash", F.concat(F.substring("content_hash", 1, 12), F.lit(":page:"), number).alias("visual_id"), "page", F.concat("artifact_dir", F.lit("/visuals/pages/page_"), number, F.lit(".jpg")).alias("image_path"), F.lit("weak").alias("readiness"))


def figure_candidates(docs: DataFrame) -> DataFrame:
    """Docs (content_hash, markdown, figure_count, pictures_with_page) without placed pictures: distinct labels in order of first place.

    The page is that of the last page comment before the label (J12); the context is up to 150 characters on each side.
    """
    label = r"\b" + V.FIGURE_LABEL.replace("(?i)", "(?i:") + ")"
    rows = docs.where("figure_count > 0 AND coalesce(pictures_with_page, 0) = 0").select("content_hash", "markdown")
    # a match begins after the pieces and matches before it
    each = rows.select("content_hash", F.posexplode(F.arrays_zip(F.regexp_extract_all("markdown", F.lit(label), F.lit(0)).alias("raw"), F.split("markdown", label).alias("before"))).alias("n", "m"))
    order = W.partitionBy("content_hash").orderBy("n")
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    found = each.withColumn("at", F.sum(length("m.before")).over(order) + F.sum(length("m.raw")).over(order) - length("m.raw") + 1).where("m.raw IS NOT NULL")
    first = found.groupBy("content_hash", figure_label(F.col("m.raw")).alias("label")).agg(F.min("at").cast("int").alias("at")).join(rows, "content_hash")
    before = F.substring(F.col("markdown"), F.lit(1), F.col("at"))
    marks = F.regexp_extract_all(before, F.lit(r"(?i)<!--\s*page\s+([0-9]+)\s*-->"), F.lit(1))
    start = F.greatest(F.lit(1), F.col("at") - 150)
    context = stripped(F.substring(F.col("markdown"), start, F.col("at") + 150 - start))
    return first.select("content_hash", "label", F.try_element_at(marks, F.lit(-1)).try_cast("int").alias("page"), context.alias("nearby_text"), "at")

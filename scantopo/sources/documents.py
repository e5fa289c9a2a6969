"""Other tools' documents: region files, font lists; and our own: page records, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGION = "struct<top_left_x:double,top_left_y:double,width:double,height:double>"
LINES = f"struct<pages:array<struct<page:int,image_id:string,page_width:double,page_height:double,lines:array<struct<type:string,region:{REGION},text:string>>>>>"


def regions(docs: DataFrame, json: str, key: str) -> DataFrame:
    """(key, page, region_id, label, x0, y0, x1, y1) of the lines of region files, one JSON text to a row.

    A document without pages is an error; a page without lines has no rows."""
    d = docs.select(key, F.from_json(json, LINES).alias("d"))
    pages = F.when(F.col("d.pages").isNull(), F.raise_error(F.concat(F.lit("no pages in "), F.col(key).cast("string"))).cast(LINES[len("struct<pages:") : -1])).otherwise(F.col("d.pages"))
    p = d.select(key, F.explode(pages).alias("p"))
    return p.select(key, "p.page", F.posexplode("p.lines").alias("region_id", "l")).select(
        key, "page", "region_id", F.col("l.type").alias("label"), F.col("l.region.top_left_x").alias("x0"), F.col("l.region.top_left_y").alias("y0"),
        (F.col("l.region.top_left_x") + F.col("l.region.width")).alias("x1"), (F.col("l.region.top_left_y") + F.col("l.region.height")).alias("y1"),
    )


def fixed_width(text: DataFrame, key: str = "path") -> DataFrame:
    """(key, n, cells) of tables whose columns stand under a rule of dashes: ``text`` has key, pos and value (a line).

    The rule is the first line of dashes and spaces; cells are cut at its gaps and trimmed."""
    rule = text.filter(F.col("value").rlike(r"^-+( +-+)+\s*$")).groupBy(key).agg(F.min_by(F.struct("pos", "value"), "pos").alias("r")).select(key, F.col("r.pos").alias("at"), F.col("r.value").alias("rule"))
    words = F.regexp_extract_all("rule", F.lit("(-+ *)"), F.lit(1))
    ends = F.aggregate(words, F.array(F.lit(1)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w))))
    j = text.join(rule, key).filter((F.col("pos") > F.col("at")) & (F.trim("value") != "")).withColumns({"ends": ends, "m": F.size(words)})
    cut = F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.trim(F.substring(F.col("value"), F.element_at("ends", i), F.when(i == F.col("m"), F.length("value")).otherwise(F.element_at("ends", i + 1) - F.element_at("ends", i)))))
    return j.select(key, (F.col("pos") - F.col("at") - 1).alias("n"), cut.alias("cells"))


def points(px: Column, dpi: Column) -> Column:
    """Pixels as points of 1/72 inch; a missing resolution is an error."""
    return F.when(dpi.isNull(), F.raise_error(F.lit("no dpi")).cast("double")).otherwise(px * 72.0 / dpi)


def page_json(lines: DataFrame, version: str = "1") -> DataFrame:
    """(page_id, json): a record for each page of boxes (page_id, id, type, x0..y1, dpi, text), regions in points; fields
    that are null are absent."""
    pt = lambda c: F.bround(points(c, F.col("dpi")), 4)
    region = F.struct(pt(F.col("x0")).alias("top_left_x"), pt(F.col("y0")).alias("top_left_y"), pt(F.col("x1") - F.col("x0") + 1).alias("width"), pt(F.col("y1") - F.col("y0") + 1).alias("height"))
    line = F.struct(F.col("id"), F.col("type"), region.alias("region"), F.lit("").alias("text"))
    p = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return p.select("page_id", F.to_json(F.struct(F.col("page_id").alias("page"), F.lit(version).alias("version"), "lines"), {"ignoreNullFields": "true"}).alias("json"))


def coco_json(boxes: DataFrame) -> DataFrame:
    """(json): images, annotations and categories of boxes (page_id, id, label, x0..y1); categories are numbered in order
    of their first appearance."""
    cat = boxes.groupBy("label").agg(F.min(F.struct("page_id", "id")).alias("f"))
    cat = cat.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "label"))), lambda x, i: F.struct((i + 1).alias("id"), x["label"].alias("name"))).alias("categories"))
    box = F.array(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1)
    ann = boxes.crossJoin(F.broadcast(cat)).select("page_id", F.struct(F.col("id"), F.col("page_id").alias("image_id"), F.filter("categories", lambda c: c["name"] == F.col("label"))[0]["id"].alias("category_id"), box.alias("bbox")).alias("a"), "categories")
    return ann.groupBy("page_id").agg(F.to_json(F.struct(F.array(F.struct(F.first("page_id").alias("id"))).alias("images"), F.array_sort(F.collect_list("a")).alias("annotations"), F.first("categories").alias("categories"))).alias("json"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)

"""File sources and sinks of the pipelines: JSON lines, query lists, nested documents, pages, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_SCHEMA = "ts string, school_id bigint, school_name string, district string, type string, query string, note_id string, note_url string, title string, content string, tags array<string>, likes double, comments_count double, publish_time string, error string"
RESULT_SCHEMA = "ts string, query string, page int, rank int, title string, url string, abstract string, source string, error string"
_SCHOOL = "array<struct<`名称`:string,`梯队`:int,`片区`:string,`街道`:string,`对口初中`:string,`初中梯队`:int,`对口居委`:string,`评价`:string,`入学方式`:string,`招生班级`:int,`标签`:array<string>,lng:double,lat:double>>"
DOCUMENT_TYPE = f"map<string,struct<`区`:string,`入学制度`:string,`说明`:string,`街道`:array<string>,`小学`:{_SCHOOL},`初中`:{_SCHOOL}>>"


def json_lines(spark: SparkSession, path: str, schema: str, errors: bool = False) -> DataFrame:
    """Well-formed lines; rows that record an error only if asked for."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if errors or "error" not in rows.columns else rows.filter("error is null")


def still_to_do(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file without blanks and # comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("query"))
    return lines.filter((F.col("query") != "") & ~F.col("query").startswith("#"))


def embedded_json(page: Column, name: str = "ALL_DATA", until: str = r"\nvar ") -> Column:
    """The JSON text of ``var NAME = …`` in a page. It is parsed as data and never evaluated."""
    return F.nullif(F.regexp_extract(page, rf"(?s)var {name}\s*=\s*(\{{.*?\}})\s*;?\s*(?:{until}|</script>)", 1), F.lit(""))


def document_schools(pages: DataFrame, page: str = "html") -> DataFrame:
    """(district, stage, place, school struct) of the nested document embedded in each page."""
    districts = pages.select(F.explode(F.from_json(embedded_json(F.col(page)), DOCUMENT_TYPE)).alias("district", "d"))
    parts = [districts.select("district", F.lit(stage).alias("stage"), F.posexplode(f"d.{key}").alias("place", "school")) for stage, key in (("primary", "小学"), ("middle", "初中"))]
    return parts[0].unionByName(parts[1])


def committee_relations(schools: DataFrame) -> DataFrame:
    """One row per committee of a school, with its composite source key. A list and a single name are both taken."""
    raw = F.col("school.对口居委")
    names = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = schools.select("district", "stage", F.col("school.名称").alias("school_name"), F.posexplode(F.filter(names, lambda x: F.trim(x) != "")).alias("n", "committee_name"), F.col("school.片区").alias("area"), F.col("school.街道").alias("street"))
    return rows.withColumn("source_key", F.concat_ws(":", "district", "stage", "school_name", "n", "committee_name"))


def links(page: Column, keep: str = "", deny: str = "") -> Column:
    """(url, title) of every anchor whose text matches ``keep`` and not ``deny``, in page order."""
    anchors = F.regexp_extract_all(page, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    found = F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1).alias("url"), F.trim(F.regexp_replace(a, "<[^>]+>", "")).alias("title")))
    return F.filter(found, lambda x: (x["url"] != "") & (x["title"].rlike(keep) if keep else F.lit(True)) & (~x["title"].rlike(deny) if deny else F.lit(True)))


def feature_collection(rows: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """One GeoJSON feature a row; readers join them as one collection a file."""
    shape = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":{"type":"'), shape[0], F.lit('","coordinates":'), shape[1], F.lit("}}"))
    return rows.select(feature.alias("feature"))


def write_json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, nulls empty, nested values as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text: times in ISO form, binary values in hexadecimal."""
    made = [F.lower(F.hex(f.name)).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*made), {"ignoreNullFields": "false"}).alias("value"))

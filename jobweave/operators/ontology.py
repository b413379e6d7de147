"""The technology ontology: reading, lookup, validation."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources import schemas
from ..sources.files import exists

#: A list of entries is compiled into expressions, so their number is bounded; a table of any size serves as it is.
MOST_ENTRIES = 5000
REQUIRED = ("aliases", "category", "name", "released_year", "versions")


@dataclass(frozen=True)
class Tech:
    """A technology, when it was released, and its versions."""

    name: str
    released_year: int
    category: str = ""
    versions: dict[str, int] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array with their position; a missing file is empty, a malformed one an error.

    Years may be numbers or strings of digits; any other is an error.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.ONTOLOGY).withColumn("position", F.lit(0))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{schemas.ONTOLOGY_FILE.simpleString()}>", {"mode": "FAILFAST"}).alias("entries"))
    rows = text.select(F.posexplode("entries").alias("position", "e"))
    year = lambda c: F.when(c.isNotNull(), F.coalesce(strip(c).try_cast("int"), F.raise_error(F.concat(F.lit("no year: "), c)).cast("int")))
    versions = F.transform_values(F.coalesce("e.versions", F.create_map().cast("map<string,string>")), lambda _, v: year(v))
    return rows.select("e.name", year(F.col("e.released_year")).alias("released_year"), F.coalesce("e.category", F.lit("")).alias("category"), versions.alias("versions"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), "position")


def entries(ontology: DataFrame) -> list[Tech]:
    """The entries on the driver, in order; more than ``MOST_ENTRIES`` are refused."""
    rows = ontology.orderBy("position").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the ontology has more than {MOST_ENTRIES} entries; give the audit its table instead")
    return [Tech(r.name, r.released_year, r.category, dict(r.versions), tuple(r.aliases)) for r in rows]


def load(spark: SparkSession, path: str) -> list[Tech]:
    return entries(read(spark, path))


def keys(ontology: DataFrame) -> DataFrame:
    """key, name: names and aliases in small letters; of equal ones the last entry's."""
    each = ontology.select(F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("key"), "name", "position").where("key <> ''")
    return each.groupBy(F.lower("key").alias("key")).agg(F.max_by("name", "position").alias("name"))


def lookup(names: DataFrame, ontology: DataFrame) -> DataFrame:
    """names (column asked) with the name of the entry that each means, or null."""
    known = keys(ontology)
    return names.join(known, F.lower(names["asked"]) == known["key"], "left").drop("key")


def category_histogram(ontology: DataFrame) -> DataFrame:
    return ontology.groupBy("category").agg(F.count("*").alias("n"))


def unique_names(ontology: DataFrame) -> DataFrame:
    """One row, n: how many different names there are, in small letters."""
    return ontology.agg(F.count_distinct(F.lower("name")).alias("n"))


def duplicated(rows: DataFrame, name: str) -> DataFrame:
    """name (small letters), n of those that occur more than once."""
    return rows.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def problems(spark: SparkSession, path: str, this_year: int | None = None) -> DataFrame:
    """position, message for everything wrong with an ontology file; empty if it is sound."""
    year = F.lit(this_year or datetime.date.today().year)
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = text.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("pos").alias("position"), F.col("value").alias("e"))
    kind = lambda at: F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get("e", at, "variant")), "^[A-Z]+", 0), F.lit(""))
    text_of = lambda at: F.try_variant_get("e", at, "string")
    rows = rows.withColumns({"kind": F.regexp_extract(F.schema_of_variant("e"), "^[A-Z]+", 0)})
    rows = rows.withColumns({f"k_{n}": F.when(F.col("kind") == "OBJECT", kind(f"$.{n}")).otherwise("") for n in REQUIRED})
    present = F.when(F.col("kind") == "OBJECT", F.json_object_keys(F.to_json("e")))
    rows = rows.withColumns({"missing": F.array_except(F.array(*map(F.lit, REQUIRED)), present), "name": F.when(F.col("k_name") == "STRING", text_of("$.name"))}).withColumn("shown", F.coalesce("name", F.concat(F.lit("#"), F.col("position"))))
    message = lambda rows, *parts: rows.select("position", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message"))
    at = F.concat(F.lit("#"), F.col("position").cast("string"))
    whole = rows.where((F.col("kind") == "OBJECT") & (F.size("missing") == 0))
    named = whole.where(F.col("name").isNotNull() & (strip(F.col("name")) != ""))
    bad_year = lambda k, v: (k != "BIGINT") | v.isNull() | (v < 1900) | (v > year)
    released = F.try_variant_get("e", "$.released_year", "bigint")
    listed = named.where("k_aliases = 'ARRAY'")
    versions = named.where("k_versions = 'OBJECT'").select("position", "shown", F.explode(F.from_json(F.to_json(F.try_variant_get("e", "$.versions", "variant")), "map<string,string>")).alias("version", "value"))
    number = F.col("value").try_cast("bigint")
    aliases = listed.select("position", "name", F.posexplode(F.from_json(F.to_json(F.try_variant_get("e", "$.aliases", "variant")), "array<string>")).alias("turn", "alias"))
    sound = aliases.where(F.col("alias").isNotNull() & (strip(F.col("alias")) != "") & (F.lower("alias") != F.lower("name")))
    shared = sound.groupBy(F.lower("alias").alias("alias")).agg(F.array_sort(F.collect_set("name")).alias("names"), F.max("position").alias("position")).where("size(names) > 1")
    again = duplicated(named, "name")
    found = [
        message(rows.where("kind <> 'OBJECT'"), at, ": not an object"),
        message(rows.where((F.col("kind") == "OBJECT") & (F.size("missing") > 0)), at, ": missing ", F.array_join("missing", ", ")),
        message(whole.where(F.col("name").isNull() | (strip(F.col("name")) == "")), at, ": empty name"),
        message(named.where(bad_year(F.col("k_released_year"), released)), F.col("shown"), ": bad released_year"),
        message(named.where("k_versions <> 'OBJECT'"), F.col("shown"), ": versions must be an object"),
        message(versions.where(number.isNull() | (number < 1900) | (number > year)), F.col("shown"), " ", F.col("version"), ": bad version year"),
        message(named.where((F.col("k_category") != "STRING") | (text_of("$.category") == "")), F.col("shown"), ": empty category"),
        message(named.where("k_aliases <> 'ARRAY'"), F.col("shown"), ": aliases must be a list"),
        message(aliases.where(F.col("alias").isNull() | (strip(F.col("alias")) == "")), F.col("name"), ": bad alias"),
        message(shared, "alias ", F.col("alias"), " claimed by ", F.array_join("names", ", ")),
        message(again.withColumn("position", F.lit(-1)), "duplicate name ", F.col("name"), " x", F.col("n").cast("string")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

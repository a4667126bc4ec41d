"""Registry snapshots: JSON documents as the registries serve them, one per package.

A snapshot row is ``(registry, name, doc, lookup_status, lookup_error)``. The status is
``found``, ``not_found`` or ``error``; a row without a document is never ``found``. A
registry and name occur once. Names without a row do not exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repoaudit.functions import times
from repoaudit.schemas import REGISTRY_DOCS

# Only these parts of a document are parsed. Maps and VARIANT tell an absent key from a
# JSON null: the first takes the default, the second stays null.
_PYPI_DOC = (
    "info MAP<STRING, STRING>, "
    "releases MAP<STRING, ARRAY<STRUCT<upload_time_iso_8601: STRING>>>"
)
_NPM_DOC = (
    "name VARIANT, description VARIANT, author VARIANT, license VARIANT, "
    "`dist-tags` MAP<STRING, STRING>, time MAP<STRING, STRING>, "
    "versions MAP<STRING, STRUCT<author: VARIANT, license: VARIANT>>"
)

_META = [
    "registry", "name", "exists", "reported_name", "version", "summary", "author",
    "home_page", "license", "created_date", "created_at", "release_count",
    "lookup_status", "lookup_error",
]


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored snapshot; ``fmt`` may be ``json`` for JSON lines."""
    return spark.read.format(fmt).schema(REGISTRY_DOCS).load(path)


def _status(doc: Column) -> Column:
    return F.when(doc.isNull() & (F.col("lookup_status") == "found"), "not_found").otherwise(
        F.coalesce(F.col("lookup_status"), F.lit("not_found"))
    )


def _key_or(values: Column, key: str, default: Column) -> Column:
    """Value of a key, which may be null, or the default if the key is absent."""
    present = F.coalesce(F.map_contains_key(values, key), F.lit(False))
    return F.when(present, values[key]).otherwise(default)


def _variant_or(value: Column, default: Column) -> Column:
    return F.when(value.isNull(), default).when(F.is_variant_null(value), None).otherwise(
        value.cast("string")
    )


def parse_pypi(docs: DataFrame) -> DataFrame:
    """Metadata of the Python packages in a snapshot."""
    own = docs.where("registry = 'pypi'").withColumn("lookup_status", _status(F.col("doc")))
    rows = own.withColumn("_json", F.from_json("doc", _PYPI_DOC))
    info, unknown, empty = F.col("_json.info"), F.lit("unknown"), F.lit("")
    uploads = F.transform(
        F.filter(
            F.flatten(F.filter(F.map_values("_json.releases"), lambda files: files.isNotNull())),
            lambda f: f["upload_time_iso_8601"].isNotNull(),
        ),
        lambda f, i: F.struct(
            times.parse_offset_time(f["upload_time_iso_8601"]).alias("at"),
            i.alias("ord"),
            f["upload_time_iso_8601"].alias("text"),
        ),
    )
    first = F.array_min(F.filter(uploads, lambda u: u["at"].isNotNull()))
    rows = rows.withColumn("_first", first)
    return rows.select(
        "registry",
        "name",
        (F.col("lookup_status") == "found").alias("exists"),
        _key_or(info, "name", F.col("name")).alias("reported_name"),
        _key_or(info, "version", unknown).alias("version"),
        _key_or(info, "summary", empty).alias("summary"),
        _key_or(info, "author", unknown).alias("author"),
        _key_or(info, "home_page", empty).alias("home_page"),
        _key_or(info, "license", unknown).alias("license"),
        times.iso_text(F.col("_first.text")).alias("created_date"),
        F.col("_first.at").alias("created_at"),
        F.coalesce(F.size(F.map_keys("_json.releases")), F.lit(0)).alias("release_count"),
        "lookup_status",
        "lookup_error",
    ).select(*_META)


def _falsy(value: Column) -> Column:
    """Whether a JSON value is absent, null, empty, zero or false."""
    as_text = value.cast("string")
    return value.isNull() | F.is_variant_null(value) | as_text.isin("", "{}", "[]", "0", "false")


def _author(version_author: Column, doc_author: Column) -> Column:
    """Author of the version, or else of the document; objects give their name."""
    chosen = F.when(~_falsy(version_author), version_author).otherwise(doc_author)
    kind = F.schema_of_variant(chosen)
    name = F.try_variant_get(chosen, "$.name", "variant")
    from_object = _variant_or(name, F.lit("unknown"))
    return (
        F.when(chosen.isNull(), "unknown")
        .when(F.is_variant_null(chosen), "None")
        .when(kind.startswith("OBJECT"), from_object)
        .otherwise(chosen.cast("string"))
    )


def parse_npm(docs: DataFrame) -> DataFrame:
    """Metadata of the JavaScript packages in a snapshot."""
    own = docs.where("registry = 'npm'").withColumn("lookup_status", _status(F.col("doc")))
    rows = own.withColumn("_json", F.from_json("doc", _NPM_DOC))
    rows = rows.withColumn("latest", _key_or(F.col("_json.dist-tags"), "latest", F.lit("unknown")))
    current = F.try_element_at(F.col("_json.versions"), F.col("latest"))
    rows = rows.withColumn("_current", current)
    license_ = F.coalesce(F.col("_current.license"), F.col("_json.license"))
    created = F.try_element_at(F.col("_json.time"), F.lit("created"))
    return rows.select(
        "registry",
        "name",
        (F.col("lookup_status") == "found").alias("exists"),
        _variant_or(F.col("_json.name"), F.col("name")).alias("reported_name"),
        F.col("latest").alias("version"),
        _variant_or(F.col("_json.description"), F.lit("")).alias("summary"),
        _author(F.col("_current.author"), F.col("_json.author")).alias("author"),
        F.lit(None).cast("string").alias("home_page"),
        _variant_or(license_, F.lit("unknown")).alias("license"),
        created.alias("created_date"),
        times.parse_offset_time(created).alias("created_at"),
        F.coalesce(F.size(F.map_keys("_json.versions")), F.lit(0)).alias("release_count"),
        "lookup_status",
        "lookup_error",
    ).select(*_META)


def parse_snapshot(docs: DataFrame) -> DataFrame:
    """Metadata of every package in a snapshot, ready to be joined or stored."""
    return parse_pypi(docs).unionByName(parse_npm(docs))

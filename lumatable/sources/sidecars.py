"""Sidecar, look and manifest files in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema as S

_CORRUPT = "_corrupt"


def read_sidecars(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """One row per sidecar: a document per file or, with ``per_file`` false, per line.

    Unreadable ones keep their text in ``_corrupt``.
    """
    schema = T.StructType([*S.SIDECAR.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return (
        spark.read.text(path, wholetext=per_file)
        .select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema, options).alias("doc"))
        .select("file", "doc.*")
    )


def write_sidecars(sidecars: DataFrame, path: str, per_file: bool = False) -> None:
    """JSON, one line per photo; never replaces existing files.

    ``per_file`` writes a pretty document per photo into a folder ``photo=<path>`` of its own, for
    exports of a few; a large library would become as many tiny files.
    """
    fields = S.SIDECAR.fieldNames()
    if per_file:
        rows = sidecars.select(
            F.to_json(F.struct(*fields), {"pretty": "true"}).alias("value"), F.col("source.path").alias("photo")
        )
        rows.write.mode("errorifexists").option("maxRecordsPerFile", 1).partitionBy("photo").text(path)
    else:
        sidecars.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("errorifexists").text(path)


def sidecar_recipes(sidecars: DataFrame, library: DataFrame) -> DataFrame:
    """Full recipes from readable sidecars, matched to the library by content hash.

    The ten stored keys replace the neutral ones. A stored temperature of 0 is the neutral 6500 K;
    the files don't say what other values mean, so they are read as the distance from it, the way
    ``sidecar_rows`` writes them, and ``temperature_assumed`` is true. Sidecars without a photo keep
    a row with a null ``image_id``.
    """
    stored = sidecars.filter(F.col("globalAdjustments").isNotNull()).select(
        F.col("source.contentHash").alias("content_hash"), F.col("source.path").alias("sidecar_path"), "globalAdjustments"
    )
    names = {("exposureEv" if k == "exposure" else k): k for k in S.KEYS}
    value = {names[k]: F.col(f"globalAdjustments.{k}").cast("double") for k in S.SIDECAR_KEYS}
    away = value["temperature"]
    value["temperature"] = away + 6500.0
    out = stored.join(library.select("image_id", "content_hash"), "content_hash", "left")
    return out.select(
        "image_id", "sidecar_path",
        *[F.coalesce(value[k], F.lit(v)).alias(k) if k in value else F.lit(v).alias(k) for k, v in S.ADJUSTMENT_DEFAULTS.items()],
        F.coalesce(away != 0, F.lit(False)).alias("temperature_assumed"),
    )


def sidecar_rows(recipes: DataFrame, identities: DataFrame, engine_version: str = "0.1.0") -> DataFrame:
    """The ten-key subset of full recipes, joined to the identity of their source file.

    Sidecars store no Kelvin: temperature is written as 0 for the neutral 6500 and otherwise as
    the distance from it.
    """
    value = lambda k: F.col("exposure") if k == "exposureEv" else (
        F.col("temperature") - 6500.0 if k == "temperature" else F.col(k)
    )
    return recipes.join(identities, "image_id").select(
        F.lit(1).alias("schemaVersion"),
        F.lit(engine_version).alias("engineVersion"),
        F.struct(
            "path", F.col("content_hash").alias("contentHash"), F.col("byte_length").alias("byteLength")
        ).alias("source"),
        F.struct(*[value(k).cast("float").alias(k) for k in S.SIDECAR_KEYS]).alias("globalAdjustments"),
        F.expr("cast(array() as array<struct<id:string,name:string,enabled:boolean>>)").alias("masks"),
    )


def read_fixture_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per fixture and purpose."""
    schema = (
        "schemaVersion int, fixtures array<struct<id:string, path:string, kind:string, "
        "license:string, purpose:array<string>, private:boolean>>"
    )
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    f = doc.select("schemaVersion", F.explode("fixtures").alias("f")).select("schemaVersion", "f.*")
    return f.withColumn("purpose", F.explode_outer("purpose"))


# --- conformance ------------------------------------------------------------

# Rules per document kind: (field, required, type, minimum, maximum, allowed values).
_RULES = {
    "project": [
        ("schemaVersion", True, "integer", 1, None, None),
        ("engineVersion", False, "string", None, None, None),
        ("source", True, "object", None, None, None),
        ("source.path", True, "string", None, None, None),
        ("source.contentHash", True, "string", None, None, None),
        ("globalAdjustments", True, "object", None, None, None),
        ("masks", True, "array", None, None, None),
        ("ai", False, "object", None, None, None),
    ],
    "look": [
        ("schemaVersion", True, "integer", 1, None, None),
        ("name", True, "string", None, None, None),
        ("author", False, "string", None, None, None),
        ("engineCompatibility", True, "string", None, None, None),
        ("defaultAmount", False, "number", 0, 1, None),
        ("protectedCategories", False, "array", None, None, None),
        ("parameters", True, "object", None, None, None),
    ],
    "model": [
        ("modelId", True, "string", None, None, None),
        ("version", True, "string", None, None, None),
        ("sha256", True, "string", None, None, None),
        ("format", True, "string", None, None, ["onnx"]),
        ("task", True, "string", None, None, None),
        ("licenseId", True, "string", None, None, None),
        ("precisionModes", False, "array", None, None, None),
        ("tile", False, "object-or-null", None, None, None),
    ],
}
# Array fields whose items must be strings.
_STRING_ITEMS = {"look": ["protectedCategories"], "model": ["precisionModes"]}


def _kind(v: Column) -> Column:
    """JSON type name of a variant; integer and number are told apart by value."""
    t = F.schema_of_variant(v)
    return (
        F.when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | (t == "DOUBLE"), "number")
        .when(t == "BOOLEAN", "boolean")
        .otherwise("null")
    )


def conformance_report(documents: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """One row per violated rule of each JSON document.

    ``documents``: id columns plus the raw JSON text. Unparsable text gives the single violation
    ``json``. Integers written with a zero fraction count as integers.
    """
    ids = [c for c in documents.columns if c != text]
    docs = documents.withColumn("_v", F.try_parse_json(F.col(text)))
    found = [F.when(F.col("_v").isNull(), F.struct(F.lit("json").alias("field"), F.lit("syntax").alias("rule")))]
    root_is_object = _kind(F.col("_v")) == "object"
    found.append(
        F.when(F.col("_v").isNotNull() & ~root_is_object,
               F.struct(F.lit("$").alias("field"), F.lit("type").alias("rule")))
    )
    for field, required, type_, lo, hi, allowed in _RULES[kind]:
        hit = lambda rule: F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"))
        v = F.try_variant_get("_v", f"$.{field}", "variant")
        # a missing key reads as SQL null, a JSON null as a variant null
        absent = v.isNull()
        parent = field.rpartition(".")[0]
        present_parent = (
            _kind(F.try_variant_get("_v", f"$.{parent}", "variant")) == "object" if parent else root_is_object
        )
        k = _kind(v)
        number = F.try_variant_get("_v", f"$.{field}", "double")
        whole = (k == "integer") | ((k == "number") & (number == F.floor(number)))
        ok = {
            "integer": whole,
            "number": k.isin("integer", "number"),
            "object-or-null": k.isin("object", "null"),
        }.get(type_, k == type_)
        if required:
            found.append(F.when(present_parent & absent, hit("required")))
        found.append(F.when(present_parent & ~absent & ~ok, hit("type")))
        if lo is not None:
            found.append(F.when(present_parent & ~absent & ok & (number < lo), hit("minimum")))
        if hi is not None:
            found.append(F.when(present_parent & ~absent & ok & (number > hi), hit("maximum")))
        if allowed:
            value = F.try_variant_get("_v", f"$.{field}", "string")
            found.append(F.when(present_parent & ~absent & ok & ~value.isin(allowed), hit("enum")))
    for field in _STRING_ITEMS.get(kind, []):
        items = F.try_variant_get("_v", f"$.{field}", "array<variant>")
        found.append(
            F.when(
                F.coalesce(F.exists(items, lambda i: _kind(i) != "string"), F.lit(False)),
                F.struct(F.lit(field).alias("field"), F.lit("items").alias("rule")),
            )
        )
    violations = F.array_compact(F.array(*found))
    return docs.select(*ids, F.explode(violations).alias("e")).select(*ids, "e.field", "e.rule")


def conformance_levels(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per project document: does it meet the schema, and can it be loaded.

    Loading also needs the byte length of the source and the engine version.
    """
    ids = [c for c in documents.columns if c != text]
    bad = conformance_report(documents, "project", text).groupBy(*ids).agg(F.count("*").alias("violations"))
    v = F.try_parse_json(F.col(text))
    loadable = F.try_variant_get(v, "$.source.byteLength", "bigint").isNotNull() & F.try_variant_get(
        v, "$.engineVersion", "string"
    ).isNotNull()
    docs = documents.select(*ids, F.coalesce(loadable, F.lit(False)).alias("_load"))
    n = F.coalesce("violations", F.lit(0))
    return docs.join(bad, ids, "left").select(
        *ids, n.alias("violations"), (n == 0).alias("schema_valid"), ((n == 0) & F.col("_load")).alias("loadable")
    )

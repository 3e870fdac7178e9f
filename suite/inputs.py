"""Photo tables derived from the given tables, once for Spark and once as DuckDB CTEs.

Integer arithmetic keeps both sides identical. ``part`` stands for the photo library,
``events`` for the edit log, ``embeddings`` for small grey frames, ``documents`` for files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumatable import schema as S
from lumatable.plans.session import spread, tune
from lumatable.sources.files import file_hash

NEUTRAL = "p_partkey % 5 = 0"


def _d(expr):
    return f"CAST({expr} AS DOUBLE)"


# value of each key for photos that are not neutral (pk = p_partkey, sz = p_size)
RECIPE_RULES = {
    "exposure": f"{_d('p_size % 11 - 5')} / 2e0",
    "contrast": f"{_d('p_partkey % 9 - 4')} * 10e0",
    "highlights": f"{_d('p_partkey % 8 - 3')} * 20e0",
    "shadows": f"{_d('p_size % 7 - 3')} * 25e0",
    "whites": f"{_d('p_partkey % 6 - 2')} * 15e0",
    "blacks": f"{_d('p_size % 5 - 2')} * 20e0",
    "temperature": f"6500e0 + {_d('p_partkey % 7 - 3')} * 500e0",
    "tint": f"{_d('p_size % 9 - 4')} * 8e0",
    "vibrance": f"{_d('p_partkey % 11 - 5')} * 12e0",
    "saturation": f"{_d('p_partkey % 13 - 6')} * 10e0",
    "sharpness": f"{_d('p_partkey % 3 - 1')} * 60e0",
    "clarity": f"{_d('p_size % 3 - 1')} * 40e0",
    "noiseReduction": f"CASE WHEN p_partkey % 2 = 0 THEN 0e0 ELSE {_d('p_size % 4 - 1')} * 30e0 END",
    "maskExposure": f"{_d('p_partkey % 5 - 2')} * 0.5e0",
    "maskFeather": f"{_d('p_partkey % 11')} * 10e0",
    "vignette": f"{_d('p_size % 5 - 2')} * 25e0",
    "lensBrightness": f"{_d('p_partkey % 10 - 4')} * 10e0",
    "rotation": f"CASE WHEN p_partkey % 17 = 3 THEN 33e0 ELSE {_d('p_partkey % 4 - 1')} * 90e0 END",
    "flipHorizontal": _d("p_size % 2"),
    "flipVertical": "CASE WHEN p_partkey % 6 = 1 THEN 1e0 ELSE 0e0 END",
}

MASK_RULES = {
    "x": f"0.3e0 + {_d('p_partkey % 5')} * 0.1e0",
    "y": f"0.4e0 + {_d('p_size % 3')} * 0.1e0",
    "width": f"0.42e0 + {_d('p_size % 3')} * 0.1e0",
    "height": f"0.42e0 + {_d('p_partkey % 3')} * 0.15e0",
    "rotation": f"{_d('p_partkey % 8')} * 15e0",
}
MASK_NEUTRAL = "(p_partkey % 5 = 0 AND p_partkey % 15 <> 0)"

_BASE = [("black", "0e0", "0e0"), ("shadow", "0.25e0", "0.25e0"), ("midtone", "0.5e0", "0.5e0"),
         ("highlight", "0.75e0", "0.75e0"), ("white", "1e0", "1e0")]
_EXTRA = _BASE + [("extra", "0.6e0", "0.6e0")]
_LIFT = [p if p[0] != "midtone" else ("midtone", "0.5e0", "0.625e0") for p in _BASE]
_SCURVE = [("white", "1e0", "0.95e0"), ("black", "0e0", "0.05e0"), ("shadow", "0.25e0", "0.15e0"),
           ("highlight", "0.75e0", "0.875e0"), ("extra", "0.4e0", "0.375e0"),
           ("midtone", "0.5e0", "0.5e0")]
_SHORT = [("black", "0.1e0", "0e0"), ("white", "0.9e0", "1e0")]


def _points(points, dialect):
    if dialect == "spark":
        body = ", ".join(f"named_struct('id','{i}','x',{x},'y',{y})" for i, x, y in points)
        return f"array({body})"
    return "[" + ", ".join(f"{{'id':'{i}','x':{x},'y':{y}}}" for i, x, y in points) + "]"


def curve_rule(dialect):
    p = lambda pts: _points(pts, dialect)
    return (
        f"CASE WHEN p_partkey % 25 = 0 THEN {p(_EXTRA)} WHEN {NEUTRAL} THEN {p(_BASE)} "
        f"WHEN p_partkey % 4 = 1 THEN {p(_LIFT)} WHEN p_partkey % 4 = 2 THEN {p(_SCURVE)} "
        f"WHEN p_partkey % 8 = 3 THEN {p(_SHORT)} ELSE {p(_BASE)} END"
    )


def mask_rule(dialect):
    fields = {
        k: f"CASE WHEN {MASK_NEUTRAL} THEN {S.MASK_DEFAULTS[k]}e0 ELSE {v} END"
        for k, v in MASK_RULES.items()
    }
    if dialect == "spark":
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def recipe_columns(dialect):
    cols = ["p_partkey AS image_id"] + [
        f"CASE WHEN {NEUTRAL} THEN {S.ADJUSTMENT_DEFAULTS[k]}e0 ELSE {v} END AS {k}"
        for k, v in RECIPE_RULES.items()
    ]
    return cols + [f"{curve_rule(dialect)} AS curve", f"{mask_rule(dialect)} AS mask"]


PHOTO_COLUMNS = [
    "p_partkey AS image_id",
    "p_name AS name",
    "CAST(12 + p_size % 5 AS INT) AS width",
    "CAST(10 + p_partkey % 7 AS INT) AS height",
    "CAST(p_size % 6 AS INT) AS rating",
    "p_partkey % 3 = 0 AS imported",
    "CAST(floor(p_partkey / 100) AS BIGINT) AS import_batch",
    "p_partkey % 100 AS import_pos",
]
BYTE_COLUMNS = [
    "CAST((image_id*31 + x*17 + y*7 + rating*13) % 256 AS INT) AS r",
    "CAST((image_id*11 + x*5 + y*23 + rating*7) % 256 AS INT) AS g",
    "CAST((image_id*3 + x*29 + y*13 + rating*19) % 256 AS INT) AS b",
    "CAST(255 AS INT) AS a",
]
_LOG_SHARED = [
    "user_id AS photo_id",
    "event_id AS seq",
    "CAST(ts AS TIMESTAMP) AS ts",
]


# --- Spark ------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def photos(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*PHOTO_COLUMNS)


def recipes(spark, sf, keys=None) -> DataFrame:
    """Recipes, dealt out like the pixels: a small file is a single split."""
    part = table(spark, sf, "part")
    df = spread(part, "p_partkey", rows=part.count()).selectExpr(*recipe_columns("spark"))
    return df if keys is None else df.select("image_id", *keys)


def library(spark, sf) -> DataFrame:
    """Photos together with their recipe columns."""
    cols = PHOTO_COLUMNS + recipe_columns("spark")[1:]
    return table(spark, sf, "part").selectExpr(*cols)


def pixels(spark, sf) -> DataFrame:
    """One row per pixel. A small file is a single split, so photos are spread out first."""
    base = photos(spark, sf).select("image_id", "width", "height", "rating")
    return (
        spread(base, "image_id", rows=base.count())
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
        .selectExpr("image_id", "x", "y", *BYTE_COLUMNS)
    )


def edit_log(spark, sf) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    return table(spark, sf, "events").selectExpr(*_LOG_SHARED, *log_columns(k))


def log_columns(k):
    return [
        "CASE event_type WHEN 'click' THEN 'commit' WHEN 'view' THEN 'drag' "
        "WHEN 'signup' THEN 'reset' WHEN 'error' THEN 'undo' ELSE 'redo' END AS action",
        f"CASE {k} % 4 WHEN 0 THEN 'exposure' WHEN 1 THEN 'contrast' "
        "WHEN 2 THEN 'temperature' ELSE 'saturation' END AS key",
        "CAST(floor(value) AS DOUBLE) AS value",
    ]


def frames(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .selectExpr("vec_id AS image_id", "posexplode(embedding) AS (pos, e)")
        .selectExpr(
            "image_id",
            "CAST(pos % 8 AS INT) AS x",
            "CAST(floor(pos / 8) AS INT) AS y",
            "CAST(floor(least(1e0, greatest(0e0, CAST(e AS DOUBLE) + 0.5e0)) * 255e0 + 0.5e0)"
            " AS INT) AS v",
        )
    )


def manifest(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "concat('doc/', doc_id) AS path", "cast(text as binary) AS content",
        "CAST(octet_length(text) AS BIGINT) AS byte_length",
    ).select("path", file_hash("content").alias("content_hash"), "byte_length")


# --- DuckDB -----------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS INT)"
CTES = {
    "photos": f"SELECT {', '.join(PHOTO_COLUMNS)} FROM part",
    "recipes": f"SELECT {', '.join(recipe_columns('duckdb'))} FROM part",
    "library": f"SELECT {', '.join(PHOTO_COLUMNS + recipe_columns('duckdb')[1:])} FROM part",
    "pixels": (
        "SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, "
        f"{', '.join(BYTE_COLUMNS)} FROM (SELECT {', '.join(PHOTO_COLUMNS)} FROM part), "
        "range(0,17) tx(x), range(0,17) ty(y) WHERE x < width AND y < height"
    ),
    "edit_log": f"SELECT {', '.join(_LOG_SHARED + log_columns(_K))} FROM events",
    "frames": (
        "SELECT vec_id AS image_id, CAST((i-1) % 8 AS INT) AS x, "
        "CAST(floor((i-1) / 8) AS INT) AS y, CAST(floor(least(1e0, greatest(0e0, "
        "CAST(embedding[i] AS DOUBLE) + 0.5e0)) * 255e0 + 0.5e0) AS INT) AS v "
        "FROM embeddings, range(1,65) t(i)"
    ),
    "manifest": (
        "SELECT concat('doc/', doc_id) AS path, sha256(text) AS content_hash, "
        "CAST(octet_length(encode(text)) AS BIGINT) AS byte_length FROM documents"
    ),
}


def with_ctes(names, body: str, recursive=False) -> str:
    """``WITH`` prefix for the named inputs; ``body`` may start with further CTEs (``, c AS``)."""
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body}"

"""Catalogue queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.functions.numeric import normalize_angle as wrap
from lumatable.operators import catalog as C
from lumatable.sources.renditions import rendition_name
from lumatable.sources.sidecars import conformance_report as report

from . import inputs as I

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# edit flags in SQL, from the same tables
_ADJ = " OR ".join(f"{k} <> {v}e0" for k, v in S.ADJUSTMENT_DEFAULTS.items())
_CUR = f"(len(curve) <> {len(S.CURVE_DEFAULT)} OR " + " OR ".join(
    f"abs(curve[{i + 1}].{a} - {v}e0) > 1e-4"
    for i, (_, x, y) in enumerate(S.CURVE_DEFAULT)
    for a, v in (("x", x), ("y", y))
) + ")"
_MSK = "(" + " OR ".join(f"abs(mask.{k} - {v}e0) > 1e-4" for k, v in S.MASK_DEFAULTS.items()) + ")"
_EDITED = f"({_ADJ} OR {_CUR} OR {_MSK})"
_COUNT = " + ".join(
    [f"CAST({k} <> {v}e0 AS INT)" for k, v in S.ADJUSTMENT_DEFAULTS.items()]
    + [f"CAST({_CUR} AS INT)", f"CAST({_MSK} AS INT)"]
)


def _lib(body):
    return I.with_ctes(["library"], " " + body)


@register("source_identity", I.with_ctes(["manifest"], " SELECT path, content_hash, byte_length FROM manifest"))
def source_identity(spark, sf):
    return I.manifest(spark, sf)


@register(
    "verify_unchanged",
    I.with_ctes(
        ["manifest"],
        """, rescan AS (SELECT CASE WHEN doc_id % 23 = 0 THEN concat('new/', doc_id) ELSE concat('doc/', doc_id) END AS path,
          sha256(CASE WHEN doc_id % 10 = 0 THEN concat(text, 'x') ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0)
        SELECT coalesce(m.path, r.path) AS path, CASE WHEN m.path IS NULL THEN 'new' WHEN r.path IS NULL THEN 'missing'
          WHEN m.content_hash = r.h THEN 'unchanged' ELSE 'changed' END AS status
        FROM manifest m FULL JOIN rescan r ON m.path = r.path""",
    ),
)
def verify_unchanged(spark, sf):
    # the second scan sees some files changed, some renamed and some gone
    docs = I.table(spark, sf, "documents").filter("doc_id % 17 <> 0")
    rescan = docs.selectExpr(
        "CASE WHEN doc_id % 23 = 0 THEN concat('new/', doc_id) ELSE concat('doc/', doc_id) END AS path",
        "sha2(CASE WHEN doc_id % 10 = 0 THEN concat(text, 'x') ELSE text END, 256) AS content_hash",
    )
    return C.verify_unchanged(I.manifest(spark, sf), rescan)


@register("smart_album", _lib(" UNION ALL ".join(
    f"SELECT '{a}' AS album, image_id, name FROM library WHERE {p}"
    for a, p in (("all", "TRUE"), ("recent", "imported"), ("five-star", "rating = 5"), ("edited", _EDITED))
)))
def smart_album(spark, sf):
    lib = I.library(spark, sf)
    out = None
    for album in C.ALBUMS:
        part = C.smart_album(lib, album).select(F.lit(album).alias("album"), "image_id", "name")
        out = part if out is None else out.unionByName(part)
    return out


@register("album_counts", _lib(
    'SELECT count(*) AS "all", count(*) FILTER (WHERE imported) AS recent, '
    f"count(*) FILTER (WHERE rating = 5) AS five, count(*) FILTER (WHERE {_EDITED}) AS edited FROM library"
))
def album_counts(spark, sf):
    return C.album_counts(I.library(spark, sf))


@register("album_head", _lib(
    "SELECT DISTINCT ON (rating) rating, image_id, name FROM library WHERE imported "
    "ORDER BY rating, import_batch DESC, import_pos"
))
def album_head(spark, sf):
    return C.album_head(I.library(spark, sf), "recent", by=["rating"])


@register("edit_flags", _lib(
    f"SELECT image_id, ({_ADJ}) AS has_adjustments, {_CUR} AS has_curve_edits, {_MSK} AS has_mask_edits, "
    f"{_EDITED} AS is_edited FROM library"
))
def edit_flags(spark, sf):
    return C.edit_flags(I.library(spark, sf)).select(
        "image_id", "has_adjustments", "has_curve_edits", "has_mask_edits", "is_edited"
    )


@register("count_edits", _lib(f"SELECT image_id, CAST({_COUNT} AS INT) AS n_edits FROM library"))
def count_edits(spark, sf):
    return C.edit_flags(I.library(spark, sf)).select("image_id", "n_edits")


@register("toggle_rating", _lib(
    "SELECT image_id, CAST(CASE WHEN rating = 5 THEN 0 ELSE 5 END AS INT) AS rating FROM library"
))
def toggle_rating(spark, sf):
    return C.toggle_rating(I.photos(spark, sf)).select("image_id", "rating")


@register("library_order", _lib(
    "SELECT image_id, import_batch, import_pos FROM library ORDER BY import_batch DESC, import_pos"
))
def library_order(spark, sf):
    return (
        I.photos(spark, sf).orderBy(*C.library_order()).select("image_id", "import_batch", "import_pos")
    )


@register("remove_photos", I.with_ctes(
    ["photos"],
    """, l AS (SELECT *, nullif(image_id % 40, 11) AS library_id, (image_id % 3 = 0 OR image_id % 40 = 7) AS gone FROM photos)
    SELECT image_id, coalesce(library_id, -1) AS library_id FROM l QUALIFY NOT gone OR bool_and(gone) OVER (PARTITION BY library_id)""",
))
def remove_photos(spark, sf):
    lib = I.photos(spark, sf).withColumn("library_id", F.expr("nullif(image_id % 40, 11)"))  # 11: no library
    ids = lib.filter("image_id % 3 = 0 OR library_id = 7").select("image_id")
    return C.remove_photos(lib, ids).select("image_id", F.coalesce("library_id", F.lit(-1).cast("long")).alias("library_id"))


# typed-in values: some out of range, some not a number
def _typed(k, nan):
    return (
        f"CASE WHEN p_partkey % 7 = 3 THEN {nan} WHEN p_partkey % 11 = 4 THEN ({I.RECIPE_RULES[k]}) * 9e0 + 150e0 "
        f"ELSE {I.RECIPE_RULES[k]} END"
    )


# a typed mask and curve: some fields out of range, some not a number
def _typed_mask(nan):
    return {
        "x": f"CASE WHEN p_partkey % 8 = 1 THEN {nan} ELSE CAST(p_partkey % 7 - 2 AS DOUBLE) / 2e0 END",
        "y": "CAST(p_size % 5 AS DOUBLE) / 4e0", "width": f"CASE WHEN p_size % 9 = 4 THEN {nan} ELSE 0.5e0 END",
        "height": "0.25e0", "rotation": "CAST(p_partkey % 11 - 5 AS DOUBLE) * 50e0",
    }


def _typed_y(nan):
    return f"CASE WHEN p_partkey % 9 = 2 THEN {nan} ELSE CAST(p_size % 7 - 1 AS DOUBLE) / 4e0 END"


def _sanitized():
    cols, clamped, ignored = [], [], []
    for k, (lo, hi) in S.ADJUSTMENT_RANGES.items():
        v = f"t_{k}"
        cols.append(
            f"CASE WHEN isnan({v}) THEN c.{k} ELSE least({hi}e0, greatest({lo}e0, {v})) END AS {k}"
        )
        clamped.append(f"CASE WHEN NOT isnan({v}) AND ({v} < {lo}e0 OR {v} > {hi}e0) THEN '{k}' END")
        ignored.append(f"CASE WHEN isnan({v}) THEN '{k}' END")
    for f, (lo, hi) in S.MASK_RANGES.items():
        v = f"m_{f}"
        cols.append(f"CASE WHEN isnan({v}) THEN c.mask.{f} ELSE least({hi}e0, greatest({lo}e0, {v})) END AS mask_{f}")
        clamped.append(f"CASE WHEN NOT isnan({v}) AND ({v} < {lo}e0 OR {v} > {hi}e0) THEN 'mask.{f}' END")
        ignored.append(f"CASE WHEN isnan({v}) THEN 'mask.{f}' END")
    cols.append("CASE WHEN isnan(y) THEN len(c.curve) ELSE 3 END::INTEGER AS n_points")
    cols.append("CASE WHEN isnan(y) THEN c.curve[2].y ELSE least(1e0, greatest(0e0, y)) END AS second_y")
    ignored.append("CASE WHEN isnan(y) THEN 'curve' END")
    joined = lambda rows: f"array_to_string(list_filter([{', '.join(rows)}], lambda k: k IS NOT NULL), ',')"
    nan = "CAST('nan' AS DOUBLE)"
    more = ", ".join(f"{v} AS m_{f}" for f, v in _typed_mask(nan).items()) + f", {_typed_y(nan)} AS y"
    typed = ", ".join(_typed(k, "CAST('nan' AS DOUBLE)") + f" AS t_{k}" for k in S.KEYS)
    return I.with_ctes(
        ["recipes"],
        f", typed AS (SELECT p_partkey AS image_id, {typed}, {more} FROM part) "
        f"SELECT t.image_id, {', '.join(cols)}, {joined(clamped)} AS clamped_keys, {joined(ignored)} AS ignored_keys "
        "FROM typed t JOIN recipes c ON t.image_id = c.image_id",
    )


@register("sanitize_recipe", _sanitized())
def sanitize_recipe(spark, sf):
    nan = "double('NaN')"
    mask = ", ".join(f"'{f}', {v}" for f, v in _typed_mask(nan).items())
    curve = ", ".join(
        f"named_struct('id', '{i}', 'x', {x}, 'y', {y})"
        for i, x, y in (("black", "0.2e0", "0e0"), ("mid", "0.5e0", _typed_y(nan)), ("white", "0.9e0", "1e0"))
    )
    typed = I.table(spark, sf, "part").selectExpr(
        "p_partkey AS image_id", *[_typed(k, nan) + f" AS {k}" for k in S.KEYS],
        f"named_struct({mask}) AS mask", f"array({curve}) AS curve",
    )
    return C.sanitize_recipe(typed, I.recipes(spark, sf)).select(
        "image_id", *S.KEYS, *[F.col(f"mask.{f}").alias(f"mask_{f}") for f in S.MASK_RANGES],
        F.size("curve").alias("n_points"), F.col("curve")[1]["y"].alias("second_y"),
        *[F.array_join(c, ",").alias(c) for c in ("clamped_keys", "ignored_keys")],
    )


_TEN = ["exposureEv", "contrast", "highlights", "shadows", "whites", "blacks", "temperature", "tint", "vibrance", "saturation"]


def _sidecar_values(nan, inf):
    rules = {k: I.RECIPE_RULES["exposure" if k == "exposureEv" else k] for k in _TEN}
    rules["exposureEv"] = f"({rules['exposureEv']}) * CASE WHEN p_partkey % 9 = 0 THEN 4e0 ELSE 1e0 END"
    rules["tint"] = f"CASE WHEN p_partkey % 12 = 5 THEN {nan} WHEN p_partkey % 12 = 6 THEN {inf} ELSE {rules['tint']} END"
    return [f"CAST({v} AS FLOAT) AS {k}" for k, v in rules.items()]


@register("validate_adjustments", (
    f"WITH s AS (SELECT p_partkey AS image_id, {', '.join(_sidecar_values(chr(39)+'nan'+chr(39)+'::DOUBLE', chr(39)+'infinity'+chr(39)+'::DOUBLE'))} FROM part) "
    f"SELECT image_id, ({' AND '.join(f'isfinite({k})' for k in _TEN)} AND exposureEv BETWEEN -5 AND 5) AS valid FROM s"
))
def validate_adjustments(spark, sf):
    side = I.table(spark, sf, "part").selectExpr(
        "p_partkey AS image_id", *_sidecar_values("double('NaN')", "double('Infinity')")
    )
    good, bad = C.validate_adjustments(side)
    return good.select("image_id", F.lit(True).alias("valid")).unionByName(
        bad.select("image_id", F.lit(False).alias("valid"))
    )


@register("normalize_angle", (
    "WITH v AS (SELECT p_partkey AS image_id, CAST((p_partkey * 37) % 2000 - 1000 AS DOUBLE) / 2e0 AS v FROM part) "
    "SELECT image_id, fmod(fmod(v + 180e0, 360e0) + 360e0, 360e0) - 180e0 AS angle FROM v"
))
def normalize_angle(spark, sf):
    v = F.expr("CAST((p_partkey * 37) % 2000 - 1000 AS DOUBLE) / 2e0")
    return I.table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), wrap(v).alias("angle"))


@register("rendition_name", (
    "SELECT page_id, concat(regexp_replace(url, '\\.[^.]+$', ''), '-graded.jpg') AS name FROM pages"
))
def rendition_names(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", rendition_name(F.col("url")).alias("name"))


# project documents of the library; some lack a key, some break a rule, some are cut off
_DOC = [
    "'{\"schemaVersion\": '", "CASE WHEN p_partkey % 5 = 0 THEN '0' WHEN p_partkey % 5 = 1 THEN '\"1\"' ELSE '1' END",
    "', \"engineVersion\": \"0.1.0\", \"source\": {\"path\": \"'", "p_name", "'\"'",
    "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', \"contentHash\": \"abc\"' END",
    "'}, \"globalAdjustments\": {}'", "CASE WHEN p_partkey % 4 = 1 THEN '' ELSE ', \"masks\": []' END",
    "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '}' END",
]


@register("conformance_report", (
    """WITH v AS (SELECT p_partkey AS image_id, 'json' AS field, 'syntax' AS rule FROM part WHERE p_partkey % 11 = 0
      UNION ALL SELECT p_partkey, 'schemaVersion', 'minimum' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 = 0
      UNION ALL SELECT p_partkey, 'schemaVersion', 'type' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 = 1
      UNION ALL SELECT p_partkey, 'source.contentHash', 'required' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'masks', 'required' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 4 = 1)
    SELECT image_id, field, rule FROM v"""
))
def conformance_report(spark, sf):
    docs = I.table(spark, sf, "part").selectExpr("p_partkey AS image_id", f"concat({', '.join(_DOC)}) AS text")
    return report(docs, "project")

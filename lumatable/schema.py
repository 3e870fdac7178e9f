"""Tables, schemas and the fixed values that every stage agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# The twenty adjustment keys with their neutral values.
ADJUSTMENT_DEFAULTS = {
    "exposure": 0.0,
    "contrast": 0.0,
    "highlights": 0.0,
    "shadows": 0.0,
    "whites": 0.0,
    "blacks": 0.0,
    "temperature": 6500.0,
    "tint": 0.0,
    "vibrance": 0.0,
    "saturation": 0.0,
    "sharpness": 0.0,
    "clarity": 0.0,
    "noiseReduction": 0.0,
    "maskExposure": 0.0,
    "maskFeather": 50.0,
    "vignette": 0.0,
    "lensBrightness": 0.0,
    "rotation": 0.0,
    "flipHorizontal": 0.0,
    "flipVertical": 0.0,
}

# Allowed input range per key; flips are 0/1 switches.
ADJUSTMENT_RANGES = {
    "exposure": (-5.0, 5.0),
    "contrast": (-100.0, 100.0),
    "highlights": (-100.0, 100.0),
    "shadows": (-100.0, 100.0),
    "whites": (-100.0, 100.0),
    "blacks": (-100.0, 100.0),
    "temperature": (2000.0, 12000.0),
    "tint": (-100.0, 100.0),
    "vibrance": (-100.0, 100.0),
    "saturation": (-100.0, 100.0),
    "sharpness": (-100.0, 100.0),
    "clarity": (-100.0, 100.0),
    "noiseReduction": (-100.0, 100.0),
    "maskExposure": (-3.0, 3.0),
    "maskFeather": (0.0, 100.0),
    "vignette": (-100.0, 100.0),
    "lensBrightness": (-100.0, 100.0),
    "rotation": (-180.0, 180.0),
    "flipHorizontal": (0.0, 1.0),
    "flipVertical": (0.0, 1.0),
}

# Mask fields: neutral value and allowed range.
MASK_DEFAULTS = {"x": 0.5, "y": 0.5, "width": 0.42, "height": 0.42, "rotation": 0.0}
MASK_RANGES = {
    "x": (0.0, 1.0),
    "y": (0.0, 1.0),
    "width": (0.04, 1.6),
    "height": (0.04, 1.6),
    "rotation": (-180.0, 180.0),
}
# Geometry used by the pixel stages when a recipe carries no mask at all.
MASK_FALLBACK = {"x": 0.5, "y": 0.5, "width": 0.5, "height": 0.5, "rotation": 0.0}

# The five neutral tone-curve points (id, x, y).
CURVE_DEFAULT = [
    ("black", 0.0, 0.0),
    ("shadow", 0.25, 0.25),
    ("midtone", 0.5, 0.5),
    ("highlight", 0.75, 0.75),
    ("white", 1.0, 1.0),
]
EDIT_TOLERANCE = 1e-4
HISTORY_LIMIT = 100
PREVIEW_EDGE = 1800
HISTOGRAM_BINS = 48
HISTOGRAM_SAMPLE_TARGET = 300_000
SETTLE_GAP_MS = 30

# The ten keys stored in a sidecar file.
SIDECAR_KEYS = [
    "exposureEv",
    "contrast",
    "highlights",
    "shadows",
    "whites",
    "blacks",
    "temperature",
    "tint",
    "vibrance",
    "saturation",
]
# --- end of fixed values ----------------------------------------------------

KEYS = list(ADJUSTMENT_DEFAULTS)

CURVE_POINT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
CURVE = T.ArrayType(CURVE_POINT)
MASK = T.StructType([T.StructField(k, T.DoubleType()) for k in MASK_DEFAULTS])

PIXELS = T.StructType(
    [T.StructField("image_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("x", "y", "r", "g", "b", "a")]
)
RECIPES = T.StructType(
    [T.StructField("image_id", T.LongType())]
    + [T.StructField(k, T.DoubleType()) for k in KEYS]
    + [T.StructField("curve", CURVE), T.StructField("mask", MASK)]
)
EDIT_LOG = T.StructType(
    [
        T.StructField("photo_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
SIDECAR = T.StructType(
    [
        T.StructField("schemaVersion", T.IntegerType()),
        T.StructField("engineVersion", T.StringType()),
        T.StructField(
            "source",
            T.StructType(
                [
                    T.StructField("path", T.StringType()),
                    T.StructField("contentHash", T.StringType()),
                    T.StructField("byteLength", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "globalAdjustments",
            T.StructType([T.StructField(k, T.FloatType()) for k in SIDECAR_KEYS]),
        ),
        T.StructField(
            "masks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("enabled", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)

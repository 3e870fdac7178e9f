import hashlib
import json
import os
import struct
import zlib

from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.operators.catalog import adjustments_valid
from lumatable.sources import files, renditions, sidecars
from lumatable.streaming.edits import refresh_catalogue


def png(path, rows):
    """Minimal RGB PNG from rows of (r, g, b)."""
    raw = b"".join(b"\x00" + bytes(v for px in row for v in px) for row in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(
        ">I", zlib.crc32(kind + data)
    )
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


ROWS = [[(10, 20, 30), (200, 100, 50), (0, 255, 128)], [(1, 2, 3), (4, 5, 6), (250, 251, 252)]]


def test_scan_and_identity(spark, folder):
    png(f"{folder}/a.png", ROWS)
    with open(f"{folder}/note.txt", "w") as f:
        f.write("no image")
    photos = files.scan_photos(spark, folder, 3).collect()
    assert [p["name"] for p in photos] == ["a.png"]
    assert photos[0]["rating"] == 0 and photos[0]["imported"] and photos[0]["temperature"] == 6500.0
    assert photos[0]["history"] == [] and len(photos[0]["curve"]) == 5
    before = open(f"{folder}/a.png", "rb").read()
    got = {os.path.basename(r["path"]): r for r in files.source_identity(spark, folder).collect()}
    assert got["a.png"]["content_hash"] == hashlib.sha256(before).hexdigest()
    assert got["a.png"]["byte_length"] == len(before)
    assert open(f"{folder}/a.png", "rb").read() == before


def test_scan_pixels(spark, folder):
    png(f"{folder}/a.png", ROWS)
    images, pixels, bad = files.scan_pixels(spark, folder)
    assert [(r["width"], r["height"]) for r in images.collect()] == [(3, 2)] and bad.count() == 0
    got = {(p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in pixels.collect()}
    assert got == {(x, y): (*ROWS[y][x], 255) for y in range(2) for x in range(3)}


def test_import_decode_grade_and_report(spark, folder):
    """One folder, listed, decoded, graded and compared by the same ids; nothing goes missing."""
    from lumatable.operators import grade as G
    from lumatable.operators.catalog import library_order

    os.mkdir(f"{folder}/sub")
    png(f"{folder}/b.png", ROWS)
    png(f"{folder}/sub/a.png", ROWS[:1])
    with open(f"{folder}/broken.png", "wb") as f:
        f.write(b"\x89PNG nothing")
    with open(f"{folder}/later.webp", "wb") as f:
        f.write(b"RIFFxxxxWEBP")
    old = files.scan_photos(spark, f"{folder}/sub")
    library = files.import_photos(spark, folder, old)
    rows = library.orderBy(*library_order()).collect()
    assert [(r["name"], r["import_batch"], r["import_pos"]) for r in rows] == [
        ("b.png", 1, 0), ("broken.png", 1, 1), ("later.webp", 1, 2), ("a.png", 0, 0)
    ]
    images, pixels, bad = files.scan_pixels(spark, folder)
    ids = {r["image_id"]: r["name"] for r in rows}
    decoded, lost = {r["image_id"] for r in images.collect()}, {r["image_id"] for r in bad.collect()}
    assert decoded | lost == set(ids) and not decoded & lost
    assert {ids[i] for i in decoded} == {"a.png", "b.png"}
    graded = G.grade(pixels, images, library)
    assert G.compare_renditions(pixels, graded).agg({"changed": "sum", "compared": "sum"}).first()[:] == (0, 9)
    gaps = {ids[r["image_id"]]: r["status"] for r in G.grid_gaps(pixels, library.select("image_id").join(images, "image_id", "left")).collect()}
    assert gaps == {"broken.png": "no-pixels", "later.webp": "no-pixels"}
    assert {r["status"] for r in G.grid_gaps(pixels, images.limit(0)).collect()} == {"no-image-row"}


def test_grey_and_transparent_lines():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"image_id": [1, 2], "y": [0, 3], "n": [1, 4], "line": [bytes([7, 9]), bytes([1, 2, 3, 4])]}
    )
    got = [tuple(r.values()) for b in files._pixels_of_lines([batch]) for r in b.to_pylist()]
    assert got == [(1, 0, 0, 7, 7, 7, 255), (1, 1, 0, 9, 9, 9, 255), (2, 0, 3, 3, 2, 1, 4)]


def test_renditions_do_not_overwrite(spark, folder):
    import pytest

    px = spark.createDataFrame([(1, 0, 0, 1, 2, 3, 255)], S.PIXELS)
    names = spark.createDataFrame([(1, "sea.side.png")], "image_id long, name string")
    renditions.write_renditions(px, f"{folder}/out", 4, names)
    assert spark.read.parquet(f"{folder}/out-names").first()["rendition"] == "sea.side-graded.jpg"
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == 1 and "image_bucket" in back.columns
    with pytest.raises(Exception, match="already exists"):
        renditions.write_renditions(px, f"{folder}/out", 4)


PROJECT = {
    "schemaVersion": 1, "engineVersion": "2.3.1",
    "source": {"path": "shoot/IMG_0193.CR3", "contentHash": "9f2c", "byteLength": 31_415_926},
    "globalAdjustments": {k: (i - 4) / 8 for i, k in enumerate(S.SIDECAR_KEYS)},
    "masks": [{"name": "sky"}],
}


def test_sidecar_round_trip(spark, folder):
    with open(f"{folder}/p.json", "w") as f:
        json.dump(PROJECT, f, indent=2)
    with open(f"{folder}/broken.json", "w") as f:
        f.write('{"schemaVersion": 1, "source": {')
    rows = sidecars.read_sidecars(spark, folder)
    good = rows.filter("_corrupt is null")
    assert rows.count() == 2 and good.count() == 1
    sidecars.write_sidecars(good, f"{folder}/lines")
    sidecars.write_sidecars(good.withColumn("source", F.col("source").withField("path", F.lit("p1"))), f"{folder}/files", per_file=True)
    assert os.listdir(f"{folder}/files/photo=p1")
    back = sidecars.read_sidecars(spark, f"{folder}/lines/part-*", per_file=False)
    doc = json.loads(back.select(F.to_json(F.struct(*S.SIDECAR.fieldNames()))).first()[0])
    want = json.loads(good.select(F.to_json(F.struct(*S.SIDECAR.fieldNames()))).first()[0])
    assert doc == want and doc["source"] == PROJECT["source"] and doc["globalAdjustments"] == PROJECT["globalAdjustments"]
    assert doc["masks"] == [{"name": "sky"}]
    assert back.filter(adjustments_valid("globalAdjustments.")).count() == 1


def test_sidecars_become_recipes_and_back(spark):
    values = {**S.ADJUSTMENT_DEFAULTS, "exposure": 1.5, "temperature": 5200.0, "tint": -4.0}
    recipes = spark.createDataFrame([(7, *values.values()), (8, *S.ADJUSTMENT_DEFAULTS.values())], ["image_id", *values])
    ids = spark.createDataFrame([(7, "a.png", "h7", 5), (8, "b.png", "h8", 6)], "image_id long, path string, content_hash string, byte_length long")
    rows = sidecars.sidecar_rows(recipes, ids)
    back = sidecars.sidecar_recipes(rows, ids.filter("image_id = 7")).collect()
    got = {r["sidecar_path"]: r for r in back}
    assert {k: got["a.png"][k] for k in values} == values and got["a.png"]["temperature_assumed"]
    assert got["b.png"]["image_id"] is None and got["b.png"]["temperature"] == 6500.0 and not got["b.png"]["temperature_assumed"]


def test_conformance(spark):
    bad_hash = {**PROJECT, "source": {"path": "p"}}
    no_masks = {k: v for k, v in PROJECT.items() if k != "masks"}
    no_length = {**PROJECT, "source": {"path": "p", "contentHash": "c"}}
    docs = [(1, PROJECT), (2, bad_hash), (3, no_masks), (4, {**PROJECT, "schemaVersion": 0}), (5, no_length)]
    df = spark.createDataFrame(
        [(i, json.dumps(d)) for i, d in docs] + [(6, '{"schemaVersion": 1,')], "id int, text string"
    )
    got = {(r["id"], r["field"], r["rule"]) for r in sidecars.conformance_report(df, "project").collect()}
    assert got == {
        (2, "source.contentHash", "required"), (3, "masks", "required"),
        (4, "schemaVersion", "minimum"), (6, "json", "syntax"),
    }
    levels = {r["id"]: (r["schema_valid"], r["loadable"]) for r in sidecars.conformance_levels(df).collect()}
    assert levels[1] == (True, True) and levels[5] == (True, False) and levels[6] == (False, False)
    model = {"modelId": "m", "version": "1", "sha256": "x", "format": "pt", "task": "t", "tile": None}
    df = spark.createDataFrame([(1, json.dumps(model))], "id int, text string")
    got = {(r["field"], r["rule"]) for r in sidecars.conformance_report(df, "model").collect()}
    assert got == {("format", "enum"), ("licenseId", "required")}
    look = {"schemaVersion": 1, "name": "n", "engineCompatibility": "1", "defaultAmount": 1.5,
            "parameters": {}, "protectedCategories": ["a", 3]}
    df = spark.createDataFrame([(1, json.dumps(look))], "id int, text string")
    got = {(r["field"], r["rule"]) for r in sidecars.conformance_report(df, "look").collect()}
    assert got == {("defaultAmount", "maximum"), ("protectedCategories", "items")}


def test_fixture_manifest(spark, folder):
    doc = {"schemaVersion": 1, "fixtures": [
        {"id": "a", "path": "p.svg", "kind": "rendered-image", "license": "own", "purpose": ["x", "y"], "private": False}]}
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump(doc, f, indent=2)
    rows = sidecars.read_fixture_manifest(spark, f"{folder}/manifest.json").collect()
    assert sorted((r["id"], r["purpose"]) for r in rows) == [("a", "x"), ("a", "y")]


def test_catalogue_refresh(spark, folder):
    os.mkdir(f"{folder}/in")
    png(f"{folder}/in/a.png", ROWS)
    run = lambda: refresh_catalogue(
        files.stream_photos(spark, f"{folder}/in"), f"{folder}/table", f"{folder}/cp"
    ).awaitTermination()
    run()
    png(f"{folder}/in/b.png", ROWS[:1])
    run()
    got = spark.read.parquet(f"{folder}/table")
    assert sorted(r["name"] for r in got.collect()) == ["a.png", "b.png"]
    # the rows are library rows with the ids and hashes of a scan
    scanned = {r["image_id"]: r["name"] for r in files.scan_photos(spark, f"{folder}/in").collect()}
    assert {r["image_id"]: r["name"] for r in got.collect()} == scanned
    hashes = {r["content_hash"] for r in files.source_identity(spark, f"{folder}/in").collect()}
    assert {r["content_hash"] for r in got.collect()} == hashes and "rating" in got.columns

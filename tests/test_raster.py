"""Raster kernels against a plain loop, and the random choices against their distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators.raster import (
    ASPECT,
    crop_box,
    flip_flag,
    normalize,
    preprocess,
    resample_weights,
    resize,
    resized,
)


def plain_resize(pixels, height, width):
    """Antialiased bilinear, one output value at a time."""
    def weights(source, target, i):
        scale = source / target
        support = max(scale, 1.0)
        centre = (i + 0.5) * scale
        raw = [max(0.0, 1 - abs(j + 0.5 - centre) / support) for j in range(source)]
        return [w / sum(raw) for w in raw]

    out = np.zeros((height, width, pixels.shape[2]), np.uint8)
    for y in range(height):
        rows = weights(pixels.shape[0], height, y)
        for x in range(width):
            columns = weights(pixels.shape[1], width, x)
            for c in range(pixels.shape[2]):
                value = sum(r * k * float(pixels[j, i, c]) for j, r in enumerate(rows) for i, k in enumerate(columns))
                out[y, x, c] = min(255, max(0, int(np.floor(value + 0.5))))
    return out


@pytest.mark.parametrize("shape, target", [((9, 7, 3), (4, 5)), ((3, 4, 1), (8, 6)), ((5, 5, 4), (5, 5)), ((1, 1, 3), (3, 2))])
def test_resize(shape, target):
    pixels = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    ours, plain = hwc_resize(pixels, *target).astype(int), plain_resize(pixels, *target).astype(int)
    assert np.abs(ours - plain).max() <= 1 and (ours == plain).mean() > 0.98
    assert np.allclose(resample_weights(7, 3).sum(axis=1), 1)


def hwc_resize(pixels, height, width):
    return resize(pixels.transpose(2, 0, 1), height, width).transpose(1, 2, 0)


def rasters(spark, shapes):
    rng = np.random.default_rng(2)
    rows = [(n, h, w, c, bytearray(rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()))
            for n, (h, w, c) in enumerate(shapes)]
    return spark.createDataFrame(rows, "sample_id long, height int, width int, channels int, data binary"), rows


def test_normalize(spark):
    table, rows = rasters(spark, [(4, 5, 3), (2, 3, 1), (3, 3, 4), (4, 4, 2)])
    found = {r.sample_id: r for r in normalize(table).collect()}
    assert set(found) == {0, 1, 2}
    for n, h, w, c, data in rows[:3]:
        pixels = np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)
        pixels = np.repeat(pixels, 3, axis=2) if c == 1 else pixels[:, :, :3]
        expected = (pixels.astype(np.float32) / 255).astype(np.float16).transpose(2, 0, 1).ravel()
        assert (found[n].height, found[n].width, found[n].channels) == (h, w, 3)
        assert np.array_equal(np.array(found[n]["values"], np.float16), expected)


def test_packed_tensors_are_the_same_values(spark):
    table, _ = rasters(spark, [(6, 5, 3), (4, 4, 1)])
    plain = {r.sample_id: np.array(r["values"], np.float16) for r in preprocess(table, side=8).collect()}
    halves = preprocess(table, side=8, packed=True).collect()
    packed = {r.sample_id: np.frombuffer(bytes(r["values"]), np.float16) for r in halves}
    assert plain.keys() == packed.keys() and all(np.array_equal(plain[k], packed[k]) for k in plain)


def test_damaged_rasters_are_left_out(spark):
    table, _ = rasters(spark, [(4, 5, 3), (2, 3, 1)])
    short = table.withColumn("data", F.when(F.col("sample_id") == 0, F.substring("data", 1, 10)).otherwise(F.col("data")))
    assert [r.sample_id for r in normalize(short).collect()] == [1]


def test_preprocess_is_a_function_of_seed_epoch_and_id(spark):
    table, _ = rasters(spark, [(20, 30, 3)] * 12)
    def run(df, epoch=0):
        return {r.sample_id: r["values"] for r in preprocess(df, side=8, epoch=epoch).collect()}
    first = run(table)
    assert run(table.repartition(5)) == first
    assert all(len(v) == 3 * 64 and 0 <= min(v) and max(v) <= 1 for v in first.values())
    other = run(table, epoch=1)
    assert sum(other[k] != first[k] for k in first) >= 11


def test_preprocess_crops_resizes_and_flips(spark):
    table, rows = rasters(spark, [(20, 30, 3)] * 6)
    chosen = {r.sample_id: r for r in table.select(
        "sample_id", crop_box(F.col("height"), F.col("width"), F.col("sample_id")).alias("box"),
        flip_flag(F.col("sample_id")).alias("flip")).collect()}
    found = {r.sample_id: r["values"] for r in preprocess(table, side=8).collect()}
    for n, h, w, c, data in rows:
        box, pixels = chosen[n].box, np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)
        pixels = hwc_resize(pixels[box.top:box.top + box.height, box.left:box.left + box.width], 8, 8)
        pixels = pixels[:, ::-1] if chosen[n].flip else pixels
        expected = (pixels.astype(np.float32) / 255).astype(np.float16).transpose(2, 0, 1).ravel()
        assert np.array_equal(np.array(found[n], np.float16), expected)


def test_crops_stay_inside_and_cover_the_allowed_range(spark):
    table = spark.range(4000).select(F.col("id").alias("sample_id"), F.lit(300).alias("h"), F.lit(300).alias("w"))
    boxes = [r.b for r in table.select(crop_box(F.col("h"), F.col("w"), F.col("sample_id")).alias("b")).collect()]
    assert all(0 <= b.top <= 300 - b.height and 0 <= b.left <= 300 - b.width and b.height and b.width for b in boxes)
    areas = np.array([b.height * b.width / 90_000 for b in boxes])
    assert 0.075 < areas.min() < 0.1 and 0.9 < areas.max() <= 1.0
    aspects = np.array([b.width / b.height for b in boxes])
    assert ASPECT[0] * 0.95 < aspects.min() and aspects.max() < ASPECT[1] * 1.05


def test_narrow_images_take_the_central_crop(spark):
    table = spark.createDataFrame([(n, 10, 400) for n in range(50)], "sample_id long, h int, w int")
    boxes = [r.b for r in table.select(crop_box(F.col("h"), F.col("w"), F.col("sample_id")).alias("b")).collect()]
    centre = [b for b in boxes if (b.height, b.width) == (10, 13)]
    assert centre and all((b.top, b.left) == (0, 193) for b in centre)


def test_flips_are_even(spark):
    flips = spark.range(4000).select(flip_flag(F.col("id")).cast("int").alias("f")).agg(F.avg("f")).first()[0]
    assert 0.46 < flips < 0.54


def test_fixed_resize(spark):
    table, rows = rasters(spark, [(9, 7, 1)])
    row = resized(table, 4, 6).first()
    pixels = np.repeat(np.frombuffer(bytes(rows[0][4]), np.uint8).reshape(9, 7, 1), 3, axis=2)
    assert (row.height, row.width, row.channels) == (4, 6, 3)
    assert bytes(row.data) == hwc_resize(pixels, 4, 6).tobytes()

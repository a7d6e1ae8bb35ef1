"""Raster preprocessing: one Arrow pass over decoded rasters.

Every random choice is a column computed from (seed, epoch, sample_id) before the pass, so the kernel is a
pure function and a retry gives the same pixels. A raster is ``height, width, channels, data`` (uint8, HWC).
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shardloom.functions.hashing import unit_fraction

# Area and aspect ranges of the random crop, its tries, the flip chance and the output side.
AREA = (0.08, 1.0)
ASPECT = (3 / 4, 4 / 3)
TRIES = 10
FLIP_CHANCE = 0.5
SIDE = 224

# Tensors leave a task in batches of about this size.
OUT_BYTES = 16 << 20

SHAPE = T.StructType([
    T.StructField("channels", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
])


def channel_rule(channels: Column) -> Column:
    """What happens to a raster's channels; two-channel rasters are rejected, as no rule gives them three."""
    return (F.when(channels == 3, "keep").when(channels == 1, "replicate")
            .when(channels > 3, "first three").otherwise("reject"))


def flip_flag(sample_id: Column, seed: int = 42, epoch: Column | int = 0) -> Column:
    return unit_fraction("flip", seed, epoch, sample_id) < FLIP_CHANCE


def crop_box(height: Column, width: Column, sample_id: Column, seed: int = 42, epoch: Column | int = 0) -> Column:
    """Random crop as struct top, left, height, width: area and log-uniform aspect drawn up to ``TRIES`` times,
    then the central crop of the nearest allowed aspect."""
    h, w = height.cast("double"), width.cast("double")

    def attempt(n):
        def draw(what):
            return unit_fraction(what, seed, epoch, sample_id, n)

        area = h * w * (AREA[0] + draw("area") * (AREA[1] - AREA[0]))
        aspect = F.exp(math.log(ASPECT[0]) + draw("aspect") * (math.log(ASPECT[1]) - math.log(ASPECT[0])))
        box_w, box_h = F.bround(F.sqrt(area * aspect)), F.bround(F.sqrt(area / aspect))
        return F.struct(
            F.floor(draw("top") * (h - box_h + 1)).cast("int").alias("top"),
            F.floor(draw("left") * (w - box_w + 1)).cast("int").alias("left"),
            box_h.cast("int").alias("height"), box_w.cast("int").alias("width"))

    tries = F.transform(F.sequence(F.lit(1), F.lit(TRIES)), attempt)
    fitting = F.filter(tries, lambda b: (b["height"] > 0) & (b["height"] <= height) & (b["width"] > 0)
                       & (b["width"] <= width))
    whole = w / h
    box_w = F.when(whole > ASPECT[1], F.bround(h * ASPECT[1])).otherwise(w).cast("int")
    box_h = F.when(whole < ASPECT[0], F.bround(w / ASPECT[0])).otherwise(h).cast("int")
    centre = F.struct(F.floor((h - box_h) / 2).cast("int").alias("top"),
                      F.floor((w - box_w) / 2).cast("int").alias("left"),
                      box_h.alias("height"), box_w.alias("width"))
    return F.coalesce(F.try_element_at(fitting, F.lit(1)), centre)


@lru_cache(maxsize=4096)
def resample_weights(source: int, target: int):
    """Row-stochastic matrix of antialiased bilinear resampling from ``source`` to ``target`` samples."""
    import numpy as np

    scale = source / target
    support = max(scale, 1.0)
    centres = (np.arange(target) + 0.5) * scale
    distance = np.abs((np.arange(source) + 0.5)[None, :] - centres[:, None]) / support
    weights = np.clip(1.0 - distance, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=4096)
def single_weights(source: int, target: int):
    import numpy as np

    return resample_weights(source, target).astype(np.float32)


def resize(planes, height: int, width: int):
    """Planes of any number (the axis before the last two) to the given size, rounded back to bytes: a matrix product per
    axis for all of them."""
    import numpy as np

    n, source_h, source_w = planes.shape
    wide = planes.astype(np.float32).reshape(n * source_h, source_w) @ single_weights(source_w, width).T
    scaled = np.matmul(single_weights(source_h, height), wide.reshape(n, source_h, width))
    scaled += np.float32(0.5)
    return np.clip(scaled, 0, 255, out=scaled).astype(np.uint8)


def planes_of(data: bytes, height: int, width: int, channels: int):
    """CHW view of a raster, its first three channels at most."""
    import numpy as np

    return np.frombuffer(data, np.uint8).reshape(height, width, channels).transpose(2, 0, 1)[:3]


def three_channels(planes):
    import numpy as np

    return np.repeat(planes, 3, axis=0) if len(planes) == 1 else planes


@lru_cache(maxsize=1)
def half_levels():
    """The 256 values a byte scales to, in half precision."""
    import numpy as np

    return (np.arange(256, dtype=np.float32) / np.float32(255)).astype(np.float16)


def reject_reason() -> Column:
    """Why a raster can't be used; null where it can."""
    size = F.col("height").cast("long") * F.col("width") * F.col("channels")
    return (F.when(F.col("data").isNull(), "no data")
            .when(size.isNull() | (F.octet_length("data") != size), "bytes differ from shape")
            .when(channel_rule(F.col("channels")) == "reject", "channels"))


def usable(rasters: DataFrame) -> DataFrame:
    """Rasters whose bytes match their shape and whose channels can become three; ``rejected`` has the others."""
    return rasters.filter(reject_reason().isNull())


def rejected(rasters: DataFrame) -> DataFrame:
    """The rasters that no tensor is made of, each with its ``reason``."""
    return rasters.withColumn("reason", reject_reason()).filter(F.col("reason").isNotNull())


NO_CROP = "struct<top:int,left:int,height:int,width:int>"


def normalize(rasters: DataFrame, packed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``sample_id`` and the normalised tensor, without crop or resize."""
    no_crop = F.lit(None).cast(NO_CROP)
    return _tensors(rasters.withColumns({"crop": no_crop, "flip": F.lit(False)}), None, packed, keep)


def preprocess(rasters: DataFrame, side: int = SIDE, seed: int = 42, epoch: int = 0, packed: bool = False,
               keep: tuple[str, ...] = (), random_crop: bool = True) -> DataFrame:
    """The training transform: random crop (or the whole raster) resized to ``side``, random flip, channels first, [0, 1].

    Values are ``array<float>``; ``packed`` gives the half-precision bytes instead, a quarter of the size in rows. Columns of
    ``keep`` (key, text, worker, place) go along. Rows keep their order; unusable rasters are left out, see ``rejected``.
    """
    box = crop_box(F.col("height"), F.col("width"), F.col("sample_id"), seed, epoch) if random_crop else F.lit(None).cast(NO_CROP)
    return _tensors(rasters.withColumns({"crop": box, "flip": flip_flag(F.col("sample_id"), seed, epoch)}), side, packed, keep)


def usable_row(data, height, width, channels) -> bool:
    """What ``usable`` asks of a row, asked where the bytes already are: a filter would compute them once more."""
    shape = (height, width, channels)
    return data is not None and None not in shape and len(data) == math.prod(shape) and (channels == 1 or channels > 2)


def transformed(data, height, width, channels, crop, flip, side: int | None):
    """Tensors of rasters, as (places, stack): those of one shape and crop shape are stacked and go through one product per axis."""
    import numpy as np

    groups: dict[tuple, list[int]] = {}
    for i, raster in enumerate(zip(data, height, width, channels)):
        if usable_row(*raster):
            cut = (crop[i]["height"], crop[i]["width"]) if crop[i] is not None else raster[1:3]
            groups.setdefault((*cut, min(raster[3], 3)), []).append(i)
    for (h, w, planes), members in groups.items():
        most = max(1, OUT_BYTES // (4 * 3 * (side * side if side else h * w)))
        for at in range(0, len(members), most):
            part = members[at:at + most]
            stack = np.empty((len(part), planes, h, w), np.uint8)
            for k, i in enumerate(part):
                top, left = (crop[i]["top"], crop[i]["left"]) if crop[i] is not None else (0, 0)
                stack[k] = planes_of(data[i], height[i], width[i], channels[i])[:, top:top + h, left:left + w]
            if side is not None:
                stack = resize(stack.reshape(-1, h, w), side, side).reshape(len(part), planes, side, side)
            flips = np.array([flip[i] for i in part], bool)
            stack[flips] = stack[flips, :, :, ::-1]
            yield part, np.repeat(stack, 3, axis=1) if planes == 1 else stack


def _tensors(ready: DataFrame, side: int | None, packed: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    values = T.StructField("values", T.BinaryType() if packed else T.ArrayType(T.FloatType()))
    carried = ["sample_id", *keep]
    schema = T.StructType([*(ready.schema[c] for c in carried), *SHAPE.fields, values])
    columns = ["data", "height", "width", "channels", "crop", "flip"]

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        levels = half_levels() if packed else half_levels().astype(np.float32)

        def emit(rows, places, stack):
            n, size = len(places), stack[0].size
            flat = np.take(levels, stack).ravel()
            ends = np.arange(0, (n + 1) * size, size, dtype=np.int32)
            if packed:
                column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * 2), pa.py_buffer(flat)])
            else:
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            sides = [pa.array(np.full(n, v, np.int32)) for v in stack.shape[1:]]
            return pa.RecordBatch.from_arrays([*rows.take(pa.array(places)).columns, *sides, column], schema.names)

        for batch in batches:
            rows = batch.select(carried)
            # Groups of one shape are made at once, runs of neighbours of bounded size; rows leave in their order.
            inputs = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            step = max(1, OUT_BYTES // (12 * side * side)) if side else batch.num_rows
            for at in range(0, batch.num_rows, step):
                found = list(transformed(*(c[at:at + step] for c in inputs), side))
                if len({stack.shape[1:] for _, stack in found}) == 1:
                    places = np.concatenate([p for p, _ in found])
                    order = np.argsort(places)
                    stack = np.concatenate([s for _, s in found])[order] if len(found) > 1 else found[0][1]
                    yield emit(rows, places[order] + at, stack)
                else:
                    for p, k, g in sorted((p, k, g) for g, (places, _) in enumerate(found) for k, p in enumerate(places)):
                        yield emit(rows, [p + at], found[g][1][k:k + 1])

    return ready.select(*carried, *columns).mapInArrow(kernel, schema)


def resized(rasters: DataFrame, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """Fixed-size RGB rasters, the optional step before shards are written."""
    ready = usable(rasters).select("sample_id", "height", "width", "channels", "data")

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = batch.to_pydict()
            data = [three_channels(resize(planes_of(*raster), height, width)).transpose(1, 2, 0).tobytes()
                    for raster in zip(*(columns[n] for n in ("data", "height", "width", "channels")))]
            sides = [pa.array(np.full(len(data), v, np.int32)) for v in (height, width, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides, pa.array(data, pa.binary())], batch.schema.names)

    return ready.mapInArrow(kernel, ready.schema)


def map_samples(samples: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """Apply a user function of pandas batches: the hook for transforms of one's own."""

    def kernel(batches):
        for pdf in batches:
            yield function(pdf)

    return samples.mapInPandas(kernel, schema)

"""GeoTIFF header facts, read as a distributed job. Only header and directory bytes are touched."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RASTER_DDL
from .inventory import SMALL_FILES_PER_TASK, _open, dealt

# ---- fixed values of the TIFF and GeoTIFF formats ----
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_WIDTH, _HEIGHT, _BITS, _SAMPLES, _FORMAT = 256, 257, 258, 277, 339
_SCALE, _TIE, _MATRIX, _GEO_KEYS, _GDAL_XML, _GDAL_NODATA = 33550, 33922, 34264, 34735, 42112, 42113
_GEO_RASTER_TYPE, _GEO_GEOGRAPHIC, _GEO_PROJECTED, _USER_DEFINED = 1025, 2048, 3072, 32767
_KINDS = {1: "uint", 2: "int", 3: "float", 5: "complex"}


def read_tags(stream) -> dict[int, object] | None:
    """Tags of the first image directory; null when the magic number is not that of a TIFF."""
    head = stream.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        return None
    version = struct.unpack(order + "H", head[2:4])[0]
    if version == 42:
        offset, count_code, entry, inline = struct.unpack(order + "I", head[4:8])[0], "H", 12, 4
    elif version == 43 and len(head) == 16:
        offset, count_code, entry, inline = struct.unpack(order + "Q", head[8:16])[0], "Q", 20, 8
    else:
        return None
    stream.seek(offset)
    count = struct.unpack(order + count_code, stream.read(struct.calcsize(count_code)))[0]
    block = stream.read(count * entry)
    tags: dict[int, object] = {}
    for i in range(count):
        raw = block[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(order + "HH", raw[:4])
        number = struct.unpack(order + ("I" if inline == 4 else "Q"), raw[4 : 4 + inline])[0]
        size = _SIZES.get(kind, 0) * number
        data = raw[4 + inline : 4 + inline + size]
        if size > inline:
            stream.seek(struct.unpack(order + ("I" if inline == 4 else "Q"), raw[4 + inline :])[0])
            data = stream.read(size)
        if kind == 2:
            tags[tag] = data.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in _CODES:
            tags[tag] = struct.unpack(f"{order}{number}{_CODES[kind]}", data)
    return tags


def _first(tags: dict, tag: int, default=None):
    value = tags.get(tag)
    return value[0] if isinstance(value, tuple) and value else default


def describe(tags: dict[int, object]) -> dict:
    """Raster facts of a tag set, in the shape of the raster schema."""
    width, height = _first(tags, _WIDTH), _first(tags, _HEIGHT)
    if width is None or height is None:
        raise ValueError("no image size")
    scale, tie, matrix = tags.get(_SCALE), tags.get(_TIE), tags.get(_MATRIX)
    if matrix:
        a, b, c, d, e, f = (float(matrix[i]) for i in (0, 1, 3, 4, 5, 7))
    elif scale and tie:
        a, b, d, e = float(scale[0]), 0.0, 0.0, -float(scale[1])
        c, f = tie[3] - tie[0] * a, tie[4] - tie[1] * e
    else:
        a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    keys = tags.get(_GEO_KEYS) or ()
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = next((geo[k] for k in (_GEO_PROJECTED, _GEO_GEOGRAPHIC) if geo.get(k) not in (None, 0, _USER_DEFINED)), None)
    items, description = {}, None
    if _GDAL_XML in tags:
        for item in ElementTree.fromstring(tags[_GDAL_XML]).iter("Item"):
            if item.get("sample") is None:
                items[item.get("name")] = item.text or ""
            elif item.get("sample") == "0" and item.get("role") == "description":
                description = item.text
    if _GEO_RASTER_TYPE in geo:
        items["AREA_OR_POINT"] = "Point" if geo[_GEO_RASTER_TYPE] == 2 else "Area"
    kind, bits = _KINDS.get(_first(tags, _FORMAT, 1), "uint"), _first(tags, _BITS, 1)
    nodata = tags.get(_GDAL_NODATA)
    if nodata is not None:
        nodata = re.sub(r"\s", "", str(nodata))
        nodata = str(float(nodata)) if nodata else None
    corners = [(a * x + b * y + c, d * x + e * y + f) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return {
        "driver": "GTiff", "crs_wkt": None, "epsg": epsg, "transform": [a, b, c, d, e, f],
        "x_origin": c, "y_origin": f, "pixel_size_x": a, "pixel_size_y": e, "width": width, "height": height,
        "band_count": _first(tags, _SAMPLES, 1), "dtype": "uint8" if bits < 8 else f"{kind}{bits}", "nodata": nodata,
        "description": description, "tags": items, "bounds": [min(xs), min(ys), max(xs), max(ys)],
    }


def raster_headers(files: DataFrame, root: str) -> DataFrame:
    """(path, raster) of each file; what is no readable GeoTIFF gets a null, never an error."""
    base = root.rstrip("/")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                facts = None
                try:
                    with _open(f"{base}/{path}") as stream:
                        tags = read_tags(stream)
                    facts = json.dumps(describe(tags)) if tags else None
                except (OSError, ValueError, struct.error, ElementTree.ParseError, IndexError, TypeError):
                    facts = None
                out.append((path, facts))
            yield pd.DataFrame(out, columns=["path", "facts"])

    found = dealt(files.select("path"), SMALL_FILES_PER_TASK).mapInPandas(task, "path STRING, facts STRING")
    return found.select("path", F.from_json("facts", RASTER_DDL).alias("raster"))

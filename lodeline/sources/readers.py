"""Sources with explicit schemas: JSON lines, GeoJSON roads, elevation tiles, archives of XHTML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed records, blank lines skipped, malformed records fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def geojson_roads(spark: SparkSession, path: str) -> DataFrame:
    """(properties, part, points): LineStrings and the parts of MultiLineStrings.

    Other geometry types and lines of fewer than two points are errors."""
    found = spark.read.schema(GEOJSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = found.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    line, lines = F.from_json("c", "array<array<double>>"), F.from_json("c", "array<array<array<double>>>")
    known = F.when(F.col("kind") == "LineString", F.array(line)).when(F.col("kind") == "MultiLineString", lines).otherwise(F.raise_error(F.concat(F.lit("unknown geometry "), F.coalesce("kind", F.lit("null")))))
    parts = rows.select("properties", F.posexplode(known).alias("part", "points"))
    checked = F.when(F.size("points") >= 2, F.transform("points", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).otherwise(F.raise_error(F.lit("a line needs two points")))
    return parts.select("properties", "part", checked.alias("points"))


def elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, side, content): square big-endian 16-bit tiles named like N41E012.hgt."""
    name = F.regexp_extract("path", r"([NS])(\d{2})([EW])(\d{3})\.hgt$", 0)
    part = lambda i: F.regexp_extract(name, r"([NS])(\d{2})([EW])(\d{3})", i)
    signed = lambda letter, number, minus: number.cast("int") * F.when(letter == minus, -1).otherwise(1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path)
    return files.where(name != "").select(signed(part(1), part(2), "S").alias("lat"), signed(part(3), part(4), "W").alias("lon"), F.sqrt(F.col("length") / 2).cast("int").alias("side"), "content")


def sample_elevation(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points (id, lon, lat) with elevation and VALID, NODATA, INVALID or MISSING. A point meets its raster row, a few
    kilobytes, not its tile; a tile without two samples a side or of the wrong length is INVALID."""
    place = [F.floor("lat").alias("tile_lat"), F.floor("lon").alias("tile_lon")]
    named = tiles.select(F.col("lat").alias("tile_lat"), F.col("lon").alias("tile_lon"), "side", "content", ((F.col("side") >= 2) & (F.col("side") * F.col("side") * 2 == F.length("content"))).alias("whole"))
    seen = points.select("id", "lon", "lat", *place).join(named.select("tile_lat", "tile_lon", "side", "whole"), ["tile_lat", "tile_lon"], "left")
    last = F.col("side") - 1
    seen = seen.withColumns({"row": F.bround((1 - (F.col("lat") - F.col("tile_lat"))) * last).cast("int"), "column": F.bround((F.col("lon") - F.col("tile_lon")) * last).cast("int")})
    rows = named.where("whole").select("tile_lat", "tile_lon", "side", "content", F.explode(F.sequence(F.lit(0), last)).alias("row"))
    rows = rows.select("tile_lat", "tile_lon", "row", F.substring("content", F.col("row") * F.col("side") * 2 + 1, F.col("side") * 2).alias("cells"))
    met = seen.join(rows, ["tile_lat", "tile_lon", "row"], "left")
    raw = F.conv(F.hex(F.substring("cells", F.col("column") * 2 + 1, F.lit(2))), 16, 10).cast("long")
    value = F.when(raw >= 32768, raw - 65536).otherwise(raw)
    status = F.when(F.col("whole").isNull(), "MISSING").when(~F.col("whole"), "INVALID").when(value == -32768, "NODATA").otherwise("VALID")
    return met.select("id", F.when(status == "VALID", value).alias("elevation"), status.alias("status"))


class _Blocks(HTMLParser):
    KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "blockquote": "blockquote", "div": "paragraph", "li": "paragraph"}
    SKIP = {"script", "style"}

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[str, str]] = []
        self.kind, self.text, self.skipped = "paragraph", [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.kind, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        if tag in self.KINDS:
            self.flush()
            self.kind = self.KINDS[tag]

    def handle_endtag(self, tag):
        self.skipped = max(0, self.skipped - (tag in self.SKIP))
        if tag in self.KINDS:
            self.flush()
            self.kind = "paragraph"

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def html_blocks(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, block, kind, text): headings, paragraphs and quotes in reading order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, html in zip(b[key], b[column]):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                out += [(name, i, kind, text) for i, (kind, text) in enumerate(parser.blocks)]
            yield pd.DataFrame(out, columns=[key, "block", "kind", "text"])

    return pages.select(F.col(key).cast("long"), column).mapInPandas(run, f"{key} long, block long, kind string, text string")


def epub_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, spine, name, html): the XHTML members of EPUB archives in spine order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from posixpath import dirname, join, normpath
        from xml.etree import ElementTree

        for b in batches:
            out = []
            for where, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
                    package = ElementTree.fromstring(z.read(root))
                    files = {e.get("id"): normpath(join(dirname(root), e.get("href"))) for e in package.iter() if e.tag.endswith("}item")}
                    spine = [files[e.get("idref")] for e in package.iter() if e.tag.endswith("itemref")]
                    out += [(where, i, name, z.read(name).decode("utf-8", "replace")) for i, name in enumerate(spine)]
            yield pd.DataFrame(out, columns=["path", "spine", "name", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, spine long, name string, html string")

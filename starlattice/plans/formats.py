"""Queries over the container's formats: cards, arrays, codecs, files."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..durable import posix_folder
from ..functions.cards import join_continued, parse_cards, pivot_keys
from ..sources import checksum, codecs, quantize, reader, writer
from ..sources.cards import Header, encode_header, make_card
from .tables import query, table

# -- cards: what each line says is known from its row ----------------------------------------------------------------
CARD_SQL = """
SELECT p_partkey AS id, CASE WHEN k = 7 THEN 'ESO NO' || p_size WHEN k = 8 THEN 'COMMENT' ELSE 'K' || p_size END AS key,
       ['integer', 'real', 'logical', 'string', 'string', 'real', 'complex', 'integer', 'commentary', 'empty'][k + 1] AS kind,
       CASE k WHEN 3 THEN p_brand WHEN 4 THEN 'it''s ' || p_size END AS v_string,
       CASE WHEN k = 2 THEN p_size > 25 END AS v_bool, CASE k WHEN 0 THEN p_size WHEN 7 THEN -p_size END::BIGINT AS v_int,
       CASE k WHEN 1 THEN p_size + 0.25 WHEN 5 THEN p_size * 1000.0 END::DOUBLE AS v_float,
       CASE WHEN k = 6 THEN p_size END::DOUBLE AS v_re, CASE WHEN k = 6 THEN -0.5 END::DOUBLE AS v_im
FROM (SELECT *, p_partkey % 10 AS k FROM part)
"""


@query("card_parse", CARD_SQL)
def card_parse(spark, sf_dir):
    """Cards of every kind, made from the rows of a table."""
    size = F.col("p_size").cast("string")
    fields = [
        F.lpad(size, 20, " "), F.concat(size, F.lit(".25")), F.when(F.col("p_size") > 25, "T").otherwise("F"), F.concat(F.lit("'"), F.rpad("p_brand", 12, " "), F.lit("'")),
        F.concat(F.lit("'it''s "), size, F.lit("'")), F.concat(size, F.lit("D3")), F.concat(F.lit("("), size, F.lit(", -0.5)")),
    ]
    plain = F.concat(F.rpad(F.concat(F.lit("K"), size), 8, " "), F.lit("= "))
    k = F.col("p_partkey") % 10
    line = F.coalesce(
        *[F.when(k == i, F.concat(plain, f, F.lit(" / a/b"))) for i, f in enumerate(fields)],
        F.when(k == 7, F.concat(F.lit("HIERARCH ESO NO"), size, F.lit(" = -"), size, F.lit(" / long key"))), F.when(k == 8, F.concat(F.lit("COMMENT  = not a value"), size)), plain,
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.rpad(line, 80, " ").alias("line"))
    return parse_cards(rows).drop("line")


CONTINUE_SQL = "SELECT o_orderkey AS unit, 'LONGSTR' AS key, string_agg(o_orderpriority || '-' || j, '' ORDER BY j) AS value FROM (SELECT o_orderkey, o_orderpriority, unnest(range(1, 4)) AS j FROM orders) GROUP BY o_orderkey"


@query("card_continue_join", CONTINUE_SQL)
def card_continue(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), "o_orderpriority", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j"))
    cards = rows.select("unit", F.col("j").alias("card_index"), F.when(F.col("j") == 1, "LONGSTR").otherwise("CONTINUE").alias("key"), F.concat("o_orderpriority", F.lit("-"), "j", F.when(F.col("j") < 3, "&").otherwise("")).alias("value"))
    return join_continued(cards, ["unit"], "card_index").select("unit", "key", "value")


@query("header_pivot", "SELECT l_orderkey AS unit, min(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS naxis1, min(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS naxis2 FROM lineitem GROUP BY l_orderkey")
def header_pivot(spark, sf_dir):
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("card_index"), F.concat(F.lit("NAXIS"), "l_linenumber").alias("key"), F.col("l_quantity").alias("v_float"))
    return pivot_keys(cards, ["unit"], ["NAXIS1", "NAXIS2"], "v_float")


# -- files written from the tables and read back ---------------------------------------------------------------------
def _written(spark, rows, extname, **options):
    """The rows as files of the container in the shared folder, read as a table."""
    reader.register(spark)
    home = posix_folder(spark, "files")
    writer.write_table(rows, home, extname)
    return spark.read.format("starfits").options(mode="table", extname=extname, **options).load(f"{home}/*.fits")


@query("tform_parse", "SELECT * FROM (VALUES ('b', '1QB(2)'), ('f', '1PE(64)'), ('i', '1J'), ('k', '1K'), ('l', '1L'), ('t', '25A')) AS v(name, tform) WHERE name <> 'b'")
def tform(spark, sf_dir):
    """Column formats as the reader's schema tells them."""
    part, one = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings").select("embedding").limit(1)
    rows = part.limit(1).select(F.col("p_size").cast("int").alias("i"), F.col("p_partkey").cast("long").alias("k"), (F.col("p_size") > 25).alias("l"), F.rpad("p_name", 25, "x").alias("t")).crossJoin(one.withColumnRenamed("embedding", "f"))  # one row by one row
    fields = _written(spark, rows.coalesce(1), "T").schema.fields
    return spark.createDataFrame([(f.name, f.metadata["tform"] + (f"({64})" if f.name == "f" else "")) for f in fields], "name string, tform string")


VLA_SQL = "SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS pos, l_quantity AS value FROM lineitem"


@query("vla_explode", VLA_SQL)
def vla(spark, sf_dir):
    """Ragged rows (an order's quantities by line) through the heap of a table."""
    lines = table(spark, sf_dir, "lineitem")
    ragged = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("v"))
    back = _written(spark, ragged, "RAGGED")
    return back.select(F.col("l_orderkey").alias("row_id"), F.posexplode("v").alias("pos", "value")).select("row_id", F.col("pos").cast("long").alias("pos"), "value")


@query("vector_column", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def vector(spark, sf_dir):
    """Vectors as a column of the container; only the columns asked for are read."""
    back = _written(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "VECTORS", columns="vec_id,embedding")
    e = F.col("embedding")
    return back.select("vec_id", F.element_at(e, 1).cast("double").alias("first"), F.element_at(e, 64).cast("double").alias("last"), F.size(e).cast("long").alias("n"))


NULLS_SQL = "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS size, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS brand, CASE WHEN p_size % 5 <> 0 THEN p_size > 25 END AS large FROM part"


@query("fits_nulls", NULLS_SQL)
def nulls(spark, sf_dir):
    """Missing integers, strings and logicals survive a file."""
    some = lambda k, c: F.when(F.col("p_size") % k != 0, c)
    return _written(spark, table(spark, sf_dir, "part").select("p_partkey", some(3, F.col("p_size")).alias("size"), some(4, F.col("p_brand")).alias("brand"), some(5, F.col("p_size") > 25).alias("large")), "NULLS")


def _order_image(spark, sf_dir, bitpix, bscale=1.0, bzero=0.0, scale=1.0):
    """64 rows of 64 pixels, written by the executors: the largest price of the orders of a key, missing where there is none."""
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4096).alias("pix")).agg(F.floor(F.max("o_totalprice") * scale).alias("value"))
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "orders.fits")
    writer.write_image(rows, path, [64, 64], bitpix, bscale, bzero, -(2 ** (bitpix - 1)) if bitpix > 8 else None)
    return spark.read.format("starfits").option("mode", "image"), path


_PRICES = "(SELECT o_orderkey % 4096 AS pix, max(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("hyperslab", f"SELECT pix % 64 AS x, pix // 64 AS y, floor(v) AS value FROM {_PRICES} WHERE pix % 64 BETWEEN 2 AND 50 AND (pix % 64 - 2) % 3 = 0 AND pix // 64 BETWEEN 10 AND 39 AND (pix // 64 - 10) % 2 = 0")
def hyperslab(spark, sf_dir):
    """Every third pixel of every other line of a window."""
    image, path = _order_image(spark, sf_dir, -64)
    return image.options(lower="2,10", upper="51,40", stride="3,2").load(path).filter("value IS NOT NULL").select("x", "y", "value")


@query("masked_scale", f"SELECT range AS pix, floor(v) - floor(v) % 8 AS value, v IS NOT NULL AS valid FROM range(4096) LEFT JOIN {_PRICES} ON pix = range")
def masked_scale(spark, sf_dir):
    """A scaled integer image (steps of 8) whose missing pixels carry BLANK."""
    image, path = _order_image(spark, sf_dir, 32, 8.0, 3.5, 1.0)
    v = F.col("value") - F.lit(3.5)
    return image.load(path).select("pix", (v - v % 8).alias("value"), F.col("value").isNotNull().alias("valid"))


@query("readfloat32_norm", f"SELECT pix, round(CAST(CAST((least(floor(v * 0.1e0), 32767) + 32768) / 65535e0 AS FLOAT) AS DOUBLE), 5) AS value FROM {_PRICES}")
def readfloat32(spark, sf_dir):
    """A 16-bit image, scaled to the range of its type."""
    image, path = _order_image(spark, sf_dir, 16, scale=0.1)
    return reader.read_float32(image.load(path).filter("value IS NOT NULL"), 16).select("pix", F.round(F.col("value").cast("double"), 5).alias("value"))


DITHER_SQL = "WITH RECURSIVE g(i, s) AS (SELECT 1, 16807::BIGINT UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM g WHERE i < 10000) SELECT i::BIGINT AS i, s AS seed FROM g"


@query("dither_table", DITHER_SQL)
def dither(spark, sf_dir):
    """The generator's 10,000 states."""
    seeds = quantize.seeds()
    return spark.createDataFrame(pd.DataFrame({"i": np.arange(1, len(seeds) + 1), "seed": seeds}))


RLE_SQL = "WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS d FROM o) SELECT user_id, event_type, min(i) AS start, count(*) AS n FROM g GROUP BY user_id, event_type, d"


@query("rle_plio", RLE_SQL)
def rle(spark, sf_dir):
    """Runs of equal values along each row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).cast("long").alias("i"), F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1).alias("new"))
    runs = rows.withColumn("run", F.sum("new").over(Window.partitionBy("user_id").orderBy("i")))
    return runs.groupBy("user_id", "event_type", "run").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("n")).drop("run")


CHECKSUM_SQL = "WITH p AS (SELECT l_returnflag, sum((l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296) AS s FROM lineitem GROUP BY l_returnflag), a AS (SELECT l_returnflag, s % 4294967296 + s // 4294967296 AS s FROM p), b AS (SELECT l_returnflag, s % 4294967296 + s // 4294967296 AS s FROM a) SELECT l_returnflag, (s % 4294967296 + s // 4294967296)::BIGINT AS checksum FROM b"


@query("checksum_u32", CHECKSUM_SQL)
def checksum_u32(spark, sf_dir):
    """The ones'-complement sum of the words of each group."""
    word = (F.col("l_orderkey") * F.lit(2654435761) + F.col("l_partkey") * 40503) % F.lit(4294967296)
    return checksum.sums(table(spark, sf_dir, "lineitem").withColumn("word", word), ["l_returnflag"], "word")


@query("checksum_verify", "SELECT * FROM (VALUES (0, true, true), (1, true, false), (2, NULL, NULL)) AS v(hdu_index, datasum_ok, checksum_ok)")
def checksum_verify(spark, sf_dir):
    """Units of one file: sound, with a changed header, and without checksums."""
    path = os.path.join(posix_folder(spark, "files"), "sums.fits")
    writer.write_file(path, [writer.with_checksum(writer.empty_primary()), writer.with_checksum(writer.image_unit(np.arange(2000), 32, False)), writer.image_unit(np.arange(5), 16, False)])
    writer.edit_file(path, lambda u, h: h.set("OBJECT", "M51") if u.index == 1 else h)
    return checksum.verify(spark.read.format("binaryFile").load(path)).select("hdu_index", "datasum_ok", "checksum_ok")


ROUNDTRIP_SQL = """
SELECT tile_id, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, CAST(sum(q * i) AS BIGINT) AS placed, true AS same
FROM (SELECT l_orderkey % 97 AS tile_id, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_linenumber, l_quantity) AS i FROM lineitem) GROUP BY tile_id"""


def _roundtrip(name: str):
    def run(spark, sf_dir):
        """Each group's quantities as a tile, encoded and decoded: their sum, and their sum by place."""
        tiles = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("tile_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))), lambda x: x["l_quantity"].cast("long")).alias("v"))

        def code(batches):
            for batch in batches:
                out = []
                for tile, v in zip(batch["tile_id"], batch["v"]):
                    back = codecs.decode(codecs.encode(np.asarray(v), name, 2), name, len(v), 2)
                    out.append((tile, len(v), int(back.sum()), int((back * np.arange(1, len(v) + 1)).sum()), bool((back == np.asarray(v)).all())))
                yield pd.DataFrame(out, columns=["tile_id", "n", "total", "placed", "same"])

        return tiles.mapInPandas(code, "tile_id long, n long, total long, placed long, same boolean")

    return run


for _name in ("RICE_1", "GZIP_1", "GZIP_2", "PLIO_1", "HCOMPRESS_1", "NOCOMPRESS"):
    query(f"codec_roundtrip_{_name.lower()}", ROUNDTRIP_SQL)(_roundtrip(_name))


QUANTIZED_SQL = "SELECT m AS method, count(*) AS n, count(*) FILTER (p_size % 9 = 0) AS missing, count(*) AS near FROM part, (VALUES ('DITHER_1'), ('DITHER_2'), ('NONE')) AS v(m) GROUP BY m"


@query("quantize_roundtrip", QUANTIZED_SQL)
def quantize_roundtrip(spark, sf_dir):
    """Prices as one row of floats, quantised by each method and back: missing stay missing, others move half a step at most."""
    rows = table(spark, sf_dir, "part").select(F.lit(1).alias("tile"), "p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("v"))
    tiles = rows.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "v"))), lambda x: x["v"].cast("float")).alias("v"))  # one demonstration tile

    def code(batches):
        for batch in batches:
            out = []
            for v in batch["v"]:
                values = np.array([np.nan if x is None else x for x in v], np.float32)
                for name in ("NONE", "DITHER_1", "DITHER_2"):
                    q, scale, zero = quantize.quantize(values, 4.0, getattr(quantize, name), 3)
                    back = quantize.dequantize(q, scale, zero, getattr(quantize, name), 3)
                    gone = np.isnan(values)
                    near = np.where(gone, np.isnan(back), np.abs(back - values) <= scale * 0.5001)
                    out.append((name, len(values), int(np.isnan(back).sum()), int(near.sum())))
            yield pd.DataFrame(out, columns=["method", "n", "missing", "near"])

    return tiles.mapInPandas(code, "method string, n long, missing long, near long")


@query("fits_roundtrip_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def fits_table(spark, sf_dir):
    """A table written as files of the container, in the folder that all share, and read back."""
    reader.register(spark)
    home = posix_folder(spark, "files")
    writer.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").coalesce(2), home, "SUPPLIER")
    return spark.read.format("starfits").option("mode", "table").option("extname", "SUPPLIER").load(f"{home}/*.fits")


@query("fits_roundtrip_image", "SELECT x.range AS x, y.range AS y, CAST((y.range * 3 + x.range) % 500 AS DOUBLE) AS value, CAST((y.range * 3 + x.range) % 500 AS DOUBLE) AS tile_value FROM range(64) AS x, range(48) AS y")
def fits_image(spark, sf_dir):
    """An image and its compressed twin, read as pixels and as tiles."""
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "image.fits")
    values = (np.add.outer(np.arange(48) * 3, np.arange(64)) % 500).astype(np.int64)
    writer.write_file(path, [writer.image_unit(values, 16, True), writer.compressed_unit(values, 16, "RICE_1")])
    pixels = spark.read.format("starfits").option("mode", "image").option("hdu", "0").load(path)
    tiles = spark.read.format("starfits").option("mode", "tiles").load(path)
    flat = tiles.select(F.col("origin")[1].alias("y"), F.posexplode("values").alias("x", "tile_value")).withColumn("x", F.col("x").cast("long"))
    return pixels.join(flat, ["x", "y"]).select("x", "y", "value", "tile_value")


for _codec in ("RICE_1", "GZIP_2", "HCOMPRESS_1", "PLIO_1"):

    def _tiled(spark, sf_dir, codec=_codec):
        """A compressed image in tiles of 10 by 8, put together by the executors; pixels by their place."""
        reader.register(spark)
        path = os.path.join(posix_folder(spark, "files"), "tiled.fits")
        rows = spark.range(37 * 29).selectExpr("id AS pix", "CAST((id % 29 + id DIV 29) * 7 % 300 AS DOUBLE) AS value")
        writer.write_compressed(rows, path, [29, 37], 16, codec, [10, 8])
        tiles = spark.read.format("starfits").option("mode", "tiles").load(path)
        pixels = tiles.select("origin", "size", F.posexplode("values").alias("i", "value"))
        return pixels.select((F.col("origin")[0] + F.col("i") % F.col("size")[0]).alias("x"), (F.col("origin")[1] + F.floor(F.col("i") / F.col("size")[0])).alias("y"), "value")

    query(f"fits_tiles_{_codec.lower()}", "SELECT x.range AS x, y.range AS y, CAST((x.range + y.range) * 7 % 300 AS DOUBLE) AS value FROM range(29) AS x, range(37) AS y")(_tiled)


@query("fits_exact_int64", "SELECT range AS pix, 9007199254740993 + range * 1000000007 AS value FROM range(600)")
def fits_exact(spark, sf_dir):
    """64-bit pixels beyond what a double holds."""
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "exact.fits")
    writer.write_file(path, [writer.image_unit((9007199254740993 + np.arange(600, dtype=np.int64) * 1000000007).reshape(20, 30), 64, True)])
    return spark.read.format("starfits").option("mode", "image").load(path).select("pix", F.col("value").cast("long").alias("value"))


@query("fits_frame_rgb", "SELECT x.range AS x, y.range AS y, CAST(x.range AS DOUBLE) AS r, CAST(100 + y.range AS DOUBLE) AS g, CAST(x.range * y.range AS DOUBLE) AS b FROM range(7) AS x, range(5) AS y")
def fits_rgb(spark, sf_dir):
    """Colour pixels written as a cube of three planes, and read back as columns."""
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "rgb.fits")
    frame = spark.range(35).selectExpr("id % 7 AS x", "id DIV 7 AS y").selectExpr("x", "y", "x AS r", "100 + y AS g", "x * y AS b")
    writer.write_image(writer.rgb_pixels(frame, 7, 5), path, [7, 5, 3], -32)
    return reader.frame_rgb(spark.read.format("starfits").option("mode", "image").load(path))


EDIT_SQL = "SELECT * FROM (VALUES (0, 'EXTEND', NULL, NULL, true), (1, 'BITPIX', NULL, 16, NULL), (1, 'EXTNAME', 'SECOND', NULL, NULL), (1, 'NAXIS1', NULL, 5, NULL), (1, 'OBJECT', 'M51', NULL, NULL)) AS v(hdu_index, key, v_string, v_int, v_bool)"


@query("fits_edits", EDIT_SQL)
def fits_edits(spark, sf_dir):
    """A unit dropped, a header changed, pixels replaced; the cards that are left."""
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "edits.fits")
    writer.write_file(path, [writer.empty_primary(), writer.image_unit(np.arange(4), 32, False), writer.image_unit(np.arange(5), 16, False, extra=[make_card("EXTNAME", "SECOND")])])
    writer.edit_file(path, lambda u, h: None if u.index == 1 else h.set("OBJECT", "M51") if u.index == 2 else h)
    writer.overwrite_pixels(path, 1, np.arange(5) * 2)
    cards = spark.read.format("starfits").option("mode", "cards").load(path)
    return cards.filter("key IN ('OBJECT', 'EXTNAME', 'NAXIS1') OR key = 'BITPIX' AND hdu_index = 1 OR key = 'EXTEND'").select("hdu_index", "key", "v_string", "v_int", "v_bool")


@query("fits_ascii_table", "SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) * 0.5 AS half FROM nation")
def fits_ascii(spark, sf_dir):
    """A text table: numbers, a real with a D exponent, and strings, in fixed columns."""
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "ascii.fits")
    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"] * 0.5) for r in table(spark, sf_dir, "nation").collect()]  # the 25 nations
    lines = "".join(f"{k:>6} {name:<25} {half:>8.3f}D0" for k, name, half in rows).encode()
    cards = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 43), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3)]
    cards += [("TTYPE1", "id"), ("TFORM1", "I6"), ("TBCOL1", 1), ("TTYPE2", "name"), ("TFORM2", "A25"), ("TBCOL2", 8), ("TTYPE3", "half"), ("TFORM3", "D10.3"), ("TBCOL3", 34)]
    writer.write_file(path, [writer.empty_primary(), encode_header(Header([make_card(*c) for c in cards])) + lines.ljust(-(-len(lines) // 2880) * 2880)])
    return spark.read.format("starfits").option("mode", "table").load(path)


CATALOGUE_SQL = "SELECT * FROM (VALUES (0, 'primary', 8, '', 2880, 2880), (1, 'image', -32, '4x3', 5760, 5808), (2, 'image', 16, '8', 11520, 11536)) AS v(hdu_index, kind, bitpix, shape, data_start, data_end)"


@query("fits_hdu_catalogue", CATALOGUE_SQL)
def fits_hdus(spark, sf_dir):
    reader.register(spark)
    path = os.path.join(posix_folder(spark, "files"), "units.fits")
    writer.write_file(path, [writer.empty_primary(), writer.image_unit(np.arange(12.0).reshape(3, 4), -32, False), writer.image_unit(np.arange(8), 16, False)])
    return spark.read.format("starfits").option("mode", "hdu").load(path).select("hdu_index", "kind", "bitpix", F.array_join("shape", "x").alias("shape"), "data_start", "data_end")

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlattice.sources import cards, layout, quantize, reader, writer
from starlattice.sources.cards import Card, Header, make_card


@pytest.fixture(scope="module")
def read(spark):
    reader.register(spark)
    return lambda path, mode, **o: spark.read.format("starfits").options(mode=mode, **{k: str(v) for k, v in o.items()}).load(str(path))


def test_cards():
    line = lambda t: f"{t:<80}".encode()
    one = lambda t: cards.parse_card(line(t))
    assert one("SIMPLE  =                    T / ok") == Card("SIMPLE", True, "ok", "logical", line("SIMPLE  =                    T / ok"))
    assert one("A       = 'it''s   ' / x").value == "it's" and one("B       = -12").value == -12
    assert one("C       = 1.5D3").value == 1500.0 and one("D       = (1.0, -2)").value == complex(1, -2)
    assert one("HIERARCH ESO OBS ID = 5 / n").key == "ESO OBS ID" and one("COMMENT hello").kind == "commentary" and one("E       =").kind == "empty"
    long = "it's " * 40 + "end"
    raw = cards.encode_card(make_card("LONGSTR", long))
    back = cards.parse_cards(cards.split_cards(raw))
    assert len(back) == 1 and back[0].value == long and back[0].raw == raw and cards.encode_card(back[0]) == raw
    h = Header([make_card("SIMPLE", True), make_card("N", 3), make_card("X", 1.25, "c"), make_card("N", 9)])
    assert h.get("n") == 3 and h.typed("N", float) == 3.0 and h.set("X", 2.5).get("x") == 2.5 and "N" not in h.delete("n")
    with pytest.raises(TypeError):
        h.typed("X", int)
    with pytest.raises(KeyError):
        h.typed("Q", int)
    parsed = cards.parse_cards(cards.split_cards(cards.encode_header(h)))
    assert [(c.key, c.value) for c in parsed] == [(c.key, c.value) for c in h.cards]
    with pytest.raises(cards.FormatError):
        cards.parse_value("'open")


def test_scan_errors():
    with pytest.raises(cards.EmptyFile):
        layout.scan(io.BytesIO(b""))
    with pytest.raises(cards.Truncated):
        layout.scan(io.BytesIO(writer.image_unit(np.zeros((50, 50)), -64, True)[:-2880]))
    with pytest.raises(cards.FormatError):
        layout.scan(io.BytesIO(b"X" * 2880 * 2))
    with pytest.raises(cards.FormatError):
        layout.parse_tform("9Z")
    assert layout.parse_tform("1PE(17)") == (1, "P", "E") and layout.parse_tdim("(3, 4)") == (3, 4)


def test_images(read, tmp_path):
    v = np.arange(40).reshape(4, 5, 2)
    path = tmp_path / "a.fits"
    writer.write_file(str(path), [writer.image_unit(np.array([[0.0, 100, 40000], [np.nan, 65535, -5]]), 16, True, 1, 32768, -32768), writer.image_unit(v, 32, False, extra=[make_card("EXTNAME", "CUBE")]), writer.image_unit(np.array([[1.5, np.nan]]), -32, False), writer.image_unit(np.array([2**62 + 1]), 64, False)])
    got = [r.value for r in read(path, "image", hdu=0).orderBy("pix").collect()]
    assert got == [None, 100, 40000, None, 65535, None]
    cube = read(path, "image", extname="CUBE").orderBy("pix").collect()
    assert [r.value for r in cube] == list(range(40)) and (cube[-1].x, cube[-1].y, cube[-1].z) == (1, 4, 3)
    slab = read(path, "image", extname="CUBE", lower="0,1,0", upper="2,4,3", stride="1,2,2").collect()
    assert sorted(r.value for r in slab) == sorted(v[::2][:2, 1:4:2].ravel().tolist())
    with pytest.raises(Exception):
        read(path, "image", extname="CUBE", lower="0,0,0", upper="9,9,9").collect()
    units = read(path, "hdu").orderBy("hdu_index").collect()
    assert [u.kind for u in units] == ["primary", "image", "image", "image"] and units[1]["shape"] == [2, 5, 4]
    keys = read(path, "cards").filter("hdu_index = 1 and key = 'EXTNAME'").collect()
    assert keys[0].v_string == "CUBE"
    norm = reader.read_float32(read(path, "image", hdu=0).filter("value is not null"), 16)
    want = [(v + 32768) / 65535 for v in (100, 40000, 65535)]  # the range of signed 16-bit values, whatever BZERO says
    assert np.allclose([r.value for r in norm.orderBy("pix").collect()], want, rtol=1e-6)


def test_exact_and_missing(spark, read, tmp_path):
    """64-bit integers stay exact, missing values stay missing, and no value is taken for one."""
    big = np.array([[2**60 + 3, -(2**63)], [2**53 + 1, 7]], np.int64)
    writer.write_file(str(tmp_path / "big.fits"), [writer.image_unit(big, 64, True), writer.compressed_unit(big, 64, "GZIP_2"), writer.image_unit(big, 64, False, 1, 2**63)])
    assert [int(r.value) for r in read(tmp_path / "big.fits", "image", hdu=0).orderBy("pix").collect()] == big.ravel().tolist()
    assert [int(r.value) for r in read(tmp_path / "big.fits", "image", hdu=2).orderBy("pix").collect()] == [max(0, v) for v in big.ravel().tolist()]  # unsigned: clamped at 0
    assert [int(x) for r in read(tmp_path / "big.fits", "tiles").orderBy("tile_id").collect() for x in r["values"]] == big.ravel().tolist()
    writer.write_file(str(tmp_path / "nan.fits"), [writer.image_unit(np.array([0.0, np.nan, -32768.0, 5.0]), 16, True)])
    assert [r.value for r in read(tmp_path / "nan.fits", "image").orderBy("pix").collect()] == [0, None, -32768, 5]
    with pytest.raises(ValueError):
        writer.image_unit(np.append(np.arange(256.0), np.nan), 8, True)
    kinds = "i int, s smallint, l bigint, t string, b binary, a array<int>"
    rows = [(1, -32768, 2**60 + 3, "", b"\x00\xff", [1, None]), (None, None, None, None, None, []), (-(2**31), 7, -(2**63), "x", b"", [-(2**31)])]
    writer.write_table(spark.createDataFrame(rows, kinds).coalesce(1), str(tmp_path / "n"), "N")
    got = read(tmp_path / "n" / "*.fits", "table", extname="N").collect()
    back = sorted(((r.i, r.s, r.l, r.t, bytes(r.b or []), r.a) for r in got), key=str)
    assert back == sorted(((i, s, l, t, b or b"", a) for i, s, l, t, b, a in rows), key=str)


def test_image_from_rows(spark, read, tmp_path, monkeypatch):
    """Pixels from rows, in several strips; missing ones, repeated ones and integers without BLANK."""
    monkeypatch.setattr(writer, "STRIP_BYTES", 64)
    df = spark.range(100).filter("id % 7 != 3").selectExpr("id AS pix", "CAST(id * 2 AS DOUBLE) AS value").repartition(3)
    df = df.union(spark.createDataFrame([(5, 1.0), (8, None)], "pix long, value double"))
    path = tmp_path / "rows.fits"
    for bitpix, blank in ((-64, None), (32, -1)):
        writer.write_image(df, str(path), [10, 10], bitpix, 1.0, 0.0, blank)
        assert [r.value for r in read(path, "image").orderBy("pix").collect()] == [None if i % 7 == 3 else i * 2 for i in range(100)]
    assert [f.name for f in tmp_path.iterdir()] == ["rows.fits"]
    with pytest.raises(Exception, match="BLANK"):
        writer.write_image(df, str(path), [10, 10], 32)


def test_compressed_from_rows(spark, read, tmp_path):
    """Tiles put together by the executors are those of the array on one machine, byte by byte."""
    v = (np.add.outer(np.arange(23), np.arange(17)) * 13 % 700).astype(float)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v.ravel())], "pix long, value double").repartition(3)
    for bitpix, codec in ((16, "RICE_1"), (32, "GZIP_2"), (-32, "RICE_1"), (16, "PLIO_1"), (16, "HCOMPRESS_1")):
        writer.write_compressed(df, str(tmp_path / "rows.fits"), [17, 23], bitpix, codec, [5, 4])
        writer.write_file(str(tmp_path / "array.fits"), [writer.empty_primary(), writer.compressed_unit(v.astype(np.float32) if bitpix < 0 else v.astype(int), bitpix, codec, [5, 4])])
        back = [[r["values"] for r in read(tmp_path / name, "tiles").orderBy("tile_id").collect()] for name in ("rows.fits", "array.fits")]
        assert back[0] == back[1] and len(back[0]) == 24
    writer.write_compressed(df.filter("pix % 11 <> 2"), str(tmp_path / "rows.fits"), [17, 23], 16, "RICE_1", [5, 4], blank=-1)
    assert sum(x is None for r in read(tmp_path / "rows.fits", "tiles").collect() for x in r["values"]) == sum(i % 11 == 2 for i in range(391))


def test_writer_and_stores(spark, read, tmp_path):
    """Several files a task, overwriting, empty tables; every mode over contents from any store; filters pushed down."""
    df = spark.range(1000).selectExpr("id", "id * 0.5D AS v").repartition(3)
    out = df.write.format("starfits").option("extname", "T").option("rowsPerFile", "150")
    for mode in ("append", "overwrite"):
        out.mode(mode).save(str(tmp_path / "t"))
        assert sorted(r.id for r in read(tmp_path / "t" / "*.fits", "table", extname="T").collect()) == list(range(1000))
    assert not [f for f in (tmp_path / "t").iterdir() if not f.name.endswith(".fits")]
    files = spark.read.format("binaryFile").load(str(tmp_path / "t"))
    assert reader.from_binary(files, "table", extname="T").agg({"v": "sum"}).first()[0] == sum(range(1000)) / 2
    writer.write_table(df.limit(0), str(tmp_path / "empty"), "T")
    assert read(tmp_path / "empty" / "*.fits", "table", extname="T").count() == 0
    v = np.arange(12.0).reshape(3, 4)
    writer.write_file(str(tmp_path / "m.fits"), [writer.empty_primary(), writer.image_unit(v, -64, False, extra=[make_card("EXTNAME", "V")]), writer.compressed_unit(v.astype(int), 32, "RICE_1")])
    one = spark.read.format("binaryFile").load(str(tmp_path / "m.fits"))
    assert [r.value for r in reader.from_binary(one, "image", extname="V", lower="1,0", upper="3,3").orderBy("pix").collect()] == v[:, 1:3].ravel().tolist()
    assert [x for r in reader.from_binary(one, "tiles").orderBy("tile_id").collect() for x in r["values"]] == v.ravel().tolist()
    units = read(tmp_path / "m.fits", "hdu")
    assert [r.kind for r in units.filter("extname = 'V'").collect()] == ["image"] and [r.kind for r in units.filter("hdu_index = 2").collect()] == ["compressed"]
    assert reader.can_convert(16, "int") and not reader.can_convert(-32, "int") and not reader.can_convert(64, "int") and reader.can_convert(64, "float")
    with pytest.raises(TypeError):
        reader.convert(read(tmp_path / "m.fits", "image"), -64, "bigint")


def test_tables(spark, read, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a", True, [1.0, 2.0]), (2, None, "bcd", False, []), (3, -1.0, None, None, [3.0])], "ID int, FLUX double, LABEL string, VALID boolean, SPEC array<float>")
    writer.write_table(df.coalesce(1), str(tmp_path / "t"), "CATALOG")
    got = read(tmp_path / "t" / "*.fits", "table", extname="CATALOG")
    rows = got.orderBy("ID").collect()
    assert [r.LABEL for r in rows] == ["a", "bcd", None] and [r.SPEC for r in rows] == [[1.0, 2.0], [], [3.0]] and [r.VALID for r in rows] == [True, False, None]
    assert rows[0].FLUX == 2.5 and np.isnan(rows[1].FLUX)
    assert read(tmp_path / "t" / "*.fits", "table", extname="CATALOG", columns="SPEC,ID").columns == ["SPEC", "ID"]
    exploded = got.select("ID", F.posexplode("SPEC").alias("pos", "v"))
    assert exploded.count() == 3


def test_ascii_table(read, tmp_path):
    rows = [b"  12 1.50D1 abc  ", b"    -2.5E0  zz   "]
    head = Header([make_card(*c) for c in [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 17), ("NAXIS2", 2), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3), ("TTYPE1", "N"), ("TFORM1", "I4"), ("TBCOL1", 1), ("TTYPE2", "V"), ("TFORM2", "D7.2"), ("TBCOL2", 5), ("TSCAL2", 2.0), ("TTYPE3", "S"), ("TFORM3", "A5"), ("TBCOL3", 13)]])
    path = tmp_path / "x.fits"
    writer.write_file(str(path), [writer.empty_primary(), cards.encode_header(head) + b"".join(rows).ljust(2880)])
    got = read(path, "table").collect()
    assert [(r.N, r.V, r.S.strip()) for r in got] == [(12, 30.0, "abc"), (None, -5.0, "zz")]


@pytest.mark.parametrize("codec", ["RICE_1", "GZIP_1", "GZIP_2", "PLIO_1", "HCOMPRESS_1", "NOCOMPRESS"])
def test_compressed(read, tmp_path, codec):
    v = (np.add.outer(np.arange(37), np.arange(29)) * 7 % 300).astype(int)
    path = tmp_path / "c.fits"
    writer.write_file(str(path), [writer.empty_primary(), writer.compressed_unit(v, 16, codec, [10, 8])])
    image = np.full(v.shape, np.nan)
    for r in read(path, "tiles").collect():
        (x, y), (w, h) = r.origin, r["size"]
        image[y : y + h, x : x + w] = np.array(r["values"]).reshape(h, w)
    assert (image == v).all()


@pytest.mark.parametrize("method", [quantize.NONE, quantize.DITHER_1, quantize.DITHER_2])
def test_compressed_floats(read, tmp_path, method):
    rng = np.random.default_rng(2)
    v = (np.linspace(0, 100, 2000).reshape(20, 100) + rng.normal(0, 1, (20, 100))).astype(np.float32)
    v[3, 4], v[5] = np.nan, 7.0
    path = tmp_path / "f.fits"
    writer.write_file(str(path), [writer.empty_primary(), writer.compressed_unit(v, -32, "RICE_1", None, 16.0, method)])
    rows = {r.origin[1]: [np.nan if x is None else x for x in r["values"]] for r in read(path, "tiles").collect()}
    image = np.array([rows[y] for y in range(20)])
    assert np.isnan(image[3, 4]) and (image[5] == 7).all() and np.nanmax(np.abs(image - v)) < 0.2


def test_edits(read, tmp_path):
    path = str(tmp_path / "e.fits")
    unit = writer.with_checksum(writer.image_unit(np.arange(6).reshape(2, 3), 16, True))
    from starlattice.sources import checksum

    assert checksum.is_valid(unit)
    writer.write_file(path, [unit, writer.image_unit(np.arange(4), 32, False), writer.image_unit(np.arange(5), 32, False)])
    writer.edit_file(path, lambda u, h: None if u.index == 1 else h.set("OBJECT", "M51") if u.index == 2 else h)
    with open(path, "rb") as f:
        units = layout.scan(f)
    assert len(units) == 2 and units[1].header.get("OBJECT") == "M51" and writer.unit_bytes(path, units[0]) == unit
    writer.overwrite_pixels(path, 1, np.arange(5) * 2)
    assert [r.value for r in read(path, "image", hdu=1).orderBy("pix").collect()] == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        writer.overwrite_pixels(path, 1, np.arange(6))
    with pytest.raises(ValueError):
        writer.edit_file(path, lambda u, h: None)


def test_binary(spark, tmp_path):
    writer.write_file(str(tmp_path / "b.fits"), [writer.empty_primary(), writer.image_unit(np.arange(4), 16, False)])
    files = spark.read.format("binaryFile").load(str(tmp_path / "b.fits"))
    assert reader.from_binary(files).count() == 2 and reader.from_binary(files, "cards").filter("key = 'BITPIX'").count() == 2

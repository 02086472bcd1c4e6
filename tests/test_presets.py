import struct
import zlib

import numpy as np
import pytest

from starlattice import tools
from starlattice.operators import presets
from starlattice.sources import picture, writer


def test_presets(spark):
    df = spark.createDataFrame([(i, 0.01 + i / 400, 0.02 + i / 500, i / 200) for i in range(100)], "id int, r double, g double, b double").selectExpr("id", *[f"CAST({c} AS FLOAT) AS {c}" for c in "rgb"])
    assert len(presets.PRESETS) == 18
    for name in ("kstars1", "auto_linked", "asinh_strong", "ght_mild", "linear"):
        got = presets.apply(df, name).orderBy("id").collect()
        assert len(got) == 100 and all(0 <= r[c] <= 1 for r in got for c in "rgb") and got[90].r > got[10].r, name
    with pytest.raises(ValueError):
        presets.find("none")


def test_picture():
    data = picture.encode_png(picture.to_levels(np.array([[0.0, 0.5], [1.0, 2.0]]), -32))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 2)
    size = struct.unpack(">I", data[33:37])[0]
    assert zlib.decompress(data[41 : 41 + size]) == b"\0\x00\x80\0\xff\xff"
    with pytest.raises(TypeError):
        picture.to_levels(np.zeros(2), 32)


def test_tools(tmp_path):
    a, b = str(tmp_path / "a.fits"), str(tmp_path / "b.fits")
    writer.write_file(a, [writer.empty_primary(), writer.image_unit(np.arange(4), 16, False)])
    tools.copy(a, b)
    assert open(a, "rb").read() == open(b, "rb").read() and tools.dump(a)[0].startswith("unit 0 primary") and tools.main(["x"]) == 2

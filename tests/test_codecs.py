import gzip

import numpy as np
import pytest

from starlattice.sources import checksum, codecs, quantize, writer

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("size", [1, 2, 4, 8])
@pytest.mark.parametrize("name", ["RICE_1", "GZIP_1", "GZIP_2", "NOCOMPRESS"])
def test_integers(name, size):
    top = 1 << (8 * size - 1)
    low = 0 if size == 1 else -top
    for v in (np.arange(100) % 50, np.zeros(77, int), RNG.integers(low, top, 200), np.cumsum(RNG.integers(-3, 4, 500)) % 100, np.array([low, top - 1] * 40), np.array([5])):
        assert (codecs.decode(codecs.encode(v, name, size), name, len(v), size) == v).all()


def test_plio():
    for v in (RNG.integers(0, 3, 500), np.zeros(9000, int), np.full(9000, 7), np.array([0, 5000, 5000, 1, 0, 100000])):
        assert (codecs.plio_decode(codecs.plio_encode(v), len(v)) == v).all()


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (4, 4), (8, 8), (5, 7), (1, 9), (16, 3), (33, 20)])
def test_hcompress(shape):
    for image in (RNG.integers(-50, 50, shape), np.zeros(shape, int), RNG.integers(0, 30000, shape), np.add.outer(np.arange(shape[0]), np.arange(shape[1])) * 3):
        assert (codecs.h_inverse(codecs.h_transform(image)) == image).all()
        assert (codecs.hcompress_decode(codecs.hcompress_encode(image)) == image).all()


def test_errors():
    with pytest.raises(ValueError):
        codecs.rice_decode(b"\0\1", 40, 2)
    with pytest.raises(ValueError):
        codecs.hcompress_decode(b"xx")
    with pytest.raises(ValueError):
        codecs.decode(b"", "LZ", 1, 2)


def test_checksum():
    data = bytes(RNG.integers(0, 256, 2880, np.uint8))
    assert checksum.checksum(data[1440:], checksum.checksum(data[:1440])) == checksum.checksum(data)
    for value in (0, 1, 0xFFFFFFFF, 868229149, 0x12345678):
        assert checksum.decode(checksum.encode(value)) == value and checksum.encode(value).isalnum()
    unit = bytearray(data)
    unit[16:32] = b"0" * 16
    text = checksum.encode(checksum.checksum(bytes(unit)))
    unit[16:32] = text.encode()
    # the characters add up wherever they stand when taken from one byte on, as in a card
    assert checksum.is_valid(writer.with_checksum(writer.image_unit(np.arange(700), 32, True)))
    broken = bytearray(writer.with_checksum(writer.image_unit(np.arange(700), 32, True)))
    broken[3000] ^= 1
    assert not checksum.is_valid(bytes(broken))


def test_fixed_streams():
    """Byte strings worked out by hand from the published formats, so that two matching errors cannot pass."""
    # Rice, 16 bits: first value plain, then blocks of zigzag differences (here 0, +1, -1 -> 0, 2, 1) of split k:
    # code k + 1 in 4 bits, each difference as its upper part in unary and k lower bits.
    assert codecs.rice_decode(bytes([0x00, 0x05, 0x00]), 4, 2).tolist() == [5, 5, 5, 5]  # code 0: all differences are zero
    bits = "0000000000000101" + "0001" + "1" + "1" + "001" + "01"  # 5; k = 0: 0 0 2 1
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert codecs.rice_decode(data, 4, 2).tolist() == [5, 5, 6, 5]
    # GZIP_2: all first bytes, then all second bytes, deflated
    assert codecs.decode(gzip.compress(bytes([1, 2, 3, 4])), "GZIP_2", 2, 2).tolist() == [0x0103, 0x0204]
    assert codecs.decode(gzip.compress(bytes([1, 2, 3, 4])), "GZIP_1", 2, 2).tolist() == [0x0102, 0x0304]
    assert codecs.decode(bytes([0, 7, 255, 254]), "NOCOMPRESS", 2, 2).tolist() == [7, -2]
    # PLIO line list: header words (0, 7 words of header, -100, length, 0, 0, 0), then 4 bits of code and 12 of data:
    # ZN 0 skip, HN 4 write the high value, PN 5 zeros then one high value; IH 2 raises it.
    words = [0, 7, -100, 7 + 4, 0, 0, 0, 0x0003, 0x4002, 0x2004, 0x5003]
    assert codecs.plio_decode(np.array(words, ">i2").tobytes(), 8).tolist() == [0, 0, 0, 1, 1, 0, 0, 5]


def test_dither():
    v = (np.linspace(0, 1000, 400) + RNG.normal(0, 1, 400)).astype(np.float32).reshape(4, 100)
    v[1, 3] = 0
    for method in (quantize.NONE, quantize.DITHER_1, quantize.DITHER_2):
        q, scale, zero = quantize.quantize(v, 4.0, method, 3)
        back = quantize.dequantize(q, scale, zero, method, 3)
        assert np.abs(back - v).max() <= scale * 0.51
        if method == quantize.DITHER_2:
            assert back[1, 3] == 0
    v[2, 5] = np.nan
    q, scale, zero = quantize.quantize(v)
    assert q[2, 5] == quantize.NULL and np.isnan(quantize.dequantize(q, scale, zero)[2, 5])
    assert quantize.quantize(np.full((4, 20), 3.0, np.float32)) is None



def test_noise_constant_and_gradient():
    flat = quantize.noise(np.full((20, 30), 42.5, np.float32))
    assert flat["ngood"] == 600 and flat["noise3"] == 0 and flat["min"] == flat["max"] == 42.5
    noisy = RNG.normal(100, 5, (64, 256)).astype(np.float32)
    s = quantize.noise(noisy)
    assert all(abs(s[f"noise{k}"] - 5) < 0.5 for k in (2, 3, 5)) and abs(quantize.noise1(noisy) - 5) < 0.3

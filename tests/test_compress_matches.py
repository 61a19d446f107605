import random

from lodestone.codecs import compress


def test_a_long_match_behind_many_short_ones_is_found():
    rng = random.Random(3)
    part = bytes(rng.choices(b"abcd", k=6000))  # three bytes stand in some 90 places, of which TRIES are tried; eight in one
    data = rng.randbytes(256) + part + part
    packed = compress.compress(data)
    assert compress.decompress(packed) == data
    assert len(packed) < 0.55 * len(compress.compress(data[:256] + part)) * 2


def test_lengths_of_all_widths():
    rng = random.Random(4)
    for n in (3, 4, 5, 6, 9, 12, 13, 14, 43, 44, 45, 299, 300, 555, 1999, 2000, 2001, 5000):
        part = rng.randbytes(n)
        data = rng.randbytes(256) + b"z" * 900 + part + b"|" + part + b"q" * n
        assert compress.decompress(compress.compress(data)) == data

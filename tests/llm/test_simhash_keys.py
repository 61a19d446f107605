from itertools import combinations

from lodestone.llm import simhash
from pyspark.sql import functions as F


def test_keys_are_segments_and_their_balls(spark):
    """Keys that all rows share find the same links, but compare every fingerprint with every other."""
    fps = [0, -1, 0x0123456789ABCDEF, -0x0123456789ABCDEF]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for segments in (simhash.SEGMENTS, simhash.WIDE_SEGMENTS):
        for probe in (False, True):
            got = {r.fp: list(r.k) for r in df.select("fp", simhash._keys(F.col("fp"), segments, probe).alias("k")).collect()}
            for fp in fps:
                want = []
                for n, (shift, bits, radius) in enumerate(segments):
                    value = (fp % 2**64 >> shift & 2**bits - 1) | n << 32
                    want += [value ^ sum(1 << i for i in c) for size in range(radius + 1 if probe else 1) for c in combinations(range(bits), size)]
                assert sorted(got[fp]) == sorted(want)

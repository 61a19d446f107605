"""Names of coded values, and which failure to report when several readers have refused a file."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Audio codec by encode type (fixed values).
CODECS = {
    0: "adx",
    1: "lpcm",
    2: "hca",
    3: "adx",
    4: "wii-adpcm",
    5: "ds-adpcm",
    6: "hca-mx",
    7: "vag",
    8: "atrac3",
    9: "3ds-adpcm",
    10: "hevag",
    11: "atrac9",
    12: "xma2",
    13: "wiiu-adpcm",
    14: "hevag",
    18: "atrac9",
    19: "aac",
    24: "switch-opus",
}
#: Words of an error message and how far its reader got (fixed order: the first that fits counts).
DEPTHS = (("checksum", 5), ("cut off", 4), ("outside", 4), ("exceed", 4), ("missing", 3), ("unknown version", 2), ("magic", 0))


def _named(values: dict, code: Column) -> Column:
    return F.try_element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())), code.cast("int"))


def codec(encode_type: Column) -> Column:
    """Codec of an encode type; null for one that is not known, where the payload has to tell."""
    return _named(CODECS, encode_type)


def suspicion(message: Column) -> Column:
    """How far a reader got before it failed, by its message: a wrong magic is no evidence, a wrong checksum is."""
    out = None
    for word, depth in DEPTHS:
        hit = F.contains(F.lower(message), F.lit(word))
        out = F.when(hit, depth) if out is None else out.when(hit, depth)
    return out.otherwise(1)


def best_failure(tried: DataFrame, file: str, attempt: str, failure: str) -> DataFrame:
    """(file, failure): the failure of the reader that got furthest, the first of equal ones."""
    order = F.struct(suspicion(F.col(failure)).alias("d"), (-F.col(attempt)).alias("a"))
    return tried.groupBy(file).agg(F.max_by(failure, order).alias(failure))

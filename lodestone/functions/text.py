"""Text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters trimmed: blanks and the zero byte.
BLANKS = " \t\n\r\x0b\x0c\x00"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def trim_ascii(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def equals_nocase(a: Column, b: Column) -> Column:
    return lower_ascii(a) == lower_ascii(b)


def starts_nocase(a: Column, prefix: Column) -> Column:
    return F.startswith(lower_ascii(a), lower_ascii(prefix))


def safe_name(c: Column, empty: str = "unnamed") -> Column:
    """A file name: control characters and those that file systems refuse become underscores."""
    clean = F.regexp_replace(c, r'[\x00-\x1f<>:"/\\|?*]', "_")
    bare = F.rtrim(clean, F.lit(" ."))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(empty)).otherwise(bare)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return lower_ascii(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def normal_path(path: Column) -> Column:
    """Slashes turned and doubled ones merged, without leading and trailing ones."""
    return F.trim(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), F.lit("/"))


def template(pattern: str, index: Column, ext: Column, stem: Column) -> Column:
    """Export names: ?i, ?e and ?s stand for the index, the extension and the stem."""
    return F.replace(F.replace(F.replace(F.lit(pattern), F.lit("?i"), index.cast("string")), F.lit("?e"), ext), F.lit("?s"), stem)


def leading_number(c: Column) -> Column:
    """The number a text begins with, for natural sorting; null without one."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d{1,18})", 1), F.lit("")).cast("long")


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _part(ms: Column, unit: int, limit: int | None = None) -> Column:
    whole = ((ms - F.pmod(ms, F.lit(unit))) / unit).cast("long")
    return whole if limit is None else F.pmod(whole, F.lit(limit))


def srt_time(ms: Column) -> Column:
    """hh:mm:ss,mmm"""
    return F.concat(_pad(_part(ms, 3_600_000), 2), F.lit(":"), _pad(_part(ms, 60_000, 60), 2), F.lit(":"), _pad(_part(ms, 1000, 60), 2), F.lit(","), _pad(F.pmod(ms, F.lit(1000)), 3))


def ass_time(ms: Column) -> Column:
    """h:mm:ss.cc, centiseconds cut"""
    return F.concat(_part(ms, 3_600_000).cast("string"), F.lit(":"), _pad(_part(ms, 60_000, 60), 2), F.lit(":"), _pad(_part(ms, 1000, 60), 2), F.lit("."), _pad(_part(ms, 10, 100), 2))


def parse_time(c: Column) -> Column:
    """Milliseconds of hh:mm:ss,mmm or h:mm:ss.cc; null if it is neither."""
    m = lambda i: F.regexp_extract(c, r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{2,3})\s*$", i)
    good = F.regexp_like(c, F.lit(r"^\s*\d+:[0-5]\d:[0-5]\d[,.]\d{2,3}\s*$"))
    return F.when(good, m(1).cast("long") * 3_600_000 + m(2).cast("long") * 60_000 + m(3).cast("long") * 1000 + F.rpad(m(4), 3, "0").cast("long"))


def checksum769(data: Column, seed: int = 0) -> Column:
    """The archive checksum of bytes or text: fold by factor 769 in 32 bits, 0 counts as 1, complement."""
    digits = F.hex(data.cast("binary"))
    at = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    byte = lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long")
    folded = F.when(F.length(digits) < 2, F.lit(seed).cast("long")).otherwise(F.aggregate(at, F.lit(seed).cast("long"), lambda s, i: (s * 769 + byte(i)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.lit(0xFFFFFFFF).bitwiseXOR(F.when(folded == 0, F.lit(1).cast("long")).otherwise(folded))


def sniff(head: Column) -> Column:
    """Kind of a payload by its first bytes, given as upper-case hex; null if none is known."""
    kind = None
    for magic, name in MAGICS:
        hit = F.startswith(head, F.lit(magic.hex().upper()))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


#: First bytes of the formats (fixed values).
MAGICS = (
    (b"@UTF", "utf"),
    (b"CPK ", "cpk"),
    (b"AFS2", "awb"),
    (b"AFS\x00", "afs"),
    (b"CRID", "usm"),
    (b"SFSH", "usm"),
    (b"AIXF", "aix"),
    (b"HCA\x00", "hca"),
    (b"\xc8\xc3\xc1\x00", "hca"),
    (b"RIFF", "wav"),
    (b"CVMH", "cvm"),
    (b"CRILAYLA", "crilayla"),
    (b"DKIF", "ivf"),
    (b"\x00\x00\x01\xba", "sfd"),
    (b"\x00\x00\x01\xb3", "mpeg"),
    (b"\x00\x00\x00\x01", "h264"),
    (b"\x80\x00", "adx"),
)


def lookup_path(path: Column) -> Column:
    """Key of case-insensitive path look-ups: normal slashes, ASCII upper case."""
    return upper_ascii(normal_path(path))


def packed_time(stamp: Column) -> Column:
    """Six numbers (year, month, day, hour, minute, second) as a timestamp; null where they are no date."""
    return F.try_make_timestamp(*[F.get(stamp, F.lit(i)) for i in range(6)])


def unescape_markup(c: Column) -> Column:
    """Subtitle text without {..} markup, \\N as a line break."""
    return F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}", ""), r"\\[Nn]", "\n")


def escape_markup(c: Column) -> Column:
    return F.regexp_replace(c, "\r?\n", r"\\N")

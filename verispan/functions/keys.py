"""Comparable forms of ids, content hashes, split names and months.

All functions take and return Columns built from JVM expressions, so they stay
inside whole-stage code generation and can be pushed into a scan's projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that may surround an id.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u2007\u202f\u200b\ufeff"

# Content hashes of an empty file (md5, sha1, sha256).
EMPTY_FILE_HASHES = (
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)

# Spellings of the four split names.
SPLIT_SPELLINGS = {
    "train": "train", "training": "train", "trn": "train",
    "validation": "validation", "valid": "validation", "val": "validation", "dev": "validation",
    "calibration": "calibration", "calib": "calibration", "cal": "calibration",
    "test": "test", "tst": "test", "testing": "test",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_id(x: Column | str) -> Column:
    """Trimmed, lower-cased id; null for null or blank."""
    t = F.lower(F.btrim(_c(x), F.lit(BLANKS)))
    return F.when(t != "", t)


def norm_hash(x: Column | str) -> Column:
    """Lower-case hex digits of a content hash; null where it stands for no file.

    An algorithm prefix (``sha256:``, ``md5-``, ``0x``), outer space and case do
    not count. No file: null, blank, not hexadecimal, under eight digits, one
    digit repeated, or the hash of an empty file.
    """
    t = F.regexp_replace(F.lower(F.btrim(_c(x), F.lit(BLANKS))), r"^(?:(?:sha|md|blake|xxh)[a-z0-9_-]*[:=/-]|0x)\s*", "")
    good = t.rlike(r"^[0-9a-f]{8,}$") & ~t.rlike(r"^(.)\1*$") & ~t.isin(*EMPTY_FILE_HASHES)
    return F.when(good, t)


def norm_number_key(x: Column | str) -> Column:
    """A numeric foreign id; null for null, zero and negative placeholders."""
    c = _c(x)
    return F.when(c > 0, c)


def norm_split(x: Column | str) -> Column:
    """One of train, validation, calibration, test; null for anything else."""
    t = F.lower(F.btrim(_c(x), F.lit(BLANKS)))
    pairs = [F.lit(v) for kv in SPLIT_SPELLINGS.items() for v in kv]
    return F.element_at(F.create_map(*pairs), t)


def norm_label(x: Column | str, allowed: tuple[str, ...] = ("supported", "hallucinated", "unknown")) -> Column:
    """Strict enum after trimming and lower-casing; null for anything else."""
    t = F.lower(F.btrim(_c(x), F.lit(BLANKS)))
    return F.when(t.isin(*allowed), t)


def norm_source(x: Column | str) -> Column:
    """Source name: case, outer space, hyphen against underscore do not count; null when blank."""
    t = F.translate(F.lower(F.btrim(_c(x), F.lit(BLANKS))), "-", "_")
    return F.when(t != "", t)


def norm_tag(x: Column | str) -> Column:
    """Annotator tag: last part after ``annotator_``, upper-cased, trimmed; null when blank."""
    t = F.upper(F.regexp_replace(F.lower(F.btrim(_c(x), F.lit(BLANKS))), r"^annotator[_\s-]*", ""))
    return F.when(t != "", t)


def month(x: Column | str) -> Column:
    """yyyy-MM of a timestamp."""
    return F.date_format(_c(x), "yyyy-MM")

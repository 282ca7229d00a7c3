"""One stored form for text that looks the same on the screen.

``canonical`` looks for unstable characters first: those that are invisible,
a spacing other than U+0020, of wide or narrow form, drawn like a Latin letter,
or whose normalization quick check is not Yes. Only the runs of such
characters, each with the starter before it and the marks after it as boundary
context, are normalized; the results are spliced into the unchanged rest.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.session import cut

# Letters of other scripts drawn like a Latin letter.
DRAWN_ALIKE = {
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Cyrillic capital letters
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ӏ": "I",
    # Greek small letters
    "ϲ": "c", "ϳ": "j", "ο": "o", "ν": "v", "ρ": "p", "ι": "i",
    # Greek capital letters
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian letters
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "Օ": "O", "Ս": "U",
    # Cherokee letters
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

# Format characters that do show.
SHOWN_FORMATS = frozenset("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
# Ignorable characters outside category Cf.
HIDDEN_OTHERS = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0")
# Controls that lay text out.
LAYOUT_CONTROLS = frozenset("\t\n\x0b\x0c\r\x85")


def hidden(ch: str) -> bool:
    """True for a character that takes no place on the screen."""
    cat = unicodedata.category(ch)
    if cat == "Cf":
        return ch not in SHOWN_FORMATS
    if cat == "Cc":
        return ch not in LAYOUT_CONTROLS
    return ch in HIDDEN_OTHERS or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef"


@lru_cache(maxsize=65536)
def _stable(ch: str) -> bool:
    """True where the character stays as it is whatever its neighbours are."""
    if " " <= ch <= "~" or ch in LAYOUT_CONTROLS:
        return True
    if hidden(ch) or unicodedata.category(ch) == "Zs" or ch in DRAWN_ALIKE:
        return False
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
        return False
    # quick check: a mark, or one that may join the character before it, is not stable
    if unicodedata.combining(ch) or unicodedata.category(ch)[0] == "M" or "\u1160" <= ch <= "\u11ff":
        return False
    return _rewrite(ch) == ch


def _rewrite(s: str) -> str:
    """The canonical form of a segment, by itself."""
    out = []
    for ch in s:
        if hidden(ch):
            continue
        if unicodedata.category(ch) == "Zs" and ch != " ":
            out.append(" ")
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(DRAWN_ALIKE.get(ch, ch) for ch in unicodedata.normalize("NFD", "".join(out))))


def canonical(text: str | None) -> str | None:
    """The form in which texts that read the same compare as equal; null stays null.

    Letter case, digits, punctuation, accents and the number of spaces are kept.
    Idempotent. Texts of stable characters are returned as they are.
    """
    if not text:
        return text
    if text.isascii() and text.isprintable():
        return text
    bad = [ch for ch in set(text) if not _stable(ch)]
    if not bad:
        return text
    run = "[" + "".join(re.escape(c) for c in bad) + "]+"
    # the starter before the run may take its marks
    out = re.sub(f"(?s:.)?{run}", lambda m: _rewrite(m.group()), text)
    # removing hidden characters can bring a starter and marks together across segments
    return out if unicodedata.is_normalized("NFC", out) else canonical(unicodedata.normalize("NFC", out))


def hash128(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_FORMS = pa.schema([("_id", pa.int64()), ("_canon", pa.binary()), ("_stored", pa.binary()), ("_changed", pa.bool_()), ("_length", pa.int32())])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = canonical(t)
            h = hash128(t)
            for col, v in zip(cols, (i, h if c == t else hash128(c), h, c != t, len(c))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, _FORMS)], schema=_FORMS)


def canonical_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with non-empty text: 128-bit keys of the canonical and of the stored text.

    Columns: _id, _canon, _stored, _changed, _length (code points of the canonical
    form). Null and empty texts give no row; extra columns of docs do not matter.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null and _text != ''")
    return d.mapInArrow(_forms, "_id long, _canon binary, _stored binary, _changed boolean, _length int")


def canonical_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "canonical_text", keep_text: bool = False) -> DataFrame:
    """id, the stored text where asked for, and the canonical text; null and empty texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *([b.column(1)] if keep_text else []), new], names=["_id", *(["_text"] if keep_text else []), "_new"])

    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "_id long, _text string, _new string" if keep_text else "_id long, _new string")
    return d.select(F.col("_id").alias(id_col), *([F.col("_text").alias(text_col)] if keep_text else []), F.col("_new").alias(out_col))


def same_look_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of a look with two or more stored variants: id, class_id (the least id of the look), n_variants.

    As many rows as documents, however often a text is repeated: variants are
    counted over distinct (look, variant) rows, combined on the map side.
    """
    forms = cut(canonical_forms(docs, id_col, text_col).select("_id", "_canon", "_stored").distinct())
    looks = forms.groupBy("_canon", "_stored").agg(F.min("_id").alias("_low")).groupBy("_canon").agg(F.min("_low").alias("class_id"), F.count(F.lit(1)).alias("n_variants")).where("n_variants > 1")
    return forms.join(looks, "_canon").select(F.col("_id").alias(id_col), "class_id", "n_variants")


def same_look_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs (doc_id_a < doc_id_b) that read the same but are stored differently.

    Texts are first grouped into stored variants, so copies of one variant are
    never paired with each other; only looks with two or more variants are
    joined. The rows are as many as the result asks for. Repeated rows of a
    document count once.
    """
    forms = cut(canonical_forms(docs, id_col, text_col).select("_id", "_canon", "_stored").distinct())  # keys only: texts are read once
    looks = forms.groupBy("_canon").agg(F.min("_stored").alias("_lo"), F.max("_stored").alias("_hi")).where("_lo != _hi").select("_canon")
    some = forms.join(looks, "_canon")
    variants = some.select("_canon", "_stored").distinct()
    v2 = variants.select("_canon", F.col("_stored").alias("_other"))
    pairs = variants.join(v2, "_canon").where(F.col("_stored") < F.col("_other"))
    a = some.select("_canon", "_stored", F.col("_id").alias("_a"))
    b = some.select("_canon", F.col("_stored").alias("_other"), F.col("_id").alias("_b"))
    full = pairs.join(a, ["_canon", "_stored"]).join(b, ["_canon", "_other"]).where("_a != _b")
    return full.select(F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b")).distinct()


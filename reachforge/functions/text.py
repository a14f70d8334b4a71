"""Text normalisers. NFKC and case folding need one vectorised UDF; all else is built in."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT, RECORD = "\u001f", "␞"


#: Bytes of the texts of an Arrow batch that are Python strings at a time.
SLICE_BYTES = 1_000_000


def slices(texts, most: int | None = None):
    """The parts of an Arrow array of texts, in order, each of at most so many bytes or of one text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = before = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + (most or SLICE_BYTES), side="right")))
        yield texts.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def folded(x: str | None) -> str | None:
    if x is None:
        return None
    return x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold()


def fold_texts(texts):
    """Of an Arrow array of texts; beside it and the result only a slice is held."""
    import pyarrow as pa

    parts = [pa.array([folded(x) for x in part.to_pylist()], texts.type) for part in slices(texts)]
    return pa.concat_arrays(parts) if parts else texts


def nfkc_casefold(c: Column) -> Column:
    return F.arrow_udf(fold_texts, StringType())(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_sharp_s(c: Column) -> Column:
    """NFKC and case folding for text that is composed Latin already; stays in the JVM."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalise_a(c: Column, fold=nfkc_casefold) -> Column:
    """For rules: keeps 0-9 a-z ä ö ü ß / ( ) + -."""
    return squeeze(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^0-9a-zäöüß/()+\-]+", " "))


def normalise_b(c: Column, fold=nfkc_casefold) -> Column:
    """For audit signatures: keeps 0-9 a-z ä ö ü ß."""
    return squeeze(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^0-9a-zäöüß]+", " "))


def normalise_c(c: Column, fold=nfkc_casefold) -> Column:
    """For stable signatures: punctuation stays."""
    return squeeze(fold(F.coalesce(c, F.lit(""))))


def normalise_d(c: Column, fold=nfkc_casefold) -> Column:
    """For page names: everything but word characters becomes space."""
    return squeeze(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def python_normalise_a(term: str) -> str:
    """normalise_a of a rule's term, when the rule table is compiled."""
    import re

    return " ".join(re.sub(r"[^0-9a-zäöüß/()+\-]+", " ", unicodedata.normalize("NFKC", term).casefold()).split())


def signature(parts: list[Column], separator: str) -> Column:
    """SHA-256 over parts; nulls count as empty, as concat_ws would skip them."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def audit_signature(brand: Column, fields: list[Column], fold=nfkc_casefold) -> Column:
    return signature([fold(F.trim(F.coalesce(brand, F.lit("")))), *[normalise_b(f, fold) for f in fields]], UNIT)


def stable_signature(page_id: Column, item_lists: list[Column], fold=nfkc_casefold) -> Column:
    """item_lists: arrays of text. Items are normalised one by one; the separator never occurs in a normalised item, so a list is normalised as one text."""
    joined = [F.array_join(F.transform(F.split(fold(F.array_join(items, RECORD)), RECORD), squeeze), RECORD) for items in item_lists]
    return signature([page_id, *joined], RECORD)

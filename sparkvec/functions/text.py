"""Text functions: terms, paths, clean input, checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: what is cut off a term's ends
PUNCTUATION = ".,!?;:()[]{}'\"><"

#: Unicode white space, as a class of Java's regular expressions
SPACE = r"[\s\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def tokenize(text: Column) -> Column:
    """Lower-cased pieces between white space, without punctuation at their ends; empty ones dropped. Null stays null."""
    return F.filter(F.transform(F.split(F.lower(text), SPACE), lambda t: F.trim(t, F.lit(PUNCTUATION))), lambda t: t != "")


def has_terms(text: Column) -> Column:
    """Whether a text has a term: a character that is neither white space nor cut off; found without splitting it."""
    cut = "".join("\\" + c for c in PUNCTUATION)
    return text.rlike("[^" + SPACE[1:-2] + cut + "]")


def document(*columns: Column) -> Column:
    """One text of several columns, joined by blanks; nulls are skipped."""
    return F.concat_ws(" ", *columns)


def namespace(path: Column) -> Column:
    """``(namespace, name)``: a/b/c -> (a, b/c); x and /x -> (default, x); a missing part is empty."""
    p = F.coalesce(path, F.lit(""))
    at = F.instr(p, "/")
    return F.struct(
        F.when(at <= 1, F.lit("default")).otherwise(F.substring_index(p, "/", 1)).alias("namespace"),
        F.when(at == 0, p).otherwise(F.substr(p, at + 1)).alias("name"),
    )


def fields(text: Column) -> Column:
    """The number of pieces between white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda t: t != ""))


def clean(text: Column, longest: int | None = None) -> Column:
    """Without control characters (other than tab and line ends) and white space at the ends; cut only if ``longest`` is given."""
    out = F.trim(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    return out if longest is None else F.substring(out, 1, longest)


#: fixed values of the 64-bit FNV-1a hash
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed number; all texts of a batch advance by one byte at a time."""

    @F.pandas_udf("bigint")
    def hashed(s: pd.Series) -> pd.Series:
        raw = [b"" if t is None else t.encode() for t in s]
        n = np.array([len(b) for b in raw], np.int64)
        flat, first = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(n) - n
        h = np.full(len(raw), FNV_START, np.uint64)
        longest_first = np.argsort(-n, kind="stable")
        open_ = np.searchsorted(-n[longest_first], -np.arange(1, int(n.max(initial=0)) + 1), "right")
        for i, m in enumerate(open_):
            at = longest_first[:m]
            h[at] = (h[at] ^ flat[first[at] + i]) * np.uint64(FNV_PRIME)
        return pd.Series(pd.arrays.IntegerArray(h.view(np.int64), s.isna().to_numpy()), index=s.index)

    return hashed(text)


def crc32(text: Column) -> Column:
    return F.crc32(text)


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' text joined by a bar."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)

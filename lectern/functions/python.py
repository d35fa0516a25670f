"""What the JVM has no expression for: Arrow-batched pandas functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import APOSTROPHES, DASHES, ELLIPSIS, NO_BREAK_SPACE, QUOTATION_MARKS, SOFT_HYPHEN

_SIGNS = {ord(c): "'" for c in APOSTROPHES} | {ord(c): '"' for c in QUOTATION_MARKS} | {ord(c): "-" for c in DASHES} | {ord(NO_BREAK_SPACE): " ", ord(SOFT_HYPHEN): "", ord(ELLIPSIS): "..."}


def slug_of(text: str | None, limit: int = 60) -> str:
    """Letters lose their accents; whatever else isn't a letter or digit of ASCII parts two words."""
    raw = text or ""
    plain = "".join(c for c in unicodedata.normalize("NFD", raw) if not unicodedata.category(c).startswith("M"))
    words = re.findall("[a-z0-9]+", plain.lower())
    return "-".join(words)[:limit].strip("-") or "book-" + hashlib.sha256(raw.encode()).hexdigest()[:8]


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    """A file-system name of at most 60 letters, digits and hyphens; a hash if nothing is left; null for null."""
    return text.map(slug_of, na_action="ignore")


_ONE_TO_ONE = {k: v for k, v in _SIGNS.items() if len(v) == 1} | {ord("Σ"): "σ"}  # the sign's lower form at a word's end depends on the context
_SPACES = np.array([p for p in range(0x10000) if not 0xD800 <= p < 0xE000 and chr(p).isspace()], dtype=np.uint32)
_SPECIAL = re.compile(f"[{SOFT_HYPHEN}{ELLIPSIS}]")


def normalized(text: str) -> tuple[str, np.ndarray]:
    """The form in which quotes are compared, and for each of its characters the position it comes from."""
    plain = text.translate(_ONE_TO_ONE)
    lower = plain.lower()
    if len(lower) == len(text) and not _SPECIAL.search(text):
        at = np.arange(len(text))
    else:  # some signs become none, two or three
        pieces = [_SIGNS.get(ord(c), c).lower() for c in plain]
        at = np.repeat(np.arange(len(text)), [len(x) for x in pieces])
        lower = "".join(pieces)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    space = np.isin(points, _SPACES)
    points[space] = 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    return points[keep].tobytes().decode("utf-32-le", "surrogatepass"), at[keep]


@F.pandas_udf(T.StringType())
def image_hash(gray: pd.Series) -> pd.Series:
    """64-bit gradient hash (16 hex digits) of an image given as rows of 9 by 8 grey values, row after row."""

    def of(values) -> str | None:
        if values is None or len(values) != 72:
            return None
        px = np.asarray(values, dtype=np.int64).reshape(8, 9)
        return np.packbits(px[:, :-1] > px[:, 1:]).tobytes().hex()

    return gray.map(of)

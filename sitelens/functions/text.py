"""Text functions as column expressions, with the semantics of the web platform where Spark's differ."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the white space of ECMAScript; Java's \s and trim know ASCII only.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def web_trim(c: Column) -> Column:
    """Strip every Unicode space from both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (web_trim(c) == "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: a character beyond the basic plane counts two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def half_up(c: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(c + 0.5).cast("bigint")


def collapse(c: Column) -> Column:
    return web_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def word_count(c: Column) -> Column:
    """Number of words between spaces; null and blank count 0."""
    return F.when(is_blank(c), 0).otherwise(F.size(F.split(collapse(c), " ")))


def normal_text(c: Column) -> Column:
    """Lower case, every run of characters other than ASCII letters, digits and underscore as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "))


def content_hash(c: Column) -> Column:
    """MD5 of the normal text: equal for texts that differ in case, marks and spacing only."""
    return F.md5(normal_text(c))


def shingles(c: Column, k: int = 3) -> Column:
    """Runs of ``k`` words of three or more letters, with repeats; of fewer words the words themselves.

    The runs are zipped from shifted slices: a lambda that held the word list would compute it anew for each run.
    """
    kept = F.filter(F.split(normal_text(c), " "), lambda w: F.length(w) > 2)
    runs = F.arrays_zip(*[F.slice(kept, j + 1, F.greatest(F.size(kept) - (k - 1), F.lit(0))).alias(f"w{j}") for j in range(k)])
    return F.when(F.size(kept) < k, kept).otherwise(F.transform(runs, lambda r: F.concat_ws(" ", *[r[f"w{j}"] for j in range(k)])))


def _simhash(text: str | None, k: int) -> int | None:
    if text is None:
        return None
    words = [w for w in text.split(" ") if len(w) > 2]
    parts = words if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    if not parts:
        return 0
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in parts), np.uint8)
    votes = np.unpackbits(digests.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(parts), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _simhash_udf(texts: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([_simhash(t, n) for t, n in zip(texts, k)], dtype="Int64")


def simhash(c: Column, k: int = 3) -> Column:
    """64-bit SimHash over the shingles: bit i is set if most shingles' MD5 have bit i (lowest bit of the first byte first).

    A text without shingles has 0, a null text null; a tie leaves the bit clear.
    """
    return _simhash_udf(normal_text(c), F.lit(k))


def bit_string(c: Column) -> Column:
    """The 64 bits as text, bit 0 first."""
    return F.reverse(F.lpad(F.bin(c), 64, "0"))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def syllables(word: Column) -> Column:
    """Vowel groups of one or two letters, less a silent final e, at least 1; words of up to three letters have 1."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(letters, F.lit("[aeiouy]{1,2}"), F.lit(0)))
    silent = letters.endswith("e") & ~letters.endswith("le") & (groups > 1)
    return F.when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))


def reading_ease(c: Column) -> Column:
    """Flesch reading ease, rounded and held within 0 and 100; a blank text has 0, a null one null."""
    text = collapse(c)
    words = F.split(text, " ")
    n = F.size(words)
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda s: ~is_blank(s))))
    total = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, b: a + b)
    score = 206.835 - 1.015 * (n / sentences) - 84.6 * (total / n)
    return F.when(c.isNull(), None).when(is_blank(c), 0).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int"))

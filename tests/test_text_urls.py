import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions.urls import normalized, query_fields, resolved, url_host, url_path
from sitelens.operators.duplicates import band_masks


def values(spark, texts, *columns):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_spaces_lengths_and_blanks(spark):
    got = values(spark, ["  x\t", "  ﻿", "", None, "\U0001f600a"], T.web_trim(F.col("t")), T.is_blank(F.col("t")), T.utf16_length(F.col("t")), T.word_count(F.col("t")))
    assert got[0][:2] == ("x", False) and got[1][:2] == ("", True) and got[2][1:] == (True, 0, 0) and got[3] == (None, True, None, 0) and got[4][2] == 3


def test_reading_ease_and_syllables(spark):
    assert values(spark, ["the", "make", "table", "beautiful"], T.syllables(F.col("t"))) == [(1,), (1,), (2,), (4,)]
    assert values(spark, ["The cat sat.", "", None, " "], T.reading_ease(F.col("t"))) == [(100,), (0,), (None,), (0,)]


def plain_simhash(text, k=3):
    words = [w for w in __import__("re").sub("[^a-z0-9_]+", " ", text.lower()).strip().split(" ") if len(w) > 2]
    parts = words if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    votes = [0] * 64
    for p in parts:
        digest = hashlib.md5(p.encode()).digest()
        for i in range(64):
            votes[i] += 1 if digest[i // 8] >> (i % 8) & 1 else -1
    return "".join("1" if v > 0 else "0" for v in votes)


def test_simhash_equals_its_definition(spark):
    texts = ["", "one", "alpha beta gamma delta", "Ünïcode wörds and more words here", "x " * 500 + "long words repeated many times over and over"]
    got = values(spark, [*texts, None], T.bit_string(T.simhash(F.col("t"))), F.size(T.shingles(F.col("t"))))
    assert [g[0] for g in got[:-1]] == [plain_simhash(t) for t in texts] and got[-1][0] is None
    assert got[0][0] == "0" * 64


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3), st.integers(4, 8))
def test_every_close_pair_shares_a_band(value, flips, blocks):
    other = value
    for f in flips:
        other ^= 1 << f
    assert any((value & (m % 2**64)) == (other & (m % 2**64)) for m in band_masks(3, blocks))


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://x.com/a/?utm_source=q#h", "https://x.com/a"), ("https://x.com/", "https://x.com/"), ("https://X.com:443/a/../b", "https://x.com/b"), ("no url", "no url"), ("https://x.com/a?b=1&gclid=2", "https://x.com/a?b=1"), (None, None),
        ("https://x.com/für", "https://x.com/f%C3%BCr"), ("http://x.com:8080/p/", "http://x.com:8080/p"),
    ],
)
def test_normalized(url, expected):
    assert normalized(url) == expected
    assert normalized(normalized(url)) == normalized(url)


def test_resolved():
    assert resolved("../c?d#e", "https://x.com/a/b/") == "https://x.com/a/c?d"
    assert resolved("mailto:a@b", "https://x.com") is None and resolved(None, "https://x.com") is None and resolved("//[", "https://x.com") is None


def test_url_columns(spark):
    got = values(spark, ["HTTPS://u@Ex.com:80/A_b?x=1&x=2&&y#z", "https://x.com", "ftp://x", None], url_host(F.col("t")), url_path(F.col("t")), query_fields(F.col("t")))
    assert got[0] == ("ex.com", "/A_b", 3) and got[1] == ("x.com", "/", 0) and got[2][:2] == (None, None) and got[3][0] is None

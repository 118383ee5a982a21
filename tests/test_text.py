from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import text

NORMAL = [
    ("كاربر", "کاربر"), (None, ""), ("سلام!", "سلام"), ("صِدا", "صدا"), ("  سلام    ", "سلام"), ("می‌روم", "می روم"),
    ("LOGIN Error", "login error"), ("a_b$c+d", "a b$c+d"), ("Éa", "ea"), ("½", "1⁄2"), ("ﬁ", "fi"), ("İ", "i"), ("ß", "ß"),
    ("آن", "ان"), ("مسئول", "مسيول"), ("۱۲ ٣", "۱۲ ٣"), ("a  b", "a b"), ("", ""), (" \t\n", ""),
]


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(("given", "expected"), NORMAL)
def test_normalize(spark, given, expected):
    assert one(spark, given, text.normalize) == expected


def test_tokens_and_stop_words(spark):
    words = lambda t: text.tokens(text.normalize(t))
    assert one(spark, "حسابم قفل شده، چیکار کنم؟", words) == ["حسابم", "قفل", "شده", "چیکار", "کنم"]
    assert one(spark, "تغيير كلمه", words) == ["تغییر", "کلمه"]
    assert one(spark, "  ", words) == []
    assert one(spark, "اسم و اطلاعات از کجا اصلاح کنم", lambda t: text.without_stop_words(words(t))) == ["اسم", "اطلاعات", "اصلاح"]
    assert one(spark, "رمز رمز و", lambda t: text.without_stop_words(words(t))) == ["رمز", "رمز"]


def test_trigrams(spark):
    assert one(spark, "night ab nightx", text.trigrams) == ["nig", "igh", "ght", "ab", "htx"]
    assert one(spark, "", text.trigrams) == []


def test_digits_and_slug(spark):
    assert one(spark, "۱۲٣", text.fold_digits) == "123"
    assert one(spark, "12", text.persian_digits) == "۱۲"
    assert one(spark, " New_Item x ", text.slug) == "new-item-x"
    assert one(spark, "  ", text.slug) == "default"

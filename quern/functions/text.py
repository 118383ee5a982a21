"""Text normalisation, words, stop words and character n-grams as Spark expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are folded before decomposition, and the stop words, as results depend on them.
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک"}
STOP_WORDS = ("از", "به", "در", "با", "برای", "و", "یا", "که", "را", "رو", "تو", "این", "اون", "آن", "یک", "یه", "من", "ما", "شما", "چطور", "چجوری", "کجا", "کجاست", "چی", "چیکار", "کنم", "باید")
PERSIAN_DIGITS, ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"


def _image(text: str) -> str:
    """What composition, letter folding and the removal of marks make of a text."""
    folded = "".join(LETTERS.get(c, c) for c in unicodedata.normalize("NFKC", text))
    bare = "".join(c for c in unicodedata.normalize("NFD", folded) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare).replace("‌", " ")


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that become one (source, target; those that vanish last), and those that become several."""
    one, gone, many = {}, [], {}
    # Beyond U+FFFF: what has a decomposition, is a mark or is punctuation stands in these planes.
    for code in (*range(0x21, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        c = chr(code)
        if code > 0xFFFF and not unicodedata.decomposition(c) and unicodedata.category(c) != "Mn" and unicodedata.category(c)[0] != "P":
            continue
        image = _image(c)
        if len(image) == 1 and unicodedata.category(image)[0] == "P":
            image = " "  # by the tables of Python, which may know later characters than the JVM
        if image == c:
            continue
        if not image:
            gone.append(c)
        elif len(image) == 1:
            one[c] = image
        else:
            many[c] = image
    return "".join(one) + "".join(gone), "".join(one.values()), many


def normalize(text: Column) -> Column:
    """NFKC, folded letters, no marks, no punctuation, single spaces, lower case, trimmed; null gives ''.

    Built-in functions alone: a translate for one-to-one characters, and a look-up per character only in
    texts that lose characters when those that expand are taken out.
    """
    source, target, many = _tables()
    body = F.replace(F.coalesce(text, F.lit("")), F.lit("ئ"), F.lit("ئ"))
    body = F.translate(body, source, target)  # first, as what others expand to is not folded again
    # One literal, parted by characters that no text keeps, which the optimizer folds into a map.
    wide = F.str_to_map(F.lit("\x02".join(f"{c}\x01{image}" for c, image in many.items())), F.lit("\x02"), F.lit("\x01"))
    spelled = F.array_join(F.transform(F.split(body, ""), lambda c: F.coalesce(F.try_element_at(wide, c), c)), "")
    body = F.when(F.length(F.translate(body, "".join(many), "")) < F.length(body), spelled).otherwise(body)
    body = F.regexp_replace(body, r"\p{P}", " ")
    return F.trim(F.lower(F.regexp_replace(body, r"(?U)\s+", " ")))


def tokens(normal: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def without_stop_words(words: Column) -> Column:
    """Words that are no stop words; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(list(STOP_WORDS)))


def trigrams(normal: Column) -> Column:
    """The set of three-character windows of each word; words up to three characters stand whole."""
    grams = F.transform(
        tokens(normal),
        lambda w: F.when(F.length(w) <= 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))),
    )
    return F.array_distinct(F.flatten(grams))


def fold_digits(text: Column) -> Column:
    """Persian and Arabic digits to ASCII."""
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def persian_digits(text: Column) -> Column:
    """ASCII digits to Persian."""
    return F.translate(text, ASCII_DIGITS, PERSIAN_DIGITS)


def slug(text: Column, default: str = "default") -> Column:
    """Trimmed, lower case, hyphens for spaces and underscores; blank gives the default."""
    bare = F.lower(F.translate(F.trim(text), " _", "--"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))

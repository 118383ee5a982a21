"""Groups of spelling variants by rare-first prefixes of positional bigrams.

Words are counted over all texts. A word's bigrams, with their places, are ordered by how often the bigram
occurs in all words, the rarest first. One edit leaves all but two bigrams of either word as they
are, only moved by one place at most; so of the three rarest of each word, one at least is the
same. Words are joined on those three alone.

The edit stands wholly before or wholly behind that bigram, so what lies on its other side is equal, up to the
bigram's place; and in the part with the edit, the half without it is equal too. A word
therefore meets others under (side, equal part, half, length) with the places implied, and a
long list of words with one common bigram falls into short ones. Pairs that meet are verified by
their edit distance.

A word's form is its near word with the largest count, if that is ``ratio`` times its own at least. Counts
grow by that factor along forms, so chains are short; roots are found by doubling.

Defined results: a null text, or one without words, gives no word; rows with a null key and
repeated rows count like all others (with noise, a null key is written as nothing); words shorter than
``min_length`` code points are left out; counted words of fewer than four, of which one edit may leave no bigram, are near none; a word of any length is taken whole; equal counts go to the
smaller word in code-point order; an empty table gives no words; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, with_text

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
#: Bigrams that a word is found by: two more than one edit can destroy, less one.
RAREST = 3
#: Code points of words that have as many bigrams.
LEAST = RAREST + 1


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, noise: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n (long), its occurrences: runs of letters in lower case (A-Z only).

    With noise, a run loses one code point where noise divides the crc32 of key:run: known misspellings, to measure by.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))
    words = with_text(docs, key, text).select("doc_id", F.explode(runs).alias("word")).withColumn("word", F.translate("word", UPPER, SMALL))
    if noise:
        seen = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        words = words.select("word", seen.alias("h"))
        at = F.pmod("h", F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.pmod("h", F.lit(noise)) == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rarest_bigrams(counts: DataFrame) -> DataFrame:
    """word, n and pos (from 0) of each word's rarest bigrams; equally frequent ones by bigram and place."""
    each = F.transform(F.sequence(F.lit(0), F.length("word") - 2), lambda i: F.struct(F.substring("word", i + 1, F.lit(2)).alias("gram"), i.alias("pos")))
    grams = counts.where(F.length("word") >= LEAST).select("word", "n", F.explode(each).alias("g")).select("word", "n", "g.gram", "g.pos")
    # Two letters of 90: at most 8,100 rows.
    often = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("often")))
    found = grams.join(often, "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "pos"))).alias("all"))
    return found.select("word", "n", F.explode(F.slice("all", 1, RAREST)).alias("g")).select("word", "n", "g.pos")


def _meeting(side: int, part: Column, rest: Column) -> list[Column]:
    """Where a word meets others of its length, or one longer (as the shorter), and those one shorter (as the longer)."""
    spot = lambda longer, which, half, size: F.struct(F.lit(longer).alias("longer"), F.xxhash64(F.lit(side), part, F.lit(which), half, size).alias("spot"))
    n, size = F.length(rest), F.length("word")
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    own = [spot(False, 0, F.substring(rest, F.lit(1), half), size), spot(False, 1, F.substring(rest, half + 1, n), size)]
    # As the longer of two, one code point of the rest is left out.
    longer = [spot(True, 0, F.substring(rest, F.lit(1), less), size - 1), spot(True, 1, F.substring(rest, less + 2, n), size - 1)]
    return own + [F.when(n > 0, x) for x in longer]


def near_words(counts: DataFrame) -> DataFrame:
    """word, near and near_n for all pairs of words, both ways, that differ by one inserted, deleted or replaced code point."""
    pos, whole = F.col("pos"), F.length("word")
    left = F.substring("word", F.lit(1), pos + 2), F.substring("word", pos + 3, whole)
    right = F.substring("word", pos + 1, whole), F.substring("word", F.lit(1), pos)
    spots = F.array_compact(F.array(*_meeting(0, *left), *_meeting(1, *right)))
    placed = rarest_bigrams(counts).select("word", "n", F.explode(spots).alias("at")).select("word", "n", "at.longer", "at.spot")
    a = placed.where(~F.col("longer")).select("spot", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = placed.select("spot", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    met = a.join(b, "spot").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "a_n", "b", "b_n").dropDuplicates(["a", "b"])
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(ways.alias("p")).select("p.*")


def _roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """word and root, the end of its chain of forms, for words with a form: each round doubles the steps."""
    roots = scratch.keep(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = scratch.keep(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(roots)
        roots = far.select("word", "root")
        roots._quern_path = far._quern_path
        if far.where("moved").isEmpty():
            return roots


def spelling_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of counted words (word, n)."""
    scratch = Scratch(counts.sparkSession, "spelling")
    counts = scratch.keep(counts.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(counts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    formed = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    formed = scratch.keep(formed)
    roots = _roots(scratch, formed.where("form is not null").select("word", "form"))
    scratch.drop(counts)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

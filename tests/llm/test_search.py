"""Packing, lexical search and spelling variants against brute force, on odd rows too."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import lexical, packing, queries, spelling
from quern.llm.common import Scratch
from tests.llm import cases
from tests.test_catalogue import TABLES

ROWS = [*cases.odd_rows(), (8, dict(cases.odd_rows())[8]), (None, "no key but words"), (None, None)]
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.clashing(cases.frame(spark, ROWS)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, []).limit(0)


# -- 11: packing


def check_packed(rows, texts, window: int) -> list[tuple[int, int]]:
    """All ids of all documents in gapless pieces and sequences; the sizes and steps of the sequences."""
    whole = Tokenizer.from_file(WORDS)
    expected = sorted((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = []
    for number in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[number], key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and {r.context for r in by_sequence[number]} == {at} and at & (at - 1) == 0
        steps = {r.step for r in by_sequence[number]}
        assert len(steps) == 1
        sizes.append((at, steps.pop()))
    for i, ids in expected:
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return sizes


def test_packing_of_odd_rows(spark, docs, none):
    keyed = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(i, t) for i, t in dict(cases.odd_rows()).items()]
    for tiers, pool in (((4096, 2048, 1024, 512, 256), 1 << 20), ((64, 32, 16), 500)):
        found = packing.pack_sequences(cases.clashing(keyed), WORDS, 2, tiers, pool, 4 * tiers[0]).collect()
        check_packed(found, texts, tiers[0])
    # Rows with a null key and repeated rows are documents of their own.
    assert sum(r.length for r in packing.pack_sequences(docs, WORDS, 2).collect()) > sum(r.length for r in found)
    empty = packing.pack_sequences(none, WORDS, 2)
    assert empty.count() == 0 and empty.columns == packing.pack_sequences(docs, WORDS, 2).columns


@pytest.mark.skipif(not TABLES.exists(), reason="no tables here")
def test_packing_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    sizes = check_packed(queries.op11_packing(spark, str(TABLES)).collect(), texts, 4096)
    assert sum(n for n, _ in sizes) > 0.9 * sum(n for n, _ in sizes if n >= 256)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([(64, 32, 16), (8,), (16, 8, 4, 2, 1)]))
def test_pools_are_packed_without_gaps(lengths, tiers):
    pool = packing.Pool()
    for k, n in enumerate(lengths):
        pool.put((k, 0, n % (tiers[0] + 1) or 1))
    total = sum(p[2] for p in pool.rest())
    done, left = packing.pack_tiers(pool, tiers)
    assert not pool.rest() and sum(p[2] for p in left) < tiers[0]
    assert all(size in tiers and sum(p[2] for p in pieces) == size for size, pieces in done)
    rest = packing.powers(left)
    assert all(sum(p[2] for p in pieces) == size and size & (size - 1) == 0 for size, pieces in rest) and len({s for s, _ in rest}) == len(rest)
    assert sum(s for s, _ in done) + sum(s for s, _ in rest) == total
    seen = defaultdict(list)
    for _, pieces in done + rest:
        for number, start, length in pieces:
            seen[number].append((start, length))
    for spans in seen.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0


def test_steps_are_even_and_mixed(spark):
    made = {4096: 37, 1024: 101, 256: 999, 8: 1}
    rows = [(1, 0, c, 0, c, p, c, k, 0) for c, n in made.items() for p in range(3) for k in range(n * (p + 1) // 3 - n * p // 3)]
    scratch = Scratch(spark, "steps")
    found = packing.number_sequences(scratch, scratch.keep(spark.createDataFrame(rows, packing.PIECES)), 8192).collect()
    assert sorted(r.sequence_id for r in found) == list(range(sum(made.values())))
    steps = defaultdict(lambda: defaultdict(int))
    for r in found:
        steps[r.step][r.context] += 1
    assert sorted(steps) == list(range(len(steps))) and all(len(s) == 1 for s in steps.values())
    order = [next(iter(steps[k])) for k in sorted(steps)]
    for context, n in made.items():
        each = [s[context] for s in steps.values() if context in s]
        assert sum(each) == n and max(each) - min(each) <= 1 and max(each) * context <= 8192
        # Half of a context's steps stand in the first half of all, to one.
        assert abs(order[: len(order) // 2].count(context) - order.count(context) / 2) <= 1


# -- 12: lexical search

ITEMS = [(1, "one TWO tied"), (2, ""), (3, None), (4, "zzz unheard"), (5, "ab one"), (5, "tied ab"), (None, "one"), (6, "x60 x61 x62 end")]


def test_search_of_odd_rows(spark, docs, none):
    items = cases.clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    items = items.unionByName(cases.clashing(spark.createDataFrame([(20 + k, t) for k, t in ROWS if t and len(t) < 2000 and k], "item_id long, text string")))
    asked = [(r.item_id, r.text) for r in items.collect()]
    expected = cases.lexical([r for r in ROWS if r[0] is not None], asked)
    for pairs in (1 << 18, 40):
        found = lexical.lexical_topk(docs, items, block_pairs=pairs)
        assert {tuple(r) for r in found.collect()} == expected and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert {r.item_id for r in found.collect()}.isdisjoint({2, 3, 4})
    assert lexical.lexical_topk(none, items).count() == 0 and lexical.lexical_topk(docs, items.limit(0)).count() == 0


def test_search_with_many_ties_and_small_chunks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "same words here") for k in range(700)] + [(1000 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))) for k in range(300)]
    rng.shuffle(rows)
    items = [(k, " ".join(rng.sample("abcdefgh", 3))) for k in range(20)] + [(99, "same")]
    found = lexical.lexical_topk(cases.frame(spark, rows, 4), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == cases.lexical(rows, items)
    assert [r.doc_id for r in found.where("item_id = 99").orderBy("rank").collect()] == list(range(10))


def test_best_and_radix():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 40, 5000)
    assert (keys[lexical.radix_order(keys)] == np.sort(keys)).all() and not len(lexical.radix_order(keys[:0]))
    best, seen = lexical.Best(3, 4), defaultdict(list)
    for _ in range(20):
        item, doc, score = rng.integers(0, 3, 50), rng.integers(0, 10**6, 50), rng.integers(1, 9, 50)
        best.add(item, doc, score)
        for i, d, s in zip(item.tolist(), doc.tolist(), score.tolist(), strict=True):
            seen[i].append((s, -d))
    assert [sorted(h) for h in best.heaps] == [sorted(seen[i])[-4:] for i in range(3)]


def test_accumulation_does_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    block = lexical.Block(rng.integers(0, 30, 400), rng.integers(-(1 << 62), 1 << 62, 50)[rng.integers(0, 50, 400)])
    sizes = rng.integers(0, 20, 60)
    terms, tfs = rng.integers(0, len(block.vocabulary), sizes.sum()), rng.integers(1, 5, sizes.sum())
    weights, docs, m = rng.integers(0, 5000, len(block.vocabulary)), np.arange(60) * 3, rng.integers(10, 500, 60)
    got = []
    for entries in (1, 100, 1 << 20):
        monkeypatch.setattr(lexical, "CHUNK_ENTRIES", entries)
        best = lexical.Best(len(block.ids), 5)
        lexical.accumulate(block, weights, best, docs, m, sizes, terms, tfs)
        got.append([sorted(h) for h in best.heaps])
    assert got[0] == got[1] == got[2]


# -- 13: spelling variants


def test_spelling_of_odd_rows(spark, docs, none):
    counts = spelling.word_counts(docs, 2, 1, 7)
    expected = cases.spelling_counts([(i, t) for i, t in ROWS], 7, 2, 1)
    assert {r.word: r.n for r in counts.collect()} == expected
    plain = spelling.word_counts(docs, 1, 2)
    assert "tied" in {r.word for r in plain.collect()} and spelling.word_counts(none).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(none)).count() == 0


def test_spelling_variants_equal_all_pairs(spark):
    rng = random.Random(11)
    words: dict[str, int] = {}
    for _ in range(60):
        word = "".join(rng.choice("abñ") for _ in range(rng.randrange(6, 10)))
        words[word] = rng.randrange(5, 5000)
        for _ in range(12):
            k, c = rng.randrange(len(word)), rng.choice("abcÀñ")
            variant = rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word + c, c + word])
            if len(variant) >= 6:
                words.setdefault(variant, rng.randrange(5, 300))
            word = variant if rng.random() < 0.3 and len(variant) > 6 else word
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "aaaaaaaaaa": 3125, "x" * 3000: 9, "x" * 2999 + "y": 50}
    words |= {"abcdef": 5, "abcdeg": 25, "abcdeh": 25}
    counts = spark.createDataFrame([(w, n, "own") for w, n in words.items()], "word string, n long, spot string").repartition(3)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(counts).collect()}
    assert found == cases.spelling(words)
    # All words of four to six of two letters; shorter ones are near none.
    every = {"".join(w): 5 + zlib.crc32("".join(w).encode()) % 997 for n in (3, 4, 5, 6) for w in itertools.product("ab", repeat=n)}
    table = spark.createDataFrame(list(every.items()), "word string, n long")
    short = {w: (None, w, n, 0, None) for w, n in every.items() if len(w) < 4}
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(table).collect()} == cases.spelling({w: n for w, n in every.items() if len(w) > 3}) | short
    assert found["aaaaaa"][1] == "aaaaaaaaaa" and found["abcdef"][0] == "abcdeg" and found["x" * 3000][0] == "x" * 2999 + "y"


def test_rarest_bigrams_are_ordered_by_how_often_they_occur(spark):
    counts = spark.createDataFrame([("ababab", 5), ("abxyab", 5), ("abab", 9)], "word string, n long")
    found = defaultdict(set)
    for r in spelling.rarest_bigrams(counts).collect():
        found[r.word].add(r.pos)
    # xy, bx and ya occur once, ba three times, ab seven times.
    assert found == {"ababab": {1, 3, 0}, "abxyab": {1, 2, 3}, "abab": {1, 0, 2}}

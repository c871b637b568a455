"""Lexical search, collocations and packing against brute-force versions."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywatch.llm import collocations, lexical_search, packing

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, score double, rank int, part string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- search


def terms(text):
    return re.findall(lexical_search.TERM, (text or "").translate(LOWER))


def plain_search(docs, items, top=10):
    sized = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    total, words = len(sized), sum(sum(c.values()) for _, c in sized)
    df = Counter(t for _, c in sized for t in c)
    out = []
    for item, text in items:
        ranked = []
        for i, count in sized:
            m = 10 + 90 * sum(count.values()) * total // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * (10**9 * count[t] // (1000 * count[t] + 8 * m))
                for t in set(terms(text))
                if count[t]
            )
            if score:
                ranked.append((-score, i is None, i))
        ranked.sort(key=lambda r: r if not r[1] else r[:2])
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(ranked[:top])]
    return sorted(out, key=str)


def searched(docs, items, **options):
    found = lexical_search.search(docs, items, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def test_search_given_tables(spark, docs):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain_search(
        [tuple(r) for r in docs.select("doc_id", "text").collect()],
        [tuple(r) for r in items.select("item_id", "text").collect()],
    )
    assert searched(docs, items) == want


def test_search_awkward_rows(spark):
    rows = [
        (1, "Red fox, red FOX; a fox", "x", 0.5, 1, "p", "r"),
        (1, "Red fox, red FOX; a fox", "x", 0.5, 1, "p", "r"),
        (None, "red red ÉÉ é", None, None, None, None, None),
        (None, "red red ÉÉ é", None, None, None, None, None),
        (2, None, None, None, None, None, None),
        (3, "", None, None, None, None, None),
        (4, " .,;\x00\x7f", None, None, None, None, None),
        (5, "fo x-fox1 1fox redfox", None, None, None, None, None),
        (6, "pad " * 50_000 + "fox", None, None, None, None, None),
    ] + [(k, "red", None, None, None, None, None) for k in range(20, 45)]
    items = [(7, "the RED fox"), (7, "é"), (None, "Fox fox"), (8, None), (9, "..."), (10, "nothing")]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search([r[:2] for r in rows], items)
    assert searched(docs, bench) == want
    # Several automata give the same ranks.
    assert searched(docs, bench, max_postings=1) == want


def test_search_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "red")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red")], "doc_id long, text string")
    assert searched(empty, bench) == []
    assert searched(docs, bench.limit(0)) == []
    assert searched(docs.limit(0), bench.limit(0)) == []


def test_search_string_ids(spark):
    docs = spark.createDataFrame([("b", "red"), ("a", "red")], "name string, body string")
    bench = spark.createDataFrame([("q", "red")], "q string, body string")
    found = lexical_search.search(docs, bench, "name", "body", "q", "body")
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == ["a", "b"]


# --- collocations


def plain_collocations(rows, most=3, least=10, share=50, top=2000):
    count = defaultdict(Counter)
    total = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for k in range(1, most + 1):
                count[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        ranked = []
        for p, a in found.items():
            if inner[p] and 100 * inner[p] >= share * a:
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def collocated(docs, **options):
    found = collocations.collocations(docs, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations_given_tables(docs, most):
    want = plain_collocations([tuple(r) for r in docs.select("lang", "text").collect()], most)
    assert collocated(docs, max_words=most) == want


def test_collocations_awkward_rows(spark, monkeypatch):
    rows = [
        (None, "a b c. A\tB  c!a b c\nd", None),
        (None, "a b c. A\tB  c!a b c\nd", None),
        (1, "x y\x0bx y\x0cx y\rx y", "und"),
        (2, None, "en"),
        (3, "", "en"),
        (4, " .,;:!?\n", "en"),
        (5, "É é É é É é é\x00 z", "la\tng x"),
        (6, "É é É é É é é\x00 z", "la\tng x"),
        (7, ("to be or not to be " * 4000) + "that", "en"),
        (8, " ".join(f"w{i % 11} v{i % 7}" for i in range(3000)), ""),
    ]
    docs = spark.createDataFrame(
        [(i, t, lang, 0.5, 3, "p", "r") for i, t, lang in rows], DOCS
    )
    plain = [(lang, t) for _, t, lang in rows]
    want = plain_collocations(plain, least=2)
    assert collocated(docs, min_count=2) == want
    # Texts handled in short segments, and windows sent on early.
    monkeypatch.setattr(collocations, "_SEGMENT", 64)
    monkeypatch.setattr(collocations, "_WINDOWS", 50)
    assert collocated(docs, min_count=2) == want
    # Prefixes dealt to several tasks.
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.0)
    assert collocated(docs, min_count=2) == want
    assert collocated(docs, min_count=2, top=3) == plain_collocations(plain, least=2, top=3)


def test_collocations_exact_products(spark):
    """Products beyond 64 bits; scores that differ in the last place only."""
    a, left, right = 3_000_000_019, 3_000_000_021, 9_000_000_000_000
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    score = collocations.cut_score(F.col("a"), F.col("l"), F.col("r"))
    assert row.select(score).first()[0] == 10**6 * a * a // (left * right)


def test_collocations_empty_table(empty):
    assert collocated(empty) == []


def test_collocations_refuses_lengths(docs):
    with pytest.raises(ValueError):
        collocations.collocations(docs, max_words=5)


# --- packing


def plain_best_fit(lengths, capacity):
    """Bins of best-fit decreasing, one piece after the other."""
    left = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= size]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= size
        else:
            left.append(capacity - size)
    return len(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_best_fit_and_bound(lengths):
    sizes = np.array(lengths)
    bins, offsets = packing.best_fit_decreasing(sizes, 40)
    assert bins.max() + 1 == plain_best_fit(lengths, 40) == len(set(bins.tolist()))
    for b in range(bins.max() + 1):
        at = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in at] == np.cumsum([0, *[s for _, s in at]])[:-1].tolist()
        assert sum(s for _, s in at) <= 40
    bound = packing.lower_bound(np.bincount(sizes, minlength=41), 40)
    assert -(-sum(lengths) // 40) <= bound <= bins.max() + 1


def test_bound_beats_the_sum():
    # Three of 21 need a bin each, though their sum fits two bins of 40.
    assert packing.lower_bound(np.bincount([21, 21, 21], minlength=41), 40) == 3
    # Two of 14 fill a bin as far as any third is concerned.
    assert packing.lower_bound(np.bincount([14] * 6, minlength=41), 40) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bound_never_above_the_best(lengths):
    def fewest(rest, left):
        if not rest:
            return len(left)
        tried, best = set(), len(left) + len(rest)
        for i, x in enumerate(left):
            if x >= rest[0] and x not in tried:
                tried.add(x)
                best = min(best, fewest(rest[1:], [*left[:i], x - rest[0], *left[i + 1 :]]))
        return min(best, fewest(rest[1:], [*left, 12 - rest[0]]))

    bound = packing.lower_bound(np.bincount(lengths, minlength=13), 12)
    assert bound <= fewest(sorted(lengths, reverse=True), [])


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 0] for e in found]


def check_packing(result, documents, capacity):
    """Every document's ids are there in order, and every sequence is gapless."""
    rows = result.rows.collect()
    want = Counter()
    for (doc_id, _), ids in zip(documents, whole_ids([t for _, t in documents]), strict=True):
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            want[(doc_id, piece, start, len(part), crc)] += 1
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) == result.sequences >= result.bound
    return len(sequences)


def test_packing_given_tables(docs):
    documents = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    result = packing.pack(docs)
    assert check_packing(result, documents, 2048) <= result.bound + 1


def test_packing_exchange(docs):
    """Small partitions leave open bins; exchanging them comes close to the bound."""
    documents = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    result = packing.pack(docs, capacity=512, per_part=40)
    assert result.rounds > 1
    # One partition's packing is as good as all of them after the exchange.
    single = packing.pack(docs, capacity=512)
    used = check_packing(result, documents, 512)
    assert used <= single.sequences + 1


def test_packing_awkward_rows(spark, empty):
    texts = [
        (1, "Some <|endoftext|> words, it's <|startoftext|>x é́ ﬁ İ ß   　 ok"),
        (1, "Some <|endoftext|> words, it's <|startoftext|>x é́ ﬁ İ ß   　 ok"),
        (2, None),
        (3, ""),
        (4, " \t\n"),
        (None, "a ̈b é ᄀ ᅡ don't 'S"),
        (2**60 + 1, "x" * 5000 + " " + "long " * 9000),
        (7, "It's A.B.C., (x), y.) Z). <|EndOfText|>, 9,000.5, wo\u0301, w\u0301. ok?!) \u2014, .,a, !'S can't, I'M."),
        (6, "\U0001f600‍ y\x1cz\x85w"),
    ]
    docs = spark.createDataFrame([(i, t, "en", 0.5, 3, "p", "r") for i, t in texts], DOCS)
    check_packing(packing.pack(docs), texts, 2048)
    check_packing(packing.pack(docs, capacity=7, per_part=3), texts, 7)
    result = packing.pack(empty)
    assert result.rows.collect() == [] and result.sequences == result.bound == 0


def test_word_memory_is_emptied(docs, monkeypatch):
    texts = [r[0] or "" for r in docs.select("text").limit(40).collect()]
    want = [np.array(i[:-1], "<u4").tobytes() for i in whole_ids(texts)]
    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    words = packing.WordIds(packing.default_tokenizer())
    assert [i for t in texts for i in words.ids([t.encode()])] == want
    groups = packing.grouped((t.encode() for t in texts), 5000)
    assert [i for group in groups for i in words.ids(group)] == want
    assert max(len(words.known), len(words.older)) <= 50


def test_dual_feasible_values():
    """The second family by fractions, for one set of lengths."""
    lengths, capacity = [5, 7, 9, 14, 14, 20, 27], 40
    best = 0
    for k in range(1, 101):
        total = Fraction(0)
        for s in lengths:
            x = Fraction((k + 1) * s, capacity)
            total += Fraction(s, capacity) if x.denominator == 1 else Fraction(math.floor(x), k)
        best = max(best, math.ceil(total))
    assert packing.lower_bound(np.bincount(lengths, minlength=41), capacity) >= best

"""Spelling variants against brute force, and on odd input."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(count):
    out = {}
    for w, n in count.items():
        near = [v for v in count if one_edit(w, v)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        out[w] = [best if best and count[best] >= 2 * n else None, n, len(near)]
    result = {}
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, n, near, count[form] if form else None)
    return result


def counted(rows, damage=None):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed=5):
    rng = random.Random(seed)
    stems = ["river", "garden", "Straße", "élève", "Élève", "window", "paper", "naïveté", "aaaaa", "aaaaaa", "stone×s", "lightly"]
    words = []
    for s in stems * 40:
        w = list(s)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(w))
            w[i:i + rng.choice([0, 1])] = [rng.choice("aeéÿrst")] if rng.random() < 0.7 else []
        words += ["".join(w)] * rng.choice([1, 3, 4, 8, 30])
    rng.shuffle(words)
    return [(k, rng.choice([" ", "\n", "-"]).join(words[k::30])) for k in range(30)]


@pytest.mark.parametrize("damage", [None, 3, 97])
def test_variants(spark, damage):
    rows = texts()
    want = grouped(counted(rows, damage))
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), damage=damage)) == want
    assert sum(f is not None for f, *_ in want.values()) > 10 and any(want[w][0] and want[w][0] != want[w][1] for w in want)


@pytest.mark.parametrize("size", spelling.ALPHABETS)
def test_alphabets_give_the_same(spark, size):
    words = counted(texts(6))
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling.group_variants(df, size=size)) == grouped(words)


def test_alphabet_grows_with_what_words_share(spark):
    words = spark.createDataFrame([("a" * 4 + x + y, 3) for x in "abcdefghijklmnopqrst" for y in "abcdefghijklmnopqrst"], "word string, n bigint")
    assert spelling.alphabet_for(words) > spelling.alphabet_for(words, spelling.Spelling(work=10_000, bucket=10_000)) == 4


def test_odd_rows_and_empty_table(spark):
    rows = texts(7)[:8]
    odd = rows + rows[:3] + [(None, rows[4][1]), (None, rows[4][1]), (100, None), (101, ""), (102, " \n1234"), (103, (rows[5][1] + " ") * 50)]
    df = spark.createDataFrame(odd, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("word", "n", "run", "id", "r", "root", "form", "near", "a", "b")])
    assert got(spelling.spelling_variants(df, damage=5)) == grouped(counted(odd, 5))
    for none in ([], [(1, None)], [(1, "abcd abcd abcd once twice")]):
        out = spelling.spelling_variants(spark.createDataFrame(none, SCHEMA), damage=97)
        assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]

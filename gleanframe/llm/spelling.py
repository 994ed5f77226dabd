"""Spelling variants: words one edit apart, found through a reduced alphabet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: Letters of words, by how common they are in European texts and then by code point.  Symbols are dealt along this line.
COMMON_FIRST = "etaoinsrhldcumfpgwybvkxjqz"
LETTERS = COMMON_FIRST + "".join(chr(c) for c in range(0xC0, 0x100))
#: Sizes of the reduced alphabet that are tried, smallest first; the last tells all letters apart.
ALPHABETS = (4, 8, 16, 32, len(LETTERS))


@dataclass(frozen=True)
class Spelling:
    """Words have at least ``least_signs`` code points and ``least_count`` occurrences; a form occurs ``times`` as often.

    The alphabet is the smallest with which words share reduced words so little that comparing them costs ``work``
    comparisons a word, and no reduced word stands for more than ``bucket`` words.  It sets the work, never the result.
    """
    least_signs: int = 5
    least_count: int = 3
    times: int = 2
    work: int = 16
    bucket: int = 256


def symbols(size: int) -> str:
    """For each of LETTERS its symbol: to and fro along the line, so that common letters are spread evenly."""
    there_and_back = [*range(size), *reversed(range(size))]
    return "".join(LETTERS[there_and_back[i % (2 * size)]] for i in range(len(LETTERS)))


def reduced(word: Column, size: int) -> Column:
    return word if size >= len(LETTERS) else F.translate(word, LETTERS, symbols(size))


def neighbourhood(word: Column, size: int) -> Column:
    """The reduced words that one edit leads to, and the word itself.

    Words that differ by an insertion are found from the longer one, by its deletions; those that differ by a
    replacement from the smaller one.  That is half of the neighbourhood, and every pair is met exactly in one half.
    """
    alphabet = F.array(*[F.lit(c) for c in (LETTERS if size >= len(LETTERS) else LETTERS[:size])])
    places = F.sequence(F.lit(1), F.length(word))
    left = lambda i: F.substring(word, F.lit(1), i - 1)
    right = lambda i: F.substring(word, i + 1, F.length(word))
    deleted = F.transform(places, lambda i: F.concat(left(i), right(i)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(alphabet, lambda c: c > F.substring(word, i, F.lit(1))), lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(F.array(word), deleted, replaced))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None,
                rule: Spelling = Spelling()) -> DataFrame:
    """(word, n): the lower-cased letter runs of all texts that are long and frequent enough.

    With ``damage``, runs lose one letter where ``damage`` divides the crc32 of ``<id>:<run>``: planted misspellings.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        text, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= rule.least_signs).select("id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if damage:
        hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (hashed % F.length("run")).cast("int")
        word = F.when(hashed % damage == 0, F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= rule.least_signs) & (F.col("n") >= rule.least_count))


def alphabet_for(words: DataFrame, rule: Spelling = Spelling()) -> int:
    for size in ALPHABETS[:-1]:
        shared = words.groupBy(reduced(F.col("word"), size).alias("r")).agg(F.count("*").alias("c"))
        work, largest, n = shared.agg(F.sum(F.col("c") * F.col("c")), F.max("c"), F.sum("c")).first()
        if (work or 0) <= rule.work * (n or 0) and (largest or 0) <= rule.bucket:
            return size
    return ALPHABETS[-1]


def near_words(words: DataFrame, size: int) -> DataFrame:
    """(a, n_a, b, n_b): all unordered pairs of ``words`` (word, n) that differ by one edit, each once."""
    buckets = stored(words.groupBy(reduced(F.col("word"), size).alias("r")).agg(F.collect_list(F.struct("word", "n")).alias("words")), "reduced")
    edited = buckets.select("r", F.explode(neighbourhood(F.col("r"), size)).alias("other"))
    # the reduced vocabulary comes first, without its words: most edited words are not in it
    met = edited.join(buckets.select(F.col("r").alias("other")), "other")
    pairs = (met.join(buckets.select("r", F.col("words").alias("left")), "r")
             .join(buckets.select(F.col("r").alias("other"), F.col("words").alias("right")), "other"))
    one = pairs.select(F.col("r") == F.col("other"), F.explode("left").alias("x"), "right").toDF("same", "x", "right")
    both = one.select("same", "x", F.explode("right").alias("y"))
    return (both.where((~F.col("same") | (F.col("x.word") < F.col("y.word"))) & (F.levenshtein("x.word", "y.word", 1) == 1))
            .select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")))


def group_variants(words: DataFrame, rule: Spelling = Spelling(), size: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n), whose words are distinct.

    Two words are near if one insertion, deletion or replacement of a code point turns one into the other.  ``form`` is
    the near word of largest n (of equal ones the smallest) if that n is ``times`` the word's or more, ``root`` the
    last word when forms are followed.  Letters are mapped to a few symbols, near words have reduced words that are
    equal or one edit apart, and pairs that meet so are verified on the words themselves.  No words, no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = near_words(words, size or alphabet_for(words, rule))
    turned = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = turned.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("first"))
    led = F.coalesce(-F.col("first.minus") >= rule.times * F.col("n"), F.lit(False))
    known = stored(words.join(best, "word", "left").select(
        "word", F.when(led, F.col("first.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(led, -F.col("first.minus")).alias("form_n")), "forms")
    roots = followed(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(steps: DataFrame) -> DataFrame:
    """(word, root): where the steps (word, root) lead in the end; each round doubles the way that is behind them."""
    now = stored(steps, "steps")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None,
                      rule: Spelling = Spelling()) -> DataFrame:
    """``group_variants`` of the words of all texts.

    Null and empty texts have no words; a null id is read as empty where runs are damaged; repeated rows count again;
    other columns are not looked at; an empty table gives no rows.
    """
    return group_variants(count_words(docs, key, text, damage, rule), rule)

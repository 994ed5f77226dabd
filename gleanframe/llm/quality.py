"""Quality rules by distribution divergence, in built-in expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
#: Very common words of each language: the bins of its word histogram, besides "any other word".
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "at", "this", "are", "from", "or", "an"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "plus"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"),
}
#: Character classes by what a regular expression keeps; "wide" counts the signs outside ASCII that are in no other
#: class, and all other signs (lower-case letters and the like) are the last class.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\x20\x09-\x0D", "mark": r"!\"'(),\-./:;?@\[\\\]^_`{}~+=", "symbol": r"#*$%&|<>"}
WIDE = r"[\x00-\x7F\p{Lu}\p{Nd}]+"                        # what is taken out to count the signs of "wide"


@dataclass(frozen=True)
class Divergence:
    """Limits of the Jensen-Shannon distance (base 2, from 0 to 1), and how much a histogram must count to be judged.

    A sample of n from the reference itself lies off by chance: the squared limit grows by bins / (8 ln 2 n) bits.
    """
    class_limit: float = 0.3
    word_limit: float = 0.22
    least_signs: int = 200
    least_words: int = 100
    words: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COMMON_WORDS))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows of ``window`` words that the text holds at least twice.

    Hashes whose lowest bits make room for the position are sorted; positions whose hash meets its like beside it are
    candidates, and only these are compared word by word: sorted as (words, position), equal neighbours count.
    """
    def count(w: Column) -> Column:
        n = F.size(w)
        room = F.length(F.bin(n.cast("bigint")))              # so many bits hold any position

        def marked(bits: Column) -> Column:
            places = F.sequence(F.lit(0), n - window)
            cleared = lambda h: F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
            tagged = F.transform(places, lambda i: cleared(F.xxhash64(*[F.get(w, i + k) for k in range(window)])).bitwiseOR(i.cast("bigint")))

            def near(s: Column) -> Column:
                twins = F.filter(F.sequence(F.lit(0), n - window - 1), lambda i: F.call_function(
                    "shiftright", F.get(s, i).bitwiseXOR(F.get(s, i + 1)), bits) == 0)
                place = lambda x: (x - cleared(x)).cast("int")
                return F.array_distinct(F.flatten(F.transform(twins, lambda i: F.array(place(F.get(s, i)), place(F.get(s, i + 1))))))

            return let(F.sort_array(tagged), near)

        def exact(places: Column) -> Column:
            pairs = F.transform(places, lambda i: F.struct(*[F.get(w, i + k).alias(f"w{k}") for k in range(window)], i.alias("i")))

            def equal(s: Column) -> Column:
                same = lambda a, b: F.coalesce(F.struct(*[a[f"w{k}"] for k in range(window)]) == F.struct(*[b[f"w{k}"] for k in range(window)]), F.lit(False))
                hits = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
                starts = F.sort_array(F.transform(hits, lambda x: x["i"]))
                return let(starts, lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))),
                    F.lit(0), lambda a, x: a + x))

            return let(F.sort_array(pairs), equal)

        return F.when(n <= window, F.lit(0)).otherwise(let(let(room, marked), lambda p: F.when(F.size(p) < 2, F.lit(0)).otherwise(exact(p))))

    return let(words, count)


def features(docs: DataFrame, rule: Divergence, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the counts of the base rules, the class histogram and the histogram of its language's words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rare = docs.withColumn("_rare", F.regexp_replace(text, "[a-z]+", ""))    # what most class counts need to look at
    counts = {f"_c_{name}": F.length(F.regexp_replace("_rare", f"[^{c}]+", "")).cast("bigint") for name, c in CLASSES.items()}
    counts["_c_wide"] = F.length(F.regexp_replace("_rare", WIDE, "")).cast("bigint")
    languages = F.create_map(*[x for k, ws in rule.words.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    everything = sorted({w for ws in rule.words.values() for w in ws})
    forms = sorted({f for w in everything for f in (w, w.capitalize(), w.upper())})
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    first = rare.select(F.col("doc_id"), F.col("lang"), F.length(text).cast("bigint").alias("_signs"),
                        words_of(text).alias("_words"), lines.alias("_lines"), *carry, *[c.alias(n) for n, c in counts.items()])
    listed = F.coalesce(languages[F.col("lang")], F.array(*map(F.lit, everything)))
    common = F.filter("_words", lambda w: F.rtrim(w, F.lit(".,")).isin(forms))
    histogram = let(F.transform(common, lambda w: F.lower(F.rtrim(w, F.lit(".,")))), lambda c: F.transform(
        listed, lambda w: (F.size(c) - F.size(F.array_remove(c, w))).cast("bigint")))
    return first.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.size("_words").cast("bigint").alias("n_words"),
        (F.col("_signs") - F.col("_c_space")).alias("word_chars"), F.col("_c_symbol").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
        F.array("_signs", *counts).alias("_kept"), histogram.alias("_found"), *carry).select(
        "*", F.concat(F.slice("_kept", 2, len(counts)), F.array(F.element_at("_kept", 1) - F.aggregate(
            F.slice("_kept", 2, len(counts)), F.lit(0).cast("bigint"), lambda a, x: a + x))).alias("classes"),
        F.concat("_found", F.array(F.col("n_words") - F.aggregate("_found", F.lit(0).cast("bigint"), lambda a, x: a + x))).alias("words")
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_kept", "_found")


def references(found: DataFrame) -> DataFrame:
    """Per language the sums of both histograms over all documents that pass the base rules: a few dozen numbers each."""
    def sums(column: str) -> DataFrame:
        one = found.where(~F.col("base_failed")).select("lang", F.posexplode(column).alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
        return one.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias(f"ref_{column}"))

    return sums("classes").join(sums("words"), "lang")


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (square root of the divergence in bits) of two histograms of counts; null if one is empty."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    share = lambda c: let(total(c), lambda t: F.transform(c, lambda x: x / F.nullif(t, F.lit(0.0))))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(share(p), share(q), lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _verdicts(found: DataFrame, known: DataFrame, rule: Divergence) -> DataFrame:
    """``found`` with kept and both distances, by the references ``known``."""
    signs = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    scored = found.join(known, "lang", "left").select(
        "*", F.when(signs >= rule.least_signs, jensen_shannon(F.col("classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(F.col("n_words") >= rule.least_words, jensen_shannon(F.col("words"), F.col("ref_words"))).alias("word_distance"))
    chance = lambda column, n: F.size(column) / (F.lit(8 * math.log(2.0)) * n)
    beyond = lambda d, limit, column, n: F.coalesce(d * d > limit * limit + chance(column, n), F.lit(False))
    far = (beyond(F.col("class_distance"), rule.class_limit, "classes", signs)
           | beyond(F.col("word_distance"), rule.word_limit, "words", F.col("n_words")))
    return scored.withColumn("kept", ~F.col("base_failed") & ~far)


def _sent(known: DataFrame) -> DataFrame:
    """References are sent to all tasks where languages are few; otherwise they meet their documents by a shuffle."""
    return F.broadcast(known) if known.count() <= 10_000 else known


def judge_quality(docs: DataFrame, rule: Divergence = Divergence()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A document that passes the base rules is dropped if its histogram of character classes or of common words lies
    farther from its language's reference than the limit, and the histogram counts enough to be judged (minimum-length
    guards).  References are the sums over all documents of the language that pass the base rules; a null or unlisted
    language has all lists' words as bins.  Null and empty texts count as empty (base_failed); repeated rows are judged each by itself; an
    empty table gives no rows; other columns are not looked at.
    """
    found = stored(features(docs, rule), "quality")
    judged = _verdicts(found, _sent(stored(references(found), "references")), rule)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "class_distance", "word_distance")


def keep_documents(docs: DataFrame, rule: Divergence = Divergence()) -> DataFrame:
    """The rows of ``docs`` that judge_quality keeps, with all their columns.

    Rows are written once with their features; the references are sums over the narrow part of that table, and the
    verdicts are found beside the rows, so rows need no identity and texts are not shuffled.  Null and empty texts go;
    repeated rows are judged each by itself; an empty table stays empty; columns of any name stay.
    """
    whole = docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    found = stored(features(whole, rule, ("_doc",)).select("lang", "classes", "words", "n_words", "base_failed", "_doc"), "quality-rows")
    judged = _verdicts(found, _sent(stored(references(found), "references")), rule)
    return judged.where("kept").select("_doc.*")

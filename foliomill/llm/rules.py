"""Distribution divergence: is a document's mix of characters and common words that of its language?

Every document gets two histograms: eight character classes, and the language's common words plus
one bin for all other words. The reference of a language is the sum of the histograms of its
documents that pass the base rules. A document fails when the Jensen-Shannon distance of either
histogram from the reference is over its limit. That of words follows from the reference:
``max_word_share`` of the distance at which a text without one common word lies, and what chance
adds to the distance of a text of so few words (squared, bins / (8 ln 2 words), times ``noise``), but
never so much that a text without common words passes. Documents under ``min_words`` words or
``min_chars`` characters have too few counts to be judged and pass.

Edge cases: null text counts as empty; a null language is a language of its own; a language without
a list of common words is judged by characters alone; one without a document that passes the base
rules has no reference, and nothing fails by distance. All built-in functions, no Python on the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_side, table, words_of

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he or are this at from but have an they which one you had".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
SYMBOLS = "[#*$%&|<>]"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "sign", "rest")
#: What most of a text is; classes are counted in what is left without it.
PLAIN = r"[a-z\x20\x09-\x0D]+"

#: Languages whose references may be broadcast, a few kB each; more are shuffled.
SMALL = 10_000


@dataclass(frozen=True)
class DivergenceRule:
    """Limits of the rule; distances lie between 0 and 1, ``max_word_share`` is a share of the distance of a text without common words."""

    max_char_distance: float = 0.28
    max_word_share: float = 0.50
    noise: float = 1.3
    min_words: int = 50
    min_chars: int = 200
    common: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a text a one-character pattern matches."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def with_window_hashes(df: DataFrame) -> DataFrame:
    """Adds ``_windows``: a hash of each five-word window of ``_words``; from pairs of words, pairs of pairs, and the fifth word, each a column so that it is made once."""
    n = F.size("_words")
    both = lambda a, b: F.xxhash64(a, b)
    after = lambda c, k: F.slice(c, k + 1, F.greatest(n - k, F.lit(0)))
    df = df.withColumn("_two", F.zip_with("_words", after("_words", 1), both))
    df = df.withColumn("_four", F.zip_with("_two", after("_two", 2), both))
    fives = F.zip_with("_four", after("_words", 4), both)
    return df.withColumn("_windows", F.slice(fives, 1, F.greatest(n - 4, F.lit(0)))).drop("_two", "_four")


def with_base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; also ``_words``, ``_text`` and ``_rest``, the text without small letters and spaces."""
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines)
    df = with_window_hashes(df).withColumn("_rest", F.regexp_replace("_text", PLAIN, ""))
    h = F.col("_windows")
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_pairs", pairs)
    p = F.col("_pairs")
    found = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n_words = F.size("_words").cast("long")
    df = df.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": count_of(F.col("_rest"), SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    )
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("_lines", "_windows", "_pairs", "_at")


def char_histogram(n_chars: Column, rest: Column, word_chars: Column, n_symbols: Column) -> Column:
    """Counts of the eight classes as an array of doubles. ``rest`` is the text without small letters a to z and spaces; other letters that are not capitals count as lower."""
    counts = [count_of(rest, p) for p in (r"\p{Lu}", "[0-9]", r"[.,;:!?'\"()-]", r"[/_=+{}~^@`\[\]\\\x00-\x08\x0E-\x1F\x7F]", r"[^\p{L}\x00-\x7F]")]
    upper, digit, stop, sign, other = counts
    space = n_chars - word_chars
    return F.transform(F.array(n_chars - upper - digit - space - stop - n_symbols - sign - other, upper, digit, space, stop, n_symbols, sign, other), lambda x: x.cast("double"))


def common_forms(common: dict[str, list[str]]) -> list[str]:
    """The common words of all languages as texts write them: three cases, and a mark before or after them or none."""
    words = sorted({w for ws in common.values() for w in ws})
    marks = [("", m) for m in ("", ".", ",", ";", ":", "!", "?", '"', ")")] + [('"', ""), ("(", "")]
    return [a + f + b for w in words for f in dict.fromkeys((w, w.capitalize(), w.upper())) for a, b in marks]


def listed_words(lang: Column, common: dict[str, list[str]]) -> Column:
    """The language's common words; null without a list."""
    out = F.lit(None).cast("array<string>")
    for code, listed in common.items():
        out = F.when(lang == code, F.lit(listed)).otherwise(out)
    return out


def with_word_counts(df: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Adds ``commons``: (w, n) of each common word of the document's language that ``_words`` holds, n a double; null for a language without a list."""
    forms = ", ".join("'" + f.replace("'", r"\'") + "'" for f in common_forms(common)) or "''"
    met = F.expr(f"filter(_words, w -> w IN ({forms}))")  # a hash lookup; what remains is short
    df = df.withColumn("_met", F.array_sort(F.transform(met, lambda w: F.btrim(F.lower(w), F.lit('.,;:!?"()'))))).withColumn("_listed", listed_words(F.col("lang"), common))
    # equal words stand together: where each begins tells how many they are
    df = df.withColumn("_kinds", F.array_distinct("_met"))
    df = df.withColumn("_at", F.transform("_kinds", lambda w: F.array_position("_met", w)))
    each = F.transform("_kinds", lambda w, i: F.struct(w.alias("w"), (F.coalesce(F.get("_at", i + 1), F.size("_met") + 1) - F.get("_at", i)).cast("double").alias("n")))
    df = df.withColumn("commons", F.when(F.col("_listed").isNotNull(), F.filter(each, lambda x: F.array_contains("_listed", x["w"]))))
    return df.drop("_met", "_listed", "_kinds", "_at")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays. Both must be plain columns with a positive sum."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    pn = F.transform(F.arrays_zip(p.alias("p"), q.alias("q")), lambda z: F.struct((z["p"] / total(p)).alias("p"), (z["q"] / total(q)).alias("q")))
    terms = F.transform(pn, lambda z: part(z["p"], (z["p"] + z["q"]) / 2) + part(z["q"], (z["p"] + z["q"]) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def sparse_js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram told by its full bins but one, (w, n), and ``total``, from the map ``shares``; one bin holds all the rest."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    term = lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2)
    each = F.transform(counts, lambda x: F.struct((x["n"] / total).alias("p"), F.coalesce(F.try_element_at(shares, x["w"]), F.lit(0.0)).alias("q")))
    add = lambda a, x: F.struct((a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q"), (a["d"] + term(x["p"], x["q"])).alias("d"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "pqd"])
    # of the reference's bins that the text lacks each adds its share; the shares of all listed words and of the rest sum to one
    rest = F.coalesce(F.try_element_at(shares, F.lit("")), F.lit(0.0))
    done = lambda a: (a["d"] + term(F.greatest(1.0 - a["p"], F.lit(0.0)), rest) + F.greatest(1.0 - rest - a["q"], F.lit(0.0))) / 2
    return F.when(counts.isNotNull() & shares.isNotNull(), F.sqrt(F.greatest(F.aggregate(each, zero, add, done), F.lit(0.0))))


def word_limit(none: Column, bins: Column, n_words: Column, rule: DivergenceRule) -> Column:
    """The largest word distance of a text of ``n_words`` words, where a text without common words lies at ``none`` and ``bins`` common words occur."""
    chance = rule.noise * bins / (8 * math.log(2) * F.greatest(n_words, F.lit(1)))
    return F.least(F.sqrt(F.pow(rule.max_word_share * none, F.lit(2)) + chance), 0.97 * none)


def references(counted: DataFrame) -> DataFrame:
    """Per language (``ref_lang``) the sums of the histograms of its documents that pass the base rules: ``ref_chars``, ``ref_words`` (word to share, "" for all others), ``ref_bins`` and ``ref_none``, the distance of a text without common words."""
    good = counted.where("not base_failed")
    chars = good.groupBy("lang").agg(F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(len(CLASSES))]).alias("ref_chars"), F.sum(F.when(F.col("commons").isNotNull(), F.col("n_words"))).cast("double").alias("_n"))
    words = good.select("lang", F.explode("commons").alias("x")).groupBy("lang", "x.w").agg(F.sum("x.n").alias("n"))
    words = words.groupBy("lang").agg(F.sum("n").alias("_known"), F.array_sort(F.collect_list(F.struct("w", "n"))).alias("_w")).withColumnRenamed("lang", "_lang")  # a language's list at most
    ref = chars.join(words, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("_known", F.coalesce("_known", F.lit(0.0)))
    each = F.concat(F.coalesce("_w", F.array().cast("array<struct<w:string,n:double>>")), F.array(F.struct(F.lit("").alias("w"), (F.col("_n") - F.col("_known")).alias("n"))))
    ref = ref.withColumn("ref_words", F.when(F.col("_n") > 0, F.map_from_entries(F.transform(each, lambda x: F.struct(x["w"], x["n"] / F.col("_n"))))))
    none = sparse_js_distance(F.array().cast("array<struct<w:string,n:double>>"), F.lit(1.0), F.col("ref_words"))
    return ref.select(F.col("lang").alias("ref_lang"), "ref_chars", "ref_words", none.alias("ref_none"), (F.size("ref_words") - 1).alias("ref_bins"))


def judge(docs: DataFrame, rule: DivergenceRule = DivergenceRule(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document the base counts, both distances (null where the length guard holds) and ``kept``."""
    work = Workspace(docs.sparkSession, "rules")
    base = with_base_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    base = with_word_counts(base, rule.common).withColumn("n_chars", F.length("_text").cast("long"))
    base = base.withColumn("chars", char_histogram(F.col("n_chars"), F.col("_rest"), F.col("word_chars"), F.col("n_symbols")))
    counted = work.write(base.drop("text", "_text", "_words", "_rest"), "counted")

    known = small_side(work.write(references(counted), "references"), SMALL)
    both = counted.join(known, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    long_enough = (F.col("n_words") >= rule.min_words) & (F.col("n_chars") >= rule.min_chars)
    both = both.withColumn("char_distance", F.when(long_enough, js_distance(F.col("chars"), F.col("ref_chars"))))
    both = both.withColumn("word_distance", F.when(long_enough, sparse_js_distance(F.col("commons"), F.col("n_words"), F.col("ref_words"))))
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= rule.max_char_distance) & F.coalesce(F.col("word_distance") <= word_limit(F.col("ref_none"), F.col("ref_bins"), F.col("n_words"), rule), F.lit(True))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distances are rounded so that the order in which counts are summed cannot show.
    found = judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})

"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates and densities of a text: hits of a lexicon, hits near a second-person word,
capitals, punctuation, obfuscated words. The lexicon holds a few seed insults and word beginnings
learned from labelled rows: those seen in toxic texts after many different words and hardly in
others. Counting distinct (previous word, beginning) pairs makes a thousand copies of one toxic
text count as one, so its harmless words do not become insults.

Labels are learned from a bounded sample (``max_rows`` labelled rows, the first by a hash of the
key), split in three: the lexicon, the trees and the calibration each have rows of their own.
Scoring reads all rows in Arrow batches: words are told apart first, each distinct word of some
6 MB of text is looked at once, and texts add up what their words have. Rates and logarithms of
these counts are built-in functions.

Edge cases: null text counts as empty and is scored like any other; a row with several labels is
toxic if one says so; null labels are skipped; with no labelled rows or only one class the score
is that class's rate (0 without any); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc_bucket, table
from .wordcodes import slices, word_codes

# Fixed values.
SEED_INSULTS = "idiot moron stupid pathetic worthless scum loser trash clown disgusting dumb fool imbecile jerk bastard idiota imbécile connard abruti estúpido imbécil dummkopf trottel arschloch".split()
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split()
BEGINNINGS = (4, 6)
LOOK_ALIKES = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ("strong", "weak", "strong_log", "near_person", "hidden_hits", "capitals", "shouted", "exclaims", "questions", "punctuation", "obfuscated", "words_log")
COUNTS = ("words", "strong", "weak", "near", "hidden", "masked", "shouted", "capitals", "letters", "exclaims", "questions", "marks")


@dataclass(frozen=True)
class ToxicityModel:
    strong: list[str]
    weak: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def lowered(words: pa.Array) -> pa.Array:
    """Lower-case forms; those of words beyond ASCII by Python's full mapping, as Spark's ``lower`` has it."""
    beyond = pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(pc.ascii_lower(words), beyond, pa.array([w.lower() for w in words.filter(beyond).to_pylist()], words.type))


def plain(words: pa.Array) -> pa.Array:
    """Lower-case letters of words' forms without marks at their ends."""
    return pc.replace_substring_regex(lowered(words), r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")


def unmasked(words: pa.Array) -> pa.Array:
    """Words with look-alike digits and signs read as letters, and marks inside dropped."""
    read = pa.array([w.translate(LOOK_ALIKES) for w in lowered(words).to_pylist()], words.type)
    return pc.replace_substring_regex(read, r"\P{L}+", "")


def known(words: pa.Array, lexicon: list[str]) -> pa.Array:
    """Whether each word or one of its beginnings is in the lexicon; a hash lookup."""
    held = pa.array(lexicon, words.type)
    out = pc.is_in(pc.binary_join_element_wise("=", words, ""), value_set=held)
    for n in BEGINNINGS:
        out = pc.or_(out, pc.is_in(pc.utf8_slice_codeunits(words, 0, n), value_set=held))
    return out


def word_facts(words: pa.Array, strong: list[str], weak: list[str]) -> dict[str, np.ndarray]:
    """What is asked of a word, for distinct words: flags, and numbers of characters of a kind."""
    forms = plain(words)
    masked = pc.and_not(pc.match_substring_regex(words, r"\p{L}[^\p{L}\x27’-]+\p{L}"), pc.match_substring_regex(words, r"[@/]|\p{L}{3,}[.,;:]\p{L}"))
    hidden = np.zeros(len(words), bool)
    hidden[masked.to_numpy(zero_copy_only=False)] = known(unmasked(words.filter(masked)), strong).to_numpy(zero_copy_only=False)
    facts = {
        "strong": known(forms, strong),
        "weak": known(forms, weak),
        "person": pc.is_in(forms, value_set=pa.array(SECOND_PERSON, words.type)),
        "masked": masked,
        "shouted": pc.match_substring_regex(words, r"^\p{Lu}{3,}\P{L}*$"),
        "capitals": pc.count_substring_regex(words, r"\p{Lu}"),
        "letters": pc.utf8_length(pc.replace_substring_regex(words, r"\P{L}+", "")),
        "exclaims": pc.count_substring(words, "!"),
        "questions": pc.count_substring(words, "?"),
        "marks": pc.count_substring_regex(words, r"[#*$%&|<>.,;:\-_~^]"),
    }
    return {"hidden": hidden} | {k: v.to_numpy(zero_copy_only=False) for k, v in facts.items()}


def text_counts(texts: pa.Array, strong: list[str], weak: list[str]) -> pa.Array:
    """``COUNTS`` of every text. Each distinct word is looked at once; a text adds up what its words have."""
    codes, words, n = word_codes(texts)
    ends = np.concatenate([[0], np.cumsum(n)])

    def before(of_words: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(of_words, dtype=np.int64)])

    facts = {k: v[codes] for k, v in word_facts(words, strong, weak).items()}
    hits, persons = np.flatnonzero(facts["strong"]), before(facts.pop("person"))
    row = np.searchsorted(ends, hits, side="right") - 1
    first = np.maximum(hits - 3, ends[row])
    facts["near"] = np.zeros(len(codes), bool)
    facts["near"][hits] = persons[np.minimum(first + 7, ends[row + 1])] > persons[first]
    sums = {"words": n} | {k: np.diff(before(v)[ends]) for k, v in facts.items()}
    return pa.StructArray.from_arrays([pa.array(sums[k], pa.int64()) for k in COUNTS], names=list(COUNTS))


def over_slices(texts: pa.Array, body: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``body`` of texts, some 6 MB of them at a time."""
    parts = [body(b.column("text")) for b in slices(iter([pa.record_batch([texts], names=["text"])]))]
    return pa.concat_arrays(parts) if parts else body(texts)


def valid_text() -> Column:
    """``text`` as Arrow can read it: null is empty, bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.coalesce("text", F.lit("")))


def plain_words(texts: pa.Array) -> pa.Array:
    """The plain forms of every text's words."""
    codes, words, n = word_codes(texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), plain(words).take(pa.array(codes)))


def with_features(docs: DataFrame, strong: list[str], weak: list[str]) -> DataFrame:
    def run(texts: pa.Array) -> pa.Array:
        return over_slices(texts, lambda t: text_counts(t, strong, weak))

    df = docs.withColumn("_text", valid_text())
    df = df.withColumn("_counts", F.arrow_udf(run, ", ".join(f"{k}: long" for k in COUNTS).join(("struct<", ">")))("_text"))
    found = lambda k: F.col(f"_counts.{k}").cast("double")
    n, chars, letters = (F.greatest(x, F.lit(1)).cast("double") for x in (F.col("_counts.words"), F.length("_text"), F.col("_counts.letters")))
    return df.withColumns(
        {
            "strong": found("strong") / n,
            "weak": found("weak") / n,
            "strong_log": F.log1p(found("strong")),
            "near_person": found("near") / n,
            "hidden_hits": found("hidden") / n,
            "capitals": found("capitals") / letters,
            "shouted": found("shouted") / n,
            "exclaims": found("exclaims") / chars,
            "questions": found("questions") / chars,
            "punctuation": found("marks") / chars,
            "obfuscated": found("masked") / n,
            "words_log": F.log1p(found("words")),
        }
    ).drop("_text", "_counts")


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic, part): at most ``max_rows`` labelled rows of training folds, the first by a hash of their key."""
    given = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    chosen = given.where(crc_bucket(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows rows of a key and a number: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("text", "toxic", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(10)).alias("part"))


def learn_lexicon(sample: DataFrame, support: int = 8, ratio: float = 8.0, size: int = 400) -> tuple[list[str], list[str]]:
    """Strong and weak entries by how many distinct words they follow in toxic and in other texts."""
    def run(texts: pa.Array) -> pa.Array:
        return over_slices(texts, plain_words)

    df = sample.select("toxic", F.arrow_udf(run, "array<string>")(valid_text()).alias("_plain"))
    p = F.col("_plain")
    pairs = F.transform(p, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(p, i - 1), F.lit("")).alias("before")))
    rows = df.select("toxic", F.explode(pairs).alias("x")).where("length(x.w) >= 4").select("toxic", "x.w", "x.before").distinct()
    keys = F.array(F.concat(F.lit("="), F.col("w")), *[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in BEGINNINGS])
    seen = rows.select("toxic", "before", F.explode(keys).alias("key")).where("key is not null").distinct()
    counts = seen.groupBy("key").agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good"))
    found = counts.where((F.col("bad") >= 4) & (F.col("bad") >= ratio / 4 * (F.col("good") + 0.5))).orderBy(F.desc(F.col("bad") / (F.col("good") + 0.5)), "key").limit(size).collect()
    strong = [r["key"] for r in found if r["bad"] >= support and r["bad"] >= ratio * (r["good"] + 0.5)]
    weak = [r["key"] for r in found if r["key"] not in set(strong)]
    return sorted({*strong, *(f"={w}" for w in SEED_INSULTS)}), weak


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 30, depth: int = 4) -> ToxicityModel:
    work = Workspace(docs.sparkSession, "toxicity")
    sample = work.write(labelled_sample(docs, labels, max_rows), "sample")
    rates = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = rates.get(1.0, 0) / max(1, sum(rates.values()))
    if len(rates) < 2:
        return ToxicityModel([f"={w}" for w in SEED_INSULTS], [], None, None, rate)
    strong, weak = learn_lexicon(sample.where("part < 4"))
    rows = work.write(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(sample.where("part >= 4"), strong, weak)).select("features", "toxic", "part"), "features").repartition(4).persist()
    try:
        kinds = {r["k"]: r["n"] for r in rows.groupBy((F.col("part") < 8).alias("k")).agg(F.countDistinct("toxic").alias("n")).collect()}
        if kinds.get(True, 0) < 2 or not kinds.get(False, 0):
            return ToxicityModel(strong, weak, None, None, rate)
        model = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(rows.where("part < 8"))
        scored = model.transform(rows.where("part >= 8")).select("toxic", vector_to_array("probability")[1].alias("p"))
        calibration = IsotonicRegression(labelCol="toxic", featuresCol="p").fit(scored)
    finally:
        rows.unpersist()
    return ToxicityModel(strong, weak, model, calibration, rate)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score``, between 0 and 1."""
    if model.trees is None:
        return docs.withColumn("score", F.lit(float(model.rate)))
    kept = docs.columns
    df = with_features(docs, model.strong, model.weak)
    df = model.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df).select(*kept, "features"))
    df = df.select(*kept, vector_to_array("probability")[1].alias("p"))
    # calibration is a step function; a small share of the raw score keeps the order within a step
    out = model.calibration.transform(df)
    return out.select(*kept, F.least(F.greatest(0.99 * F.col("prediction") + 0.01 * F.col("p"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

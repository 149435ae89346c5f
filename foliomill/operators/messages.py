"""Message catalogues: rendering, auditing, choosing a language, naming characters, gathering notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENGLISH = "en"
#: Decimal marks by language; others write a point. Fixed values.
MARKS = {"fr": ",", "de": ",", "es": ","}


def render_messages(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Messages (id, language, code, params: map of text) as sentences of the catalogue (language, key, form, template).

    ``form`` is '' or a plural form, ``one`` for a count param ``n`` of 1 and ``other`` else. A key the language lacks falls back to
    English, and to the code itself if English lacks it too. Numbers with a fraction are written to one place, half up, with the
    language's mark. A placeholder without a fact stays as it is.
    """
    n = F.col("params")["n"].try_cast("double")
    wanted = F.when(n.isNull(), "").when(n == 1, "one").otherwise("other")
    m = messages.withColumn("_form", wanted)
    own = catalog.select(F.col("language").alias("_l"), F.col("key").alias("_k"), F.col("form").alias("_f"), F.col("template").alias("_own"))
    english = catalog.where(F.col("language") == ENGLISH).select(F.col("key").alias("_k"), F.col("form").alias("_f"), F.col("template").alias("_english"))
    code = (F.col("code") == F.col("_k")) & ((F.col("_f") == F.col("_form")) | (F.col("_f") == ""))
    best = lambda c: F.max_by(c, F.length("_f"))
    m1 = m.join(own, code & (F.col("language") == F.col("_l")), "left").groupBy("id", "language", "code", F.col("_form")).agg(F.first("params").alias("params"), best("_own").alias("_own"))
    m2 = m1.join(english, code, "left").groupBy("id", "language", "code").agg(F.first("params").alias("params"), F.first("_own").alias("_own"), best("_english").alias("_english"))
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.col("language")], F.lit("."))

    def written(v: Column) -> Column:
        tenth = F.round(v.try_cast("decimal(30,10)"), 1).cast("decimal(30,1)").cast("string")
        return F.when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), F.replace(tenth, F.lit("."), mark)).otherwise(v)

    text = F.coalesce("_own", "_english", "code")
    filled = F.aggregate(F.map_entries("params"), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), written(e["value"])))
    return m2.select("id", "language", "code", F.coalesce(filled, text).alias("text"))


def placeholders(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))))


def audit_catalog(catalog: DataFrame, messages: DataFrame) -> DataFrame:
    """(language, key, problem): missing in a language; other placeholders than English has; facts of some message that do not cover the placeholders."""
    english = catalog.where(F.col("language") == ENGLISH)
    wanted = english.select("key", "form").crossJoin(catalog.select("language").distinct())  # languages: a handful
    missing = wanted.join(catalog, ["language", "key", "form"], "left_anti").select("language", "key", F.lit("missing").alias("problem"))
    e = english.select("key", "form", placeholders(F.col("template")).alias("_e"))
    other = catalog.join(e, ["key", "form"]).where(placeholders(F.col("template")) != F.col("_e")).select("language", "key", F.lit("other_placeholders").alias("problem"))
    facts = messages.select(F.col("code").alias("key"), F.map_keys("params").alias("_facts")).distinct()
    bare = e.join(facts, "key").where(F.size(F.array_except("_e", "_facts")) > 0).select(F.lit(ENGLISH).alias("language"), "key", F.lit("facts_missing").alias("problem"))
    return missing.unionByName(other).unionByName(bare).distinct()


def best_language(requests: DataFrame, catalogs: list[str]) -> DataFrame:
    """Requests (request, accept) with ``language``: the most wanted catalogue by weight, then order; a tag falls back to its shorter forms unless refused (weight 0); ``*`` and nothing usable mean English."""
    items = requests.select("request", F.posexplode_outer(F.split(F.coalesce("accept", F.lit("")), ",")).alias("pos", "item"))
    tag = F.lower(F.trim(F.split_part("item", F.lit(";"), F.lit(1))))
    given = F.regexp_extract("item", r";\s*[qQ]\s*=\s*([^;]*)", 1)
    number = F.trim(given).try_cast("double")
    q = F.when(~F.col("item").rlike(r";\s*[qQ]\s*="), 1.0).when(number.between(0.0, 1.0), number).otherwise(0.0)
    asked = items.select("request", "pos", tag.alias("tag"), q.alias("q")).where("tag <> ''")
    refused = asked.where("q = 0").groupBy("request").agg(F.collect_set("tag").alias("refused"))
    parts = F.split("tag", "-")
    forms = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    open_ = asked.where("q > 0").join(refused, "request", "left").withColumn("forms", forms)
    fits = lambda f: f.isin(catalogs) & ~F.coalesce(F.array_contains("refused", f), F.lit(False))
    chosen = F.when(F.col("tag") == "*", ENGLISH).otherwise(F.get(F.filter("forms", fits), F.lit(0)))
    best = open_.withColumn("language", chosen).where("language is not null").groupBy("request").agg(F.min_by("language", F.struct((-F.col("q")).alias("q"), "pos")).alias("language"))
    return requests.select("request").join(best, "request", "left").select("request", F.coalesce("language", F.lit(ENGLISH)).alias("language"))


INVISIBLE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Zs}&&[^ \n]]"


def visible_characters(texts: DataFrame, names: dict[str, str], key: list[str]) -> DataFrame:
    """Per key and character that draws nothing alone: its name, else its code point, and how often it occurs. Plain spaces and line ends are not told."""
    each = texts.select(*key, F.explode(F.regexp_extract_all("text", F.lit(INVISIBLE), F.lit(0))).alias("c"))
    bits = F.hex(F.encode("c", "UTF-32"))
    code = F.concat(F.lit("U+"), F.lpad(F.regexp_replace(bits, "^0+", ""), 4, "0"))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("c")]
    return each.groupBy(*key, F.coalesce(known, code).alias("name")).agg(F.count("*").alias("n"))


def consolidate_notices(notices: DataFrame, deleted: DataFrame, redacted: DataFrame) -> DataFrame:
    """Notices (doc_id, page, position, tone, type, text) of kept pages, each sentence once, warnings first, then as first told; ``signed_file`` goes once anything in the document is redacted."""
    kept = notices.join(deleted.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    gone = redacted.select("doc_id", F.lit(True).alias("_r")).distinct()
    kept = kept.join(gone, "doc_id", "left").where(~((F.col("type") == "signed_file") & F.col("_r").isNotNull())).drop("_r")
    rank = F.when(F.col("tone") == "warning", 0).otherwise(1)
    first = kept.groupBy("doc_id", "text").agg(F.min(F.struct(rank.alias("tone"), "position")).alias("at"))
    return first.select("doc_id", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "text")).alias("place"))


def new_notices(now: DataFrame, was: DataFrame) -> DataFrame:
    """Sentences of a document not told before."""
    return now.join(was, ["doc_id", "text"], "left_anti")

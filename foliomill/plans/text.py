"""Queries that find text and typed values in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amounts as amounts_op
from ..operators import dates as dates_op
from ..operators import text as op
from ..sources import derive, typeset
from ..workspace import Workspace
from . import model_sql as m
from .registry import query
from .spans import spans_of

ASKED = [op.Query("the"), op.Query("The", match_case=True), op.Query("en", whole_words=True)]
WORDS = "[\\p{L}\\p{N}\\p{M}_]"
FOUND = f"""{m.SPANS}, q(query, find) AS (VALUES (0, 'the'), (1, 'The'), (2, 'en')),
f0 AS (SELECT s.*, q.query, q.find, CASE WHEN q.query = 1 THEN s.text ELSE lower(s.text) END AS seen FROM spans s, q),
f1 AS (SELECT *, CASE WHEN query = 2 THEN len(list_filter(regexp_extract_all(seen, '{WORDS}+'), lambda w: w = find)) ELSE (length(seen) - length(replace(seen, find, ''))) // length(find) END AS n,
  CASE WHEN query = 2 THEN strpos(' ' || regexp_replace(seen, '[^{WORDS[1:]}', ' ', 'g') || ' ', ' ' || find || ' ') - 1 ELSE strpos(seen, find) - 1 END AS first FROM f0),
found AS (SELECT doc_id, page, ordinal, text, query, find, n, first FROM f1 WHERE n > 0)"""


def found_of(spark: SparkSession, sf_dir: str, queries: list[op.Query]) -> DataFrame:
    return op.find(typeset.spans(derive.table(spark, sf_dir, "documents"), "doc_id", "page", "ordinal", "text"), queries)


@query("find_matches", f"WITH {FOUND} SELECT query::BIGINT AS query, doc_id, ordinal::BIGINT AS ordinal, n::BIGINT AS n, first::BIGINT AS first FROM found")
def find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found_of(spark, sf_dir, ASKED)
    return f.select(F.col("query").cast("long").alias("query"), "doc_id", "ordinal", F.size("matches").cast("long").alias("n"), F.col("matches")[0]["start"].cast("long").alias("first"))


@query("replaced_texts", f"WITH {FOUND} SELECT query::BIGINT AS query, doc_id, ordinal::BIGINT AS ordinal, replace(text, 'The', 'Any') AS changed FROM found WHERE query = 1")
def replaced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = op.replace_all(found_of(spark, sf_dir, ASKED), ["any", "Any", "on"]).where("query = 1")
    return f.select(F.col("query").cast("long").alias("query"), "doc_id", "ordinal", "changed")


@query(
    "find_counts",
    f"""WITH {FOUND}, {m.EDITS} SELECT query::BIGINT AS query, count(*)::BIGINT AS places, sum(n)::BIGINT AS matches, count(*) FILTER (n = 1 AND length(find) = length(text))::BIGINT AS emptied FROM found
WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.doc_id = found.doc_id AND e.span_ordinal = found.ordinal AND e.kind = 'redact') GROUP BY query""",
)
def find_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derive.table(spark, sf_dir, "documents")
    skip = derive.edits(derive.table(spark, sf_dir, "events"), docs.count()).where("kind = 'redact'").select("doc_id", F.col("span_ordinal").alias("ordinal"))
    return op.find_counts(found_of(spark, sf_dir, ASKED), skip, ["doc_id", "ordinal"]).withColumn("query", F.col("query").cast("long"))


@query("match_index", f"WITH {FOUND} SELECT query::BIGINT AS query, doc_id, page::BIGINT AS page, count(*)::BIGINT AS spans, sum(n)::BIGINT AS positions FROM found GROUP BY ALL")
def match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = op.match_index(found_of(spark, sf_dir, ASKED))
    total = F.aggregate(F.transform(F.map_values("index"), lambda s: F.size(s)), F.lit(0), lambda a, x: a + x)
    return i.select(F.col("query").cast("long").alias("query"), "doc_id", F.col("page").cast("long").alias("page"), F.size("index").cast("long").alias("spans"), total.cast("long").alias("positions"))


@query(
    "match_places",
    f"""WITH {FOUND} SELECT query::BIGINT AS query, doc_id, ordinal::BIGINT AS ordinal, row_number() OVER w AS number, coalesce(lead(ordinal) OVER w, first_value(ordinal) OVER w)::BIGINT AS next,
coalesce(lag(ordinal) OVER w, last_value(ordinal) OVER (PARTITION BY query, doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))::BIGINT AS previous FROM found WINDOW w AS (PARTITION BY query, doc_id ORDER BY ordinal)""",
)
def match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = op.places(found_of(spark, sf_dir, ASKED))
    return p.withColumns({c: F.col(c).cast("long") for c in ("query", "number", "next", "previous")})


def invoices_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.invoices(derive.table(spark, sf_dir, "events"))


@query("numeric_dates", f"WITH {m.INVOICES} SELECT doc_id, written, date FROM inv_dates")
def numeric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates_op.numeric_dates(invoices_of(spark, sf_dir), 2024).select("doc_id", "written", "date")


CURRENCIES = {"USD": 2, "EUR": 2, "GBP": 2, "JPY": 0, "INR": 2, "KWD": 3}


@query("amounts", f"WITH {m.INVOICES} SELECT doc_id, paid AS written, currency, amount FROM inv")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts_op.amounts(invoices_of(spark, sf_dir), CURRENCIES).select("doc_id", "written", "currency", F.col("amount").cast("double").alias("amount"))


@query("amounts_in_documents")
def amounts_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts_op.amounts(derive.table(spark, sf_dir, "documents"), CURRENCIES).select("doc_id", "written", "currency", "amount")


@query(
    "email_contacts",
    r"""WITH e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))) AS address FROM documents)
SELECT address, count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS occurrences FROM e GROUP BY address""",
)
def email_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.emails(derive.table(spark, sf_dir, "documents"))


def values_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each digit run of a span is a value of kind number, each word a value of kind word."""
    s = spans_of(spark, sf_dir).select("doc_id", "ordinal", "text")
    return s.select("doc_id", F.col("ordinal").cast("int").alias("start"), (F.col("ordinal") + F.length("text") % 4 + 1).cast("int").alias("stop"), F.when(F.col("text").rlike("[0-9]"), "number").otherwise("word").alias("kind"))


# A value begins at every ordinal of a document and ends within five: what stays is a chain from the first one.
@query(
    "resolved_values",
    f"""WITH RECURSIVE {m.SPANS}, v AS MATERIALIZED (SELECT doc_id, ordinal AS start, ordinal + length(text) % 4 + 1 AS stop, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' ELSE 'word' END AS kind FROM spans),
kept AS (SELECT * FROM v WHERE start = 0 UNION ALL SELECT v.* FROM kept JOIN v ON v.doc_id = kept.doc_id AND v.start = kept.stop)
SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS stop, kind FROM kept""",
)
def resolved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.resolve_values(values_of(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("start", "stop")})


@query(
    "value_profile",
    f"""WITH {m.INVOICES}, v AS (SELECT source, 'date' AS kind, 0.0::DOUBLE AS amount FROM inv_dates UNION ALL SELECT source, currency, amount FROM inv UNION ALL SELECT source, 'email', 0.0 FROM inv WHERE style = 3)
SELECT source, kind, count(*)::BIGINT AS values, round(sum(amount::DECIMAL(18,3))::DOUBLE, 3) AS total, min(amount) AS least, max(amount) AS most FROM v GROUP BY GROUPING SETS ((source, kind), (kind), ())""",
)
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = invoices_of(spark, sf_dir)
    zero = F.lit(0).cast("decimal(38,9)").alias("amount")
    dates = dates_op.numeric_dates(docs, 2024).select("doc_id", F.lit("date").alias("kind"), zero)
    money = amounts_op.amounts(docs, CURRENCIES).select("doc_id", F.col("currency").alias("kind"), "amount")
    mail = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(op.EMAIL), F.lit(0)))).select("doc_id", F.lit("email").alias("kind"), zero)
    p = op.value_profile(dates.unionByName(money).unionByName(mail).join(docs.select("doc_id", "source"), "doc_id"))
    return p.withColumns({c: F.round(F.col(c).cast("double"), 9 if c != "total" else 3) for c in ("total", "least", "most")})


# Names of months and weekdays as the four languages write them, long and short, for the SQL.
NAMED = {
    ("en", "month", "long"): "January February March April May June July August September October November December",
    ("en", "month", "short"): "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    ("en", "weekday", "long"): "Monday Tuesday Wednesday Thursday Friday Saturday Sunday",
    ("en", "weekday", "short"): "Mon Tue Wed Thu Fri Sat Sun",
    ("de", "month", "long"): "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    ("de", "month", "short"): "Jan. Feb. März Apr. Mai Juni Juli Aug. Sept. Okt. Nov. Dez.",
    ("de", "weekday", "long"): "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag",
    ("de", "weekday", "short"): "Mo. Di. Mi. Do. Fr. Sa. So.",
    ("fr", "month", "long"): "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    ("fr", "month", "short"): "janv. févr. mars avr. mai juin juil. août sept. oct. nov. déc.",
    ("fr", "weekday", "long"): "lundi mardi mercredi jeudi vendredi samedi dimanche",
    ("fr", "weekday", "short"): "lun. mar. mer. jeu. ven. sam. dim.",
    ("es", "month", "long"): "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    ("es", "month", "short"): "ene feb mar abr may jun jul ago sept oct nov dic",
    ("es", "weekday", "long"): "lunes martes miércoles jueves viernes sábado domingo",
    ("es", "weekday", "short"): "lun mar mié jue vie sáb dom",
}
NAMES_SQL = "nm(language, kind, width, idx, name) AS (VALUES " + ", ".join(f"('{lang}', '{kind}', '{width}', {i}, '{n}')" for (lang, kind, width), ns in NAMED.items() for i, n in enumerate(ns.split(), kind == "month")) + ")"

# What each note holds, which languages name its words, and what they settle on for a reader of English.
NOTES = f"""{NAMES_SQL}, ev0 AS (SELECT event_id AS doc_id, ts::DATE AS d, ['en', 'de', 'fr', 'es'][user_id % 4 + 1] AS l, event_id % 6 AS style FROM events),
forms AS (SELECT language, kind, width, string_agg(lower(rtrim(name, '.')), ' ' ORDER BY idx) AS f FROM nm GROUP BY ALL),
note AS (SELECT v.*, m.name AS month, w.name AS wd, s.name AS ws FROM ev0 v JOIN nm m ON m.language = l AND m.kind = 'month' AND m.width = 'long' AND m.idx = month(d)
  JOIN nm w ON w.language = l AND w.kind = 'weekday' AND w.width = 'long' AND w.idx = isodow(d) - 1 JOIN nm s ON s.language = l AND s.kind = 'weekday' AND s.width = 'short' AND s.idx = isodow(d) - 1),
cand AS (SELECT doc_id, n.language, arg_min(n.width, ((n.name <> note.month)::INT, n.width)) AS width, 'month' AS kind FROM note JOIN nm n ON n.kind = 'month' AND lower(rtrim(n.name, '.')) = lower(note.month) WHERE style = 0 GROUP BY ALL
  UNION ALL SELECT doc_id, n.language, min(n.width), 'weekday' FROM note JOIN nm n ON n.kind = 'weekday' AND n.idx = isodow(d) - 1 AND lower(rtrim(n.name, '.')) = lower(rtrim(note.ws, '.')) WHERE style = 5 GROUP BY ALL),
ways AS (SELECT doc_id, count(DISTINCT f) AS n, min(c.language) AS one, bool_or(c.language = 'en') AS en FROM cand c JOIN forms USING (language, kind, width) GROUP BY doc_id),
settled AS (SELECT note.*, CASE WHEN style IN (1, 4) THEN l WHEN style IN (0, 5) AND n = 1 THEN one WHEN style IN (0, 5) AND en THEN 'en' END AS s FROM note LEFT JOIN ways USING (doc_id))"""


def names_of(spark: SparkSession) -> DataFrame:
    return dates_op.date_names(spark, ["en", "de", "fr", "es"])


@query("named_dates", f"WITH {m.INVOICES} SELECT doc_id, day AS written, ts::DATE AS date, CASE WHEN month(ts) IN (4, 8, 9, 11) THEN 'de,en' WHEN month(ts) = 5 THEN 'en,es' ELSE 'en' END AS languages FROM inv WHERE style = 3")
def named_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dates_op.named_dates(invoices_of(spark, sf_dir), names_of(spark))
    return found.select("doc_id", "written", "date", F.array_join("languages", ",").alias("languages"))


def notes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.dated_notes(derive.table(spark, sf_dir, "events")).select("doc_id", "text")


@query(
    "settled_languages",
    f"WITH {NOTES} SELECT doc_id, day(d) || ' ' || month || ' ' || year(d) AS written, s AS language FROM settled WHERE style IN (0, 1, 4) UNION ALL SELECT doc_id, '3 ' || name || ' 2024', l FROM settled JOIN nm ON language = l AND kind = 'month' AND width = 'long' AND idx = 1 WHERE style = 4",
)
def settled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in four languages: ranges and foreign weekdays are no dates, shared months need a reader of English."""
    names = names_of(spark)
    return dates_op.settle(dates_op.named_dates(notes_of(spark, sf_dir), names), names, ["en"]).select("doc_id", "written", "language")


@query(
    "rewritten_notes",
    f"""WITH {NOTES}, later AS (SELECT *, d + 45 AS nd, DATE '2024-01-03' + 45 AS nj FROM settled),
told AS (SELECT t.*, m.name AS nm_, w.name AS nw, ws.name AS nws, j.name AS jan, k.name AS nk, x.name AS tomorrow FROM later t
  LEFT JOIN nm m ON m.language = s AND m.kind = 'month' AND m.width = 'long' AND m.idx = month(nd) LEFT JOIN nm w ON w.language = s AND w.kind = 'weekday' AND w.width = 'long' AND w.idx = isodow(nd) - 1
  LEFT JOIN nm ws ON ws.language = s AND ws.kind = 'weekday' AND ws.width = 'short' AND ws.idx = isodow(nd) - 1 JOIN nm j ON j.language = l AND j.kind = 'month' AND j.width = 'long' AND j.idx = 1
  JOIN nm k ON k.language = l AND k.kind = 'month' AND k.width = 'long' AND k.idx = month(nj) JOIN nm x ON x.language = l AND x.kind = 'weekday' AND x.width = 'long' AND x.idx = isodow(d + 1) - 1),
c AS (SELECT *, day(d) || ' ' || month || ' ' || year(d) AS was, day(nd) || ' ' || CASE WHEN month = upper(month[1]) || month[2:] THEN upper(nm_[1]) || nm_[2:] ELSE nm_ END || ' ' || year(nd) AS now FROM told)
SELECT doc_id, CASE style WHEN 0 THEN '(' || coalesce(now, was) || ')' WHEN 1 THEN nw || ', ' || now WHEN 2 THEN tomorrow || ', ' || was WHEN 3 THEN '1-' || was
  WHEN 4 THEN now || '; ' || day(nj) || ' ' || nk || ' ' || year(nj) ELSE CASE WHEN s IS NULL THEN ws || ' ' || strftime(d, '%Y-%m-%d') ELSE nws || ' ' || strftime(nd, '%Y-%m-%d') END END AS text FROM c""",
)
def rewritten_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of the notes 45 days later, weekday and month in the language it has settled on; those that have not settled stay."""
    docs, names, work = notes_of(spark, sf_dir), names_of(spark), Workspace(spark, "notes")
    named = work.write(dates_op.named_dates(docs, names), "named")
    numeric = dates_op.settle(dates_op.numeric_with_weekdays(dates_op.numeric_dates(docs, 2024), names), names, ["en"], named)
    later = lambda d: d.select("doc_id", F.col("date").alias("old"), F.date_add("date", 45).alias("new"))
    swaps = dates_op.named_date_swaps(dates_op.settle(named, names, ["en"]), names, later(named)), dates_op.date_swaps(docs, numeric, names, later(numeric))
    return op.rewrite_values(docs, *swaps)


@query(
    "rewritten_values",
    f"""WITH {m.INVOICES}, n AS (SELECT *, ts::DATE + 30 AS nd, (floor(value)::BIGINT + 1000)::VARCHAR || '.' || lpad((k % 100)::VARCHAR, 2, '0') AS more FROM inv)
SELECT doc_id, CASE style WHEN 0 THEN 'Paid on ' || strftime(nd, '%d/%m/%Y') || ', due 24/01/2025: $' || more || ' in all' WHEN 1 THEN 'Bezahlt ' || strftime(nd, '%Y-%m-%d') || ' mit ' || replace(more, '.', ',') || ' € bar'
 WHEN 2 THEN 'Returned ' || strftime(nd, '%m/%d/%Y') || ' (01/24/2025), (£' || more || ')' ELSE 'On ' || strftime(nd, '%-d %B %Y') || ' between $5-$' || money || ' or KWD 1001.' || mills || ', mail u' || user_id || '@mail.example' END AS text FROM n""",
)
def rewritten_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, names, work = invoices_of(spark, sf_dir), names_of(spark), Workspace(spark, "invoices")
    # read more than once each
    numeric, named, money = work.write(dates_op.numeric_dates(docs, 2024), "numeric"), work.write(dates_op.named_dates(docs, names), "named"), work.write(amounts_op.amounts(docs, CURRENCIES), "money")
    later = lambda d: d.select("doc_id", F.col("date").alias("old"), F.date_add("date", 30).alias("new"))
    # away from nought; a nought in brackets is marked as negative and stays so
    more = money.select("doc_id", "currency", "negative", F.col("amount").alias("old"), F.when(F.col("negative"), F.col("amount") - 1000).otherwise(F.col("amount") + 1000).alias("new"))
    settled = dates_op.settle(dates_op.numeric_with_weekdays(numeric, names), names, ["en"], named)
    swaps = dates_op.date_swaps(docs, settled, names, later(numeric)), dates_op.named_date_swaps(dates_op.settle(named, names, ["en"]), names, later(named)), amounts_op.amount_swaps(money, more)
    return op.rewrite_values(docs.select("doc_id", "text"), *swaps)


@query(
    "document_contacts",
    r"""WITH e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))) AS address FROM documents)
SELECT doc_id, address, count(*)::BIGINT AS occurrences FROM e GROUP BY ALL""",
)
def document_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.addresses(derive.table(spark, sf_dir, "documents"))

"""Model tables out of the given parquet tables: text pieces, line art, edits and ledgers.

Plain column rules, the same in any SQL engine; each docstring states its rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import sums_before

LINES_A_PAGE = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line): the text's lines, 45 to a page. Null text has none."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return each.select("doc_id", F.floor(F.col("n") / LINES_A_PAGE).cast("int").alias("page"), (F.col("n") % LINES_A_PAGE).alias("line_no"), "line")


def page_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, pages): how many pages the lines of a text fill. Null text has none, and no row."""
    lines_ = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return docs.where("text is not null").select("doc_id", F.ceil(lines_ / LINES_A_PAGE).cast("int").alias("pages"))


def pieces(docs: DataFrame) -> DataFrame:
    """Pieces are a line's space-separated tokens with one space after; 6 pt a letter from 72 pt, lines 14 pt apart from 96.

    Font F1 where the token's length is a multiple of 4, size 12 where of 7 (else 20), raised 3 pt where of 11.
    """
    tokens = lines(docs).withColumn("tokens", F.split("line", " ", -1))
    t = F.col("tokens")
    before = sums_before(F.transform(t, lambda w: F.length(w) + 1))
    each = tokens.withColumn("before", before).select("doc_id", "page", "line_no", F.posexplode(F.arrays_zip(t.alias("w"), F.col("before").alias("b"))).alias("piece_no", "x"))
    n = F.length("x.w")
    size = F.when(n % 7 == 0, 12.0).otherwise(20.0)
    base = (96.0 + 14.0 * F.col("line_no") - F.when(n % 11 == 0, 3.0).otherwise(0.0))
    x0 = 72.0 + 6.0 * F.col("x.b")
    flag = F.when(n % 4 == 0, 1).otherwise(0)
    return each.select(
        "doc_id",
        "page",
        "line_no",
        "piece_no",
        F.concat("x.w", F.lit(" ")).alias("text"),
        F.concat(F.lit("F"), flag.cast("string")).alias("font"),
        (5 + flag).alias("font_object"),
        size.alias("size"),
        F.struct(*[F.lit(0.0).alias(c) for c in "rgb"]).alias("color"),
        F.lit(1.0).alias("opacity"),
        F.struct(x0.alias("x0"), F.bround(base - 0.8 * size, 2).alias("y0"), (x0 + 6.0 * n).alias("x1"), F.bround(base + 0.2 * size, 2).alias("y1")).alias("bbox"),
        F.struct(x0.alias("x"), base.alias("y")).alias("origin"),
        F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y")).alias("dir"),
    )


def art(docs: DataFrame) -> DataFrame:
    """(doc_id, page, bbox): a box at every tenth line, and a rule down the page at 560 pt."""
    of = lines(docs).select("doc_id", "page", "line_no")
    boxes = of.where("line_no % 10 = 0").select(
        "doc_id", "page", F.struct(F.lit(300.0).alias("x0"), (80.0 + 14.0 * F.col("line_no")).alias("y0"), F.lit(310.0).alias("x1"), (100.0 + 14.0 * F.col("line_no")).alias("y1")).alias("bbox")
    )
    rules = of.select("doc_id", "page").distinct().select("doc_id", "page", F.struct(F.lit(560.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(561.0).alias("x1"), F.lit(842.0).alias("y1")).alias("bbox"))
    return boxes.unionByName(rules)


def key_of(events: DataFrame) -> DataFrame:
    """events with ``k`` out of props and ``us``, microseconds since 1970."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def edits(events: DataFrame, n_docs: int) -> DataFrame:
    """An edit an event, onto document event_id % n_docs: view and click replace, purchase redacts five letters, signup inserts, error turns or deletes a page."""
    e = key_of(events).withColumn("doc_id", F.col("event_id") % n_docs)
    kind = F.when(F.col("event_type").isin("view", "click"), "replace").when(F.col("event_type") == "purchase", "redact").when(F.col("event_type") == "signup", "insert").when(F.col("k") % 2 == 0, "rotate").otherwise("delete_page")
    redact = F.col("kind") == "redact"
    return e.withColumn("kind", kind).select(
        "doc_id",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("event_id")).alias("position"),
        "kind",
        F.when(F.col("kind").isin("replace", "redact"), F.col("user_id") % 20).alias("span_ordinal"),
        F.when(F.col("kind") == "delete_page", F.col("k") % 3).when(F.col("kind").isin("rotate", "insert"), 0).cast("int").alias("page"),
        F.when(F.col("kind") == "replace", F.concat(F.lit("text "), (F.col("k") % 5).cast("string"))).when(F.col("kind") == "insert", F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("new "), F.col("k").cast("string")))).alias("text"),
        F.when(redact, F.col("k") % 10).alias("start"),
        F.when(redact, F.col("k") % 10 + 5).alias("stop"),
        F.when(F.col("kind") == "rotate", 90).alias("degrees"),
    )


def opens(events: DataFrame) -> DataFrame:
    """A view opens a document: its digest is that of k."""
    return key_of(events).where("event_type = 'view'").select(F.col("user_id").alias("account"), F.sha2(F.col("k").cast("string"), 256).alias("digest"), "event_id", "us")


def billing_events(events: DataFrame) -> DataFrame:
    """A purchase bills; ids repeat, and reads come late."""
    e = key_of(events).where("event_type = 'purchase'")
    read = F.floor(F.col("us") / 1000) + (F.col("event_id") % 13 - 6) * 3_600_000
    return e.select(
        F.floor(F.col("event_id") / 2).alias("id"), F.col("event_id").alias("arrival"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("account"), F.col("us").alias("created"), (F.floor(F.col("us") / 1_000_000) + 2_592_000).alias("paid_until"), read.alias("paid_read_at"), F.when(F.col("k") % 4 == 0, "other").otherwise("invoice.paid").alias("type")
    )


def requests(events: DataFrame) -> DataFrame:
    """A click is a request."""
    return key_of(events).where("event_type = 'click'").select(
        F.col("event_id").alias("request"), F.col("user_id").alias("key"), F.concat(F.lit("/r"), (F.col("k") % 5).cast("string")).alias("route"), F.when(F.col("k") % 17 == 0, 500).when(F.col("k") % 19 == 0, 499).otherwise(200).alias("status"), F.floor(F.col("value")).cast("long").alias("ms"), "us", "k"
    )


def invoices(events: DataFrame) -> DataFrame:
    """(doc_id, source, text): a text an event, with its day and an amount of money, in one of four styles (event_id % 4).

    0: day first, a dollar amount; 1: year first, euros with a decimal comma; 2: month first, pounds in brackets; 3: the month's English
    name, a range of dollars and three decimals of dinars. Styles 0 and 2 hold a second date that only one order can read.
    """
    e = key_of(events)
    day = lambda f: F.date_format("ts", f)
    money = F.concat(F.floor("value").cast("string"), F.lit("."), F.lpad((F.col("k") % 100).cast("string"), 2, "0"))
    styles = [
        F.concat(F.lit("Paid on "), day("dd/MM/yyyy"), F.lit(", due 25/12/2024: $"), money, F.lit(" in all")),
        F.concat(F.lit("Bezahlt "), day("yyyy-MM-dd"), F.lit(" mit "), F.translate(money, ".", ","), F.lit(" € bar")),
        F.concat(F.lit("Returned "), day("MM/dd/yyyy"), F.lit(" (12/25/2024), (£"), money, F.lit(")")),
        F.concat(F.lit("On "), day("d MMMM yyyy"), F.lit(" between $5-$"), money, F.lit(" or KWD 1."), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit(", mail u"), F.col("user_id").cast("string"), F.lit("@mail.example")),
    ]
    text = styles[3]
    for i in (2, 1, 0):
        text = F.when(F.col("event_id") % 4 == i, styles[i]).otherwise(text)
    return e.select(F.col("event_id").alias("doc_id"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), text.alias("text"))


def dated_notes(events: DataFrame) -> DataFrame:
    """(doc_id, text, language, style): a note an event, dated with words in one of four languages (user_id % 4), in one of six styles (event_id % 6).

    0: day, month, year; 1: its weekday before it; 2: the next day's weekday before it; 3: the last day of a range; 4: a second date, in January; 5: a short weekday before the date in numbers.
    """
    e = key_of(events).withColumn("d", F.to_date("ts"))
    language = F.get(F.array(*[F.lit(x) for x in NOTE_LANGUAGES]), (F.col("user_id") % 4).cast("int"))

    def named(day: Column, form: str) -> Column:
        out = None
        for x in NOTE_LANGUAGES:
            name = F.to_csv(F.struct(day.alias("d")), {"dateFormat": form, "locale": x})
            out = F.when(language == x, name) if out is None else out.when(language == x, name)
        return out

    d = F.col("d")
    date = F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), named(d, "MMMM"), F.lit(" "), F.year(d).cast("string"))
    texts = [
        F.concat(F.lit("("), date, F.lit(")")),
        F.concat(named(d, "EEEE"), F.lit(", "), date),
        F.concat(named(F.date_add(d, 1), "EEEE"), F.lit(", "), date),
        F.concat(F.lit("1-"), date),
        F.concat(date, F.lit("; 3 "), named(F.to_date(F.lit("2024-01-03")), "MMMM"), F.lit(" 2024")),
        F.concat(named(d, "EEE"), F.lit(" "), F.date_format(d, "yyyy-MM-dd")),
    ]
    style = (F.col("event_id") % 6).cast("int")
    return e.select(F.col("event_id").alias("doc_id"), F.get(F.array(*texts), style).alias("text"), language.alias("language"), style.alias("style"))


NOTE_LANGUAGES = ("en", "de", "fr", "es")


def token_uses(events: DataFrame) -> DataFrame:
    """A signup spends a token."""
    return key_of(events).where("event_type = 'signup'").select(F.col("user_id").alias("account"), (F.floor(F.col("us") / 1_000_000) + 900 - (F.col("event_id") % 4) * 600).alias("until"), F.floor(F.col("us") / 1_000_000).alias("used_at"), F.col("event_id").alias("arrival"))


def mail_events(events: DataFrame) -> DataFrame:
    """An error is a mail event, a hard bounce above 100; a signup an invitation."""
    e = key_of(events).where("event_type in ('error', 'signup')")
    event = F.when(F.col("event_type") == "signup", "invite").when(F.col("value") > 20, "hard_bounce").otherwise("other")
    return e.select(event.alias("event"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.example")).alias("email"), "us", "event_id")


def hidden_copies(pages: DataFrame) -> DataFrame:
    """(doc_id, place, text): what a page holds out of sight: its title, meta tags, comments."""
    patterns = {"title": r"<title>([^<]*)</title>", "metadata": r"<meta ([^>]*)>", "comments": r"<!--([^>]*)-->"}

    def copies(place: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(place).alias("place"), t.alias("text")))

    parts = [copies(n, p) for n, p in patterns.items()]
    return pages.select(F.col("page_id").alias("doc_id"), F.explode(F.concat(*parts)).alias("c")).select("doc_id", "c.place", "c.text")

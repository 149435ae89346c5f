"""Golden cases of single operators, stated as small tables."""

import random
import time
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliomill.operators import amounts, dates, edits, layout, logs, messages, redaction, text, typography, usage
from foliomill.operators import fidelity
from foliomill.operators.spans import build_spans
from foliomill.sources import ingest
from foliomill.workspace import Workspace


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pieces(spark, *made):
    """(text, x0, x1, changes) on one line."""
    from foliomill.schemas import PIECE

    out = []
    for i, (t, x0, x1, kw) in enumerate(made):
        base, size = kw.get("base", 100.0), kw.get("size", 12.0)
        out.append((1, 0, 0, i, t, kw.get("font", "Times"), kw.get("obj", 5), size, (0.0, 0.0, kw.get("blue", 0.0)), kw.get("opacity", 1.0), (x0, base - 0.8 * size, x1, base + 0.2 * size), (x0, base), kw.get("dir", (1.0, 0.0))))
    return spark.createDataFrame(out, PIECE)


def test_pieces_continue_or_break(spark):
    cases = [({}, 1.0, 1), ({}, 10.0, 2), ({"font": "Other"}, 1.0, 2), ({"obj": 6}, 1.0, 2), ({"base": 97.0}, 1.0, 2), ({"blue": 1.0}, 1.0, 2), ({"opacity": 0.5}, 1.0, 2), ({}, -1.0, 1), ({}, -1.1, 2), ({"size": 12.05}, 1.0, 1)]
    for change, gap, n in cases:
        got = build_spans(pieces(spark, ("a", 0.0, 10.0, {}), ("b", 10.0 + gap, 30.0, change))).count()
        assert got == n, (change, gap)


def test_blank_groups_take_no_ordinal_and_turned_text_is_told(spark):
    got = build_spans(pieces(spark, ("a", 0.0, 10.0, {}), ("  ", 50.0, 60.0, {}), ("b", 90.0, 99.0, {"dir": (0.0, 1.0)}))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text, r.turned) for r in got] == [(0, "a", False), (1, "b", True)]


def test_strips_and_notes(spark):
    pages = spark.createDataFrame([(1, 0, 100.0)], "doc_id long, page int, height double")
    strips = layout.coalesce_rows(spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 0, 14.0, 20.0), (1, 0, 40.0, 99.0)], "doc_id long, page int, y0 double, y1 double"), pages)
    assert [(r.y0, r.y1) for r in strips.orderBy("strip").collect()] == [(0.0, 22.0), (38.0, 100.0)]
    notes = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate([10.0, 12.0, 50.0])], "doc_id long, page int, idx int, want double")
    assert [r.place for r in layout.note_places(notes, 18.0).orderBy("want").collect()] == [10.0, 28.0, 50.0]


def test_letters_in_boxes_equal_a_full_scan(spark):
    for seed in range(2):
        r = random.Random(seed)
        letters = [(1, 0, i, (x := r.uniform(0, 400)), x + 6, r.uniform(0, 800)) for i in range(150)]
        boxes = [(1, 0, i, ((x := r.uniform(0, 400)), (y := r.uniform(0, 800)), x + r.uniform(0, 90), y + r.uniform(0, 300))) for i in range(40)]
        got = layout.letters_in(
            spark.createDataFrame(letters, "doc_id long, page int, letter_id int, x0 double, x1 double, y double"),
            spark.createDataFrame(boxes, "doc_id long, page int, box_id int, b struct<x0:double,y0:double,x1:double,y1:double>"),
        )
        want = {(a[2], b[2]) for a in letters for b in boxes if b[3][0] <= (a[3] + a[4]) / 2 <= b[3][2] and b[3][1] <= a[5] <= b[3][3]}
        assert {(x.letter_id, x.box_id) for x in got.collect()} == want


def test_ranges_widen_and_meet(spark):
    t = "The first part, then more"
    cases = [(4, 6, (4, 9)), (9, 10, None), (0, 3, (0, 3)), (3, 5, (4, 9)), (0, 99, None), (13, 15, (10, 15))]
    df = spark.createDataFrame([(i, 0, t, a, b) for i, (a, b, _) in enumerate(cases)], "doc_id long, span_ordinal long, text string, start int, stop int")
    got = {r.doc_id: (r.start, r.stop) for r in edits.merge_ranges(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases) if w}
    both = spark.createDataFrame([(1, 0, t, 0, 3), (1, 0, t, 3, 8), (1, 0, t, 16, 20)], df.schema)
    assert rows(edits.merge_ranges(both).select("start", "stop")) == [(0, 3), (4, 9), (16, 20)]


def test_page_operations(spark):
    docs = spark.createDataFrame([(i, 3) for i in range(4)], "doc_id long, pages int")
    ops = [(0, 1, "delete_page", 0, None, None), (0, 2, "rotate", 0, 90, None), (1, 1, "rotate", 1, 90, None), (1, 2, "rotate", 1, 300, None), (2, 1, "move_page", 2, None, 0), (2, 2, "move_page", 1, None, 1), *[(3, k, "delete_page", k - 1, None, None) for k in (1, 2, 3)]]
    got = edits.fold_page_ops(spark.createDataFrame(ops, "doc_id long, position int, kind string, page int, degrees int, before int"), docs)
    by = {(r.doc_id, r.page): (r.degrees, r.place) for r in got.collect()}
    assert by[0, 0] == (0, None) and by[0, 1] == (0, 0)
    assert by[1, 1] == (30, 1)
    assert [by[2, p][1] for p in range(3)] == [1, 2, 0]
    assert [by[3, p][1] for p in range(3)] == [None, None, 0]


def test_history(spark):
    log = [(1, 1, "add", [1], "a"), (1, 2, "add", [2, 3], "b"), (1, 3, "undo", None, None), (1, 4, "redo", None, None), (1, 5, "remove", [2], None), (1, 6, "redo", None, None), (1, 7, "undo", None, None), (1, 8, "add", [4], "c"), (1, 9, "redo", None, None)]
    got = edits.replay_history(spark.createDataFrame(log, "doc_id long, seq long, action string, entries array<long>, value string"))
    assert rows(got.drop("replaces")) == [(1, 1, "a"), (1, 4, "c")]


def test_versions_of_new_text(spark):
    """Nudges in a row are one step; undo goes back to where it was before them."""
    nudged = [(1, "add", [1], "at 0", None, None), (2, "revise", [2], "at 1", 1, False), (3, "revise", [3], "at 2", 2, True), (4, "revise", [4], "at 3", 3, True)]
    logs_ = {1: nudged, 2: [*nudged, (5, "undo", None, None, None, None)], 3: [*nudged, (5, "undo", None, None, None, None), (6, "redo", None, None, None, None)]}
    logs_[4] = [*nudged[:3], (4, "add", [9], "b", None, None), (5, "revise", [10], "at 9", 3, True)]
    kind = "doc_id long, seq long, action string, entries array<long>, value string, replaces long, folds boolean"
    got = edits.replay_history(spark.createDataFrame([(d, *x) for d, log in logs_.items() for x in log], kind))
    assert rows(got.where("doc_id < 4")) == [(1, 1, "at 0", None), (1, 4, "at 3", 1), (2, 1, "at 0", None), (3, 1, "at 0", None), (3, 4, "at 3", 1)]
    # another step came between: a step of its own
    assert rows(got.where("doc_id = 4").select("entry", "replaces").na.fill(0)) == [(1, 0), (3, 1), (9, 0), (10, 3)]


def test_changed_words(spark):
    cases = [("a b c", "a x c", ["b"], ["x"]), ("a b", "a b", [], []), ("a a", "a", ["a"], []), ("", "q", [], ["q"]), ("a b c", "c", ["a", "b"], [])]
    df = spark.createDataFrame([(i, b, a) for i, (b, a, *_) in enumerate(cases)], "doc_id long, before string, after string")
    got = {r.doc_id: (r.taken, r.put) for r in edits.changed_words(df).collect()}
    assert got == {i: (t, p) for i, (_, _, t, p) in enumerate(cases)}


def test_find(spark):
    df = spark.createDataFrame([(0, "The eﬃcient of­fice’s file"), (1, "aaa"), (2, "a–b"), (3, "other thé then the")], "doc_id long, text string")
    q = [text.Query("office's"), text.Query("aa"), text.Query("a-b"), text.Query("the", whole_words=True), text.Query("ff"), text.Query("ffi"), text.Query("The", match_case=True), text.Query("")]
    got = {(r.query, r.doc_id): [tuple(m) for m in r.matches] for r in text.find(df, q).collect()}
    assert got[0, 0] == [(12, 21)]
    assert got[1, 1] == [(0, 2)]
    assert got[2, 2] == [(0, 3)]
    assert got[3, 0] == [(0, 3)] and got[3, 3] == [(15, 18)]
    assert got[4, 0] == [(13, 16)]  # the ff of the ligature alone is no whole letter
    assert got[5, 0] == [(5, 6), (13, 17)]
    assert (6, 3) not in got and all(k[0] != 7 for k in got)


def test_dates(spark):
    df = spark.createDataFrame([(0, "13/02/2020 and 03/04/2021"), (1, "03/04/2021"), (2, "2021-02-30 2021-02-28"), (3, "70.23.22.57 1.2.3.4"), (4, "2020年3月4日"), (5, "12/13/99 and 13/12/99"), (6, "05.05.24")], "doc_id long, text string")
    got = sorted((r.doc_id, r.written, str(r.date)) for r in dates.numeric_dates(df, 2024).collect())
    assert got == [(0, "03/04/2021", "2021-04-03"), (0, "13/02/2020", "2020-02-13"), (2, "2021-02-28", "2021-02-28"), (4, "2020年3月4日", "2020-03-04"), (5, "12/13/99", "1999-12-13"), (5, "13/12/99", "1999-12-13"), (6, "05.05.24", "2024-05-05")]


def test_dates_are_rewritten_as_written(spark):
    df = spark.createDataFrame([(0, "13/02/2020, 2020-02-13 and 13.2.20; 14/02/2020"), (1, "02/13/2020"), (2, "nothing")], "doc_id long, text string")
    changes = spark.createDataFrame([(i, "2020-02-13", "2021-11-05") for i in range(3)], "doc_id long, old string, new string").select("doc_id", F.to_date("old").alias("old"), F.to_date("new").alias("new"))
    names = dates.date_names(spark, ["en"])
    settled = dates.settle(dates.numeric_with_weekdays(dates.numeric_dates(df, 2024), names), names, ["en"])
    got = {r.doc_id: r.text for r in text.rewrite_values(df, dates.date_swaps(df, settled, names, changes)).collect()}
    assert got == {0: "05/11/2021, 2021-11-05 and 5.11.21; 14/02/2020", 1: "11/05/2021", 2: "nothing"}


def test_amounts_are_rewritten_as_written(spark):
    cases = {
        "$5 and $50, $9-$5": (7, "$7 and $50, $9-$5"), "1.250,00 €": (1234567.5, "1.234.567,50 €"), "₹1,25,000.00": (12345678, "₹1,23,45,678.00"), "($5.50)": (6, "$6.00"), "(£5.50)": (-1000, "(£1000.00)"), "-$5": (-6, "-$6"), "$-5": (6, "$6"),
        "5− €": (-7.25, "7− €"), "USD 1'250.50": (-3, "-USD 3.00"), "$1,000": (25, "$25"), "£1,000": (1000000.5, "£1,000,001"), "": (1, ""),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    new = spark.createDataFrame([(i, Decimal(str(v))) for i, (v, _) in enumerate(cases.values())], "doc_id long, new decimal(38,9)")
    found = amounts.amounts(df, {"USD": 2, "EUR": 2, "INR": 2, "GBP": 2}).where("written <> '$50'")
    changes = found.join(new, "doc_id").select("doc_id", "currency", F.col("amount").alias("old"), "new").distinct()
    got = {r.doc_id: r.text for r in text.rewrite_values(df, amounts.amount_swaps(found, changes)).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == {t: want for t, (_, want) in cases.items()}


def test_noughts_marked_as_negative_keep_their_marks(spark):
    df = spark.createDataFrame([(0, "owed (£0.00)"), (1, "-$0.00 and $0.00"), (2, "(£0.00)")], "doc_id long, text string")
    found = amounts.amounts(df, {"USD": 2, "GBP": 2})
    assert sorted((r.written, r.negative) for r in found.where("doc_id = 1").collect()) == [("$0.00", False), ("-$0.00", True)]
    to = F.when(F.col("doc_id") == 2, 5).when(F.col("negative"), -1000).otherwise(7).cast("decimal(38,9)")
    changes = found.select("doc_id", "currency", "negative", F.col("amount").alias("old"), to.alias("new"))
    got = {r.doc_id: r.text for r in text.rewrite_values(df, amounts.amount_swaps(found, changes)).collect()}
    assert got == {0: "owed (£1000.00)", 1: "-$1000.00 and $7.00", 2: "£5.00"}


def test_swaps_do_not_feed_each_other(spark):
    df = spark.createDataFrame([(0, "$10 then $5, $10"), (1, None)], "doc_id long, text string")
    found = amounts.amounts(df, {"USD": 2})
    changes = spark.createDataFrame([(0, "USD", Decimal(10), Decimal(5)), (0, "USD", Decimal(5), Decimal(7))], "doc_id long, currency string, old decimal(38,9), new decimal(38,9)")
    assert sorted((r.doc_id, r.text) for r in text.rewrite_values(df, amounts.amount_swaps(found, changes)).collect()) == [(0, "$5 then $7, $5"), (1, None)]


@pytest.fixture(scope="module")
def names(spark):
    return dates.date_names(spark, ["en", "de", "fr", "es", "it", "sv", "nl", "ro", "gl"])


@pytest.fixture
def interpreted(spark):
    """Compiling the code of these plans takes far longer than their few rows."""
    for k, v in (("wholeStage", "false"), ("factoryMode", "NO_CODEGEN")):
        spark.conf.set(f"spark.sql.codegen.{k}", v)
    yield
    for k in ("wholeStage", "factoryMode"):
        spark.conf.unset(f"spark.sql.codegen.{k}")


def as_days(spark, names, cases, reader, to, year_of=2024):
    """Texts, each a document of its own or of those listed with it, whose first date becomes ``to``."""
    rows, text_of = [], {}
    for i, (first, *others) in enumerate(cases):
        text_of[i] = first
        rows += [(i, " | ".join([first, *others]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    work = Workspace(spark, "days")
    named, numeric = work.write(dates.named_dates(df, names), "named"), work.write(dates.numeric_with_weekdays(dates.numeric_dates(df, year_of), names), "numeric")
    changes = df.select("doc_id", F.explode(F.sequence(F.to_date(F.lit("2026-03-14")), F.to_date(F.lit("2026-12-14")), F.expr("interval 1 month"))).alias("old"), F.to_date(F.lit(to)).alias("new"))
    settled = work.write(dates.settle(named, names, reader), "settled"), work.write(dates.settle(numeric, names, reader, named), "numbers")
    swaps = [dates.named_date_swaps(settled[0], names, changes), dates.date_swaps(df, settled[1], names, changes)]
    return {text_of[r.doc_id]: r.text.split(" | ")[0] for r in text.rewrite_values(df, *swaps).collect()}


def test_named_dates_are_rewritten_as_written(spark, names, interpreted):
    cases = {
        "on 14 March 2026.": "on 2 April 2026.", "MARCH 14th, 2026": "APRIL 2nd, 2026", "14 Mar. 2026": "2 Apr. 2026", "am 14. März 2026": "am 2. April 2026", "2026 March 14": "2026 April 2",
        "13-14 March 2026, 14 March 2026": "13-14 March 2026, 2 April 2026", "14 de marzo de 2026": "2 de abril de 2026", "Saturday, 14 March 2026": "Thursday, 2 April 2026", "SAT 14 MAR 2026": "THU 2 APR 2026",
        "Due 14 March 2026": "Due 2 April 2026", "Sat. 14 March 2026": "Thu. 2 April 2026", "Fri 14 March 2026": "Fri 14 March 2026", "Steps 1 to Saturday, 14 March 2026": "Steps 1 to Thursday, 2 April 2026", "14th of March 2026": "2nd of April 2026", "14. of March 2026": "2. of April 2026",
    }
    assert as_days(spark, names, [(t,) for t in cases], ["en", "es"], "2026-04-02") == cases
    german = {"Sa., 14. März 2026": "Do., 2. April 2026", "Samstag, 14. März 2026": "Donnerstag, 2. April 2026"}
    assert as_days(spark, names, [(t,) for t in german], ["de"], "2026-04-02") == german
    # a stop that is the language's own goes with its name
    romanian = {"sâm. 14 mar. 2026": "joi 2 apr. 2026", "sâm., 14 mar. 2026": "joi, 2 apr. 2026", "sâm. 14.03.2026": "joi 02.04.2026"}
    assert as_days(spark, names, [(t,) for t in romanian], ["ro"], "2026-04-02") == romanian


def test_months_that_languages_share_are_settled_or_left_alone(spark, names, interpreted):
    shared = ["14 April 2026", "14 September 2026", "14 Mai 2026", "14 may 2026", "14 novembre 2026"]
    assert as_days(spark, names, [(t,) for t in shared], [], "2026-06-02") == {t: t for t in shared}
    assert as_days(spark, names, [(t,) for t in shared], ["en"], "2026-06-02") == {t: t for t in shared} | {"14 April 2026": "2 June 2026", "14 September 2026": "2 June 2026", "14 may 2026": "2 june 2026"}
    assert as_days(spark, names, [(t,) for t in shared], ["it", "de"], "2026-06-02") == {"14 April 2026": "2 Juni 2026", "14 September 2026": "2 Juni 2026", "14 Mai 2026": "2 Juni 2026", "14 may 2026": "14 may 2026", "14 novembre 2026": "2 giugno 2026"}
    # written alike wherever it is named, it needs no reader
    assert as_days(spark, names, [("14 March 2026",)], [], "2026-04-02") == {"14 March 2026": "2 April 2026"}
    # the document's other dates come before the reader
    got = as_days(spark, names, [("Due 14 mars 2026", "Signed 2 januari 2026"), ("14 novembre 2026", "2 Januar 2026", "3 Oktober 2026"), ("14 mar 2026", "2 janvier 2026", "3 octobre 2026"), ("14 dec 2026", "2 januari 2026")], ["nl", "it"], "2026-04-02")
    assert got == {"Due 14 mars 2026": "Due 2 april 2026", "14 novembre 2026": "14 novembre 2026", "14 mar 2026": "14 mar 2026", "14 dec 2026": "2 apr 2026"}


def test_weekdays_beside_numbers(spark, names, interpreted):
    assert as_days(spark, names, [("Sam 14/03/2026",), ("Sat 2026-03-14",), ("Fri 14/03/2026",), ("sat 14.3.2026",)], ["fr", "en"], "2026-03-17") == {"Sam 14/03/2026": "Mar 17/03/2026", "Sat 2026-03-14": "Tue 2026-03-17", "Fri 14/03/2026": "Fri 17/03/2026", "sat 14.3.2026": "tue 17.3.2026"}
    # lunedì, lunes and lundi are all "lun": nothing settles which
    assert as_days(spark, names, [("lun 14/12/2026",)], [], "2026-03-17") == {"lun 14/12/2026": "lun 14/12/2026"}


def test_named_dates_and_language(spark):
    listed = [("en", "March", 3), ("de", "März", 3), ("fr", "mars", 3), ("en", "April", 4), ("de", "April", 4)]
    few = spark.createDataFrame([(lang, "month", "long", i, n) for lang, n, i in listed], dates.NAME)
    df = spark.createDataFrame([(0, "on 14 March 2020, April 2nd, 2021"), (1, "13–14 March 2020"), (2, "am 3. April 2020"), (3, "31 April 2020")], "doc_id long, text string")
    found = dates.named_dates(df, few)
    assert sorted((r.doc_id, str(r.date), r.languages) for r in found.collect()) == [(0, "2020-03-14", ["en"]), (0, "2021-04-02", ["en"]), (2, "2020-04-03", ["de", "en"])]
    assert rows(dates.settle_language(dates.settle(found, few, ["de", "en"]))) == [(0, "en"), (2, "de")]


def test_amounts(spark):
    df = spark.createDataFrame([(0, "1 250,00 €"), (1, "$10-$20"), (2, "₹1,25,000.00"), (3, "KWD 1.250"), (4, "1.250,00− €"), (5, "($5.50)"), (6, "€ 5 €"), (7, "12 apples")], "doc_id long, text string")
    got = {r.doc_id: (r.currency, r.amount) for r in amounts.amounts(df, {"USD": 2, "EUR": 2, "INR": 2, "KWD": 3}).collect()}
    assert got[0] == ("EUR", Decimal("1250.000000000"))
    assert got[2] == ("INR", Decimal("125000.000000000"))
    assert got[3] == ("KWD", Decimal("1.250000000"))
    assert got[4] == ("EUR", Decimal("-1250.000000000")) and got[5] == ("USD", Decimal("-5.500000000"))
    assert 1 not in got and 6 not in got and 7 not in got


def test_amounts_where_they_stand(spark):
    cases = {
        "Fee $5 today. Range elsewhere $9-$5.": [("USD", 5.0)], "$1,25,00": [], "₩5,000 and ₿2": [("₩", 5000.0), ("₿", 2.0)], "12 345,5 €": [("EUR", 12345.5)], "€10 – €20": [], "EUR 10-20": [], "(see $5)": [("USD", 5.0)],
        "($5)": [("USD", -5.0)], "-$5": [("USD", -5.0)], "$-5": [("USD", -5.0)], "$5- now": [("USD", -5.0)], "XXQ 5": [], "1'250.50 USD": [("USD", 1250.5)], "Room 5 12 €": [("EUR", 12.0)], "5 € 6": [("EUR", 5.0)], "$5.1234": [("USD", 5.1234)], "v1.2.3 €": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {i: [] for i in range(len(cases))}
    for r in amounts.amounts(df, {"USD": 2, "EUR": 2}).collect():
        got[r.doc_id].append((r.currency, float(r.amount)))
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_named_dates_by_order_weekday_and_range(spark, names):
    cases = {
        "2024 March 14": 1, "Monday 14 March 2024": 0, "Mon 14 March 2024": 0, "Thursday, 14 March 2024": 1, "Thu 14 March 2024": 1, "14 March 2024 – 15 March 2024": 0, "13 – 14 March 2024": 0, "13-14 March 2024": 0, "14 March - 15 March 2024": 0, "13. bis 14. März 2024": 0,
        "14 de marzo de 2024": 1, "14 of marzo 2024": 0, "March 14, 2024 to March 15, 2024": 0, "on 14 March 2024, then 15 March 2024": 2, "from 14 March 2024 we had 3 cats": 1, "14 March 2024 to 3 cats": 1, "2024. März 14-15.": 0, "14 March 2024.5": 0, "Wed 13 – Thu 14 March 2024": 0,
        "Steps 1 to Thursday, 14 March 2024": 1, "No. 12-14 March 2024": 0, "1.2-14 March 2024": 1, "March 13th, 2024": 1, "March 13rd, 2024": 0, "1er mars 2024": 1, "2er mars 2024": 0,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = dict.fromkeys(range(len(cases)), 0)
    for r in dates.named_dates(df, names).collect():
        got[r.doc_id] += 1
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_every_letter_that_typing_cannot_tell_apart(spark):
    typed = {" ": text.SPACES, "'": text.QUOTES, '"': text.DOUBLE, "-": text.DASHES}
    odd = [(f"a{x}b", f"a{plain}b") for plain, letters in typed.items() for x in letters] + [(f"a{x}b", f"a{plain}b") for x, plain in text.SPELLED.items()]
    for plain in sorted({p for _, p in odd}):
        mine = [(i, t) for i, (t, p) in enumerate(odd) if p == plain]
        got = text.find(spark.createDataFrame(mine, "doc_id long, text string"), [text.Query(plain)]).collect()
        assert {(r.doc_id, *map(tuple, r.matches)) for r in got} == {(i, (0, len(t))) for i, t in mine}
    apart = spark.createDataFrame([(0, "a\u200cb"), (1, "a\u200db"), (2, "\u00ada\u00ad\u00adb\u00ad ﬁx")], "doc_id long, text string")
    assert [(r.doc_id, *map(tuple, r.matches)) for r in text.find(apart, [text.Query("ab")]).collect()] == [(2, (1, 5))]
    assert [list(map(tuple, r.matches)) for r in text.find(apart, [text.Query("b fix")]).collect()] == [[(4, 9)]] and text.find(apart, [text.Query("b f")]).count() == 0


def test_replacements_take_over_typing(spark):
    df = spark.createDataFrame([(0, "a\u00a0b’s x"), (1, "a b's a b’s"), (2, "x a—b"), (3, "none")], "doc_id long, text string")
    got = {(r.doc_id, r.query): r.changed for r in text.replace_all(text.find(df, [text.Query("a b's"), text.Query("a-b")]), ["c d's", "c-d"]).collect()}
    assert got == {(0, 0): "c\u00a0d’s x", (1, 0): "c d's c d’s", (2, 1): "x c—d"}


def test_long_texts_cost_linear_time(spark):
    began = time.monotonic()
    df = spark.createDataFrame([(1, "the " * 100_000)], "doc_id long, text string")
    assert text.find(df, [text.Query("the")]).select(F.size("matches").alias("n")).first().n == 100_000
    values = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("start"), (F.col("id") + 2).cast("int").alias("stop"), F.lit("v").alias("kind"))
    assert text.resolve_values(values).count() == 100_000
    assert time.monotonic() - began < 60


def test_refused_jobs_never_join_the_line(spark):
    jobs = [(1, 0, 100), (1, 1, 5), (1, 2, 1000), (1, 3, 50), (1, 4, 60), (1, 5, 8), (2, 0, 1), (2, 1, 2)]
    got = {r.key: (r.jobs, r.peak, r.over) for r in logs.concurrency(spark.createDataFrame(jobs, "key long, started long, ended long"), 1, 1).collect()}
    assert got == {1: (6, 2, 3), 2: (2, 1, 0)}


def tasks_of(df):
    """How many partitions of the walk behind a result have rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be put together
    try:
        return df.withColumn("_p", F.spark_partition_id()).select("_p").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_hot_key_is_walked_in_pieces(spark):
    """Half of all rows are one key's; answers equal a plain walk, and several tasks give them."""
    r = random.Random(8)
    second = 10**6
    bursts = [t * 3600 * second + r.randrange(40) * second for t in range(150) for _ in range(r.choice([1, 2, 15]))]
    asked = [(0, i, us) for i, us in enumerate(bursts)] + [(1 + i % 40, 10_000 + i, r.randrange(150 * 3600) * second) for i in range(len(bursts))]
    want = {}
    for key in range(41):
        times = deque()
        for us, i in sorted((u, i) for k, i, u in asked if k == key):
            while times and times[0] <= us - 20 * second:
                times.popleft()
            want[i] = len(times) < 4
            times += [us] if want[i] else []
    got = logs.admit(spark.createDataFrame(asked, "key long, request long, us long"), 4, 20.0)
    assert {x.request: x.admitted for x in got.collect()} == want and not all(want.values())
    assert tasks_of(got.where("key = 0 and not admitted")) > 2

    jobs = [(k, us, us + r.randrange(30) * second) for k, _, us in asked]
    got = logs.concurrency(spark.createDataFrame(jobs, "key long, started long, ended long"), 1, 2, bucket_us=7200 * second)
    for x in got.collect():
        line, peak, over = [], 0, 0
        for started, ended in sorted((s, e) for k, s, e in jobs if k == x.key):
            line = [e for e in line if e > started]
            if len(line) < 3:
                line.append(ended)
                peak = max(peak, len(line))
            else:
                over += 1
        assert (x.jobs, x.peak, x.over) == (sum(k == x.key for k, *_ in jobs), peak, over)

    day = 86400 * second
    opens = [(i % 2 * (1 + i % 7), f"d{r.randrange(12)}", i, r.randrange(3000) * day) for i in range(600)]
    free = set()
    for b in {o[0] for o in opens}:
        held, until = set(), None
        for us, i, d in sorted((us, i, d) for k, d, i, us in opens if k == b):
            held = set() if until is not None and us >= until else held
            ok = d in held or len(held) < 3
            until = us + 365 * day if ok and d not in held else until
            held |= {d} if ok else set()
            free.add((b, d, i, us, ok))
    assert {tuple(x) for x in usage.meter_browsers(spark.createDataFrame(opens, "browser long, digest string, event_id long, us long"), 3).collect()} == free


def test_only_the_log_since_the_history_was_emptied_is_walked(spark):
    log = [(1, s, "add" if s % 2 == 0 else "undo", [s] if s % 2 == 0 else None, "v") for s in range(4000)] + [(1, 4000 + s, "add", [4000 + s], "w") for s in range(5)] + [(2, 1, "undo", None, None), (2, 2, "redo", None, None)]
    df = spark.createDataFrame(log, "doc_id long, seq long, action string, entries array<long>, value string")
    left = edits.since_emptied(edits.with_revisions(df), 500)
    assert left.where("doc_id = 1").count() == 5 and left.where("doc_id = 2").count() == 2
    assert rows(edits.replay_history(df, 500).select("entry")) == [(4000 + s,) for s in range(5)]


def test_room_equals_a_full_scan(spark):
    r = random.Random(4)
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    spans = []
    for doc in range(6):
        for k in range(60):
            x, y = r.randrange(0, 300), r.choice([0, 3, 14, 17, 28]) + r.choice([0, 0, 40])
            spans.append((doc, 0, k, (float(x), float(y), float(x + r.choice([0, 5, 5, 40, 120])), float(y + r.choice([12, 20]))), r.random() < 0.1))
    art = [(doc, 0, (float(r.randrange(300)), float(r.randrange(80)), 310.0, 90.0)) for doc in range(6) for _ in range(3)]
    got = {(x.doc_id, x.ordinal): x.room for x in layout.room(spark.createDataFrame(spans, f"doc_id long, page int, ordinal long, bbox {box}, turned boolean"), spark.createDataFrame(art, f"doc_id long, page int, bbox {box}")).collect()}
    for d, _, k, b, turned in spans:
        mine = [s for s in spans if s[0] == d]
        over = lambda o: min(o[3], b[3]) - max(o[1], b[1])
        walls = [max(s[3][2] for s in mine)]
        for s in mine:
            o = s[3]
            kerned = over(o) > min(o[3] - o[1], b[3] - b[1]) / 2 and o[0] > b[0] and o[2] > b[2]
            if s[2] != k and over(o) > 0.1 and (o[0] >= b[2] - 0.1 or kerned):
                walls.append(o[0])
        tallest = max(s[3][3] - s[3][1] for s in mine if not s[4])
        for _, _, a in (x for x in art if x[0] == d):
            beside = any(min(a[3], s[3][3]) - max(a[1], s[3][1]) > 0.1 for s in mine if not s[4])
            if beside and over(a) > 0.1 and a[2] >= b[2] - 0.1 and tallest:
                walls.append(a[0] if a[0] >= b[2] - 0.1 else a[2])
        assert got[d, k] == (0.0 if turned else max(min(walls) - b[2], 0.0)), (d, k)


def test_walls_on_one_long_line(spark):
    import numpy as np

    r = np.random.default_rng(7)
    n = 1500
    x0 = r.integers(0, 2000, n).astype(float)
    x1 = x0 + r.choice([0.0, 0.05, 5.0, 90.0, 400.0], n)
    y0 = r.choice([0.0, 2.0, 15.0], n)
    y1 = y0 + r.choice([12.0, 20.0], n)
    rows = [(1, 0, i, (float(x0[i]), float(y0[i]), float(x1[i]), float(y1[i])), False) for i in range(n)]
    spans = spark.createDataFrame(rows, "doc_id long, page int, ordinal long, bbox struct<x0:double,y0:double,x1:double,y1:double>, turned boolean")
    got = {x.ordinal: x.wall for x in layout.text_walls(spans).collect()}
    for i in range(n):
        over = np.minimum(y1, y1[i]) - np.maximum(y0, y0[i])
        kerned = (over > np.minimum(y1 - y0, y1[i] - y0[i]) / 2) & (x0 > x0[i]) & (x1 > x1[i])
        ahead = (over > 0.1) & ((x0 >= x1[i] - 0.1) | kerned) & (np.arange(n) != i)
        assert got.get(i) == (float(x0[ahead].min()) if ahead.any() else None), i


def test_values_resolve(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 3, 9, "b"), (1, 5, 7, "c"), (1, 0, 2, "d")], "doc_id long, start int, stop int, kind string")
    assert rows(text.resolve_values(df)) == [(1, 0, 5, "a"), (1, 5, 7, "c")]


def test_leaks(spark):
    r = spark.createDataFrame([(0, "Card 4111 2222 3333"), (1, "Card A 4111"), (2, "x")], "k long, text string")
    left = spark.createDataFrame([(0, "4111 3333"), (1, "[REDACTED] A"), (2, "a x b")], "k long, left_text string")
    assert {x.k: x.leaks for x in redaction.leaks_in_place(r, left, ["k"]).collect()} == {0: True, 1: False, 2: True}


def test_hidden_copies(spark):
    terms = redaction.redaction_terms(spark.createDataFrame([(1, "John Smith", "Acct", ""), (2, "ﬁle", "", "")], "doc_id long, text string, before string, after string"))
    copies = spark.createDataFrame([(1, "title", "For AcctJohn"), (1, "comments", "Johnson"), (1, "metadata", "by SMITH."), (2, "title", "a File")], "doc_id long, place string, text string")
    assert rows(redaction.hidden_places(terms, copies)) == [(1, ["title", "metadata"]), (2, ["title"])]
    assert {(r.place, r.text) for r in redaction.scrub(copies, terms).where("doc_id = 1").collect()} >= {("metadata", "by ."), ("comments", "Johnson")}


def test_admission_equals_a_plain_walk(spark):
    r = random.Random(1)
    asked = [(i % 3, i, int(t * 1_000_000)) for i, t in enumerate(sorted(r.uniform(0, 300) for _ in range(200)))]
    got = {x.request: x.admitted for x in logs.admit(spark.createDataFrame(asked, "key long, request long, us long"), 4, 20.0).collect()}
    held: dict[int, deque] = {}
    for key, request, us in asked:
        times = held.setdefault(key, deque())
        while times and times[0] <= us - 20_000_000:
            times.popleft()
        ok = len(times) < 4
        if ok:
            times.append(us)
        assert got[request] == ok


def test_log_lines(spark):
    lines = ["  lost trace", "12:00 INFO noted app.x request_done status=200 ms=4", "Traceback", "  more", "12:01 ERROR failed app.y unhandled"]
    log, bad = logs.parse_log(spark.createDataFrame([(0, i, s) for i, s in enumerate(lines)], "file int, n long, line string"))
    got = {r.n: r for r in log.collect()}
    assert got[1].fields == {"status": "200", "ms": "4"} and got[1].trace == ["Traceback", "  more"] and got[4].trace is None
    assert [r.n for r in bad.collect()] == [0]
    folder = "A" * 22
    assert logs.scrub_log(spark.createDataFrame([(f"GET /d/{folder}/p {folder}x",)], "line string")).first().scrubbed == f"GET /d/<document>/p {folder}x"


def test_languages(spark):
    cases = {"fr-CA, en;q=0.8": "fr", "xx": "en", "": "en", "en-GB;q=0.5, fr;q=0.5": "en", "fr;q=0, fr-CA": "en", "de;q=2, fr;q=0.1": "fr", None: "en"}
    df = spark.createDataFrame(list(enumerate(cases)), "request int, accept string")
    got = {r.request: r.language for r in messages.best_language(df, ["en", "fr", "de"]).collect()}
    assert got == dict(enumerate(cases.values()))


def test_fit(spark):
    cases = [(100.0, 103.0, 0.0, "as-is", False, None, None), (100.0, 104.5, 0.0, "condense", True, "condense", 5), (100.0, 111.0, 0.0, "shrink", True, "shrink", 11), (100.0, 150.0, 10.0, "shrink", True, "as-is", 40), (0.0, 50.0, 0.0, "shrink", True, "as-is", 5000)]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, original_pt double, new_pt double, room double, asked string")
    got = [(r.too_long, r.drawn, r.percent) for r in fidelity.fit_replacements(df).orderBy("i").collect()]
    assert got == [c[4:] for c in cases]


def test_fonts(spark):
    names = {"ABCDEF+Arial-BoldItalic": ("Arial", 700, True), "Foo,SemiBold": ("Foo", 600, True), "Bar": ("Bar", 400, False), "Baz-ExtraLight": ("Baz", 200, False)}
    df = spark.createDataFrame([(n, None) for n in names], "name string, listed int")
    assert {r.name: (r.family, r.weight, r.bold) for r in typography.normalise_fonts(df).collect()} == names
    w = spark.createDataFrame([("a", c, 500.0) for c in "xyz"] + [("b", c, 500.5) for c in "xyzq"] + [("c", c, 900.0) for c in "xyz"], "font_key string, letter string, width double")
    copies = spark.createDataFrame([(1, "N", k, "t", True, i) for i, k in enumerate("abc")], "doc_id long, name string, font_key string, kind string, upright boolean, rank int")
    refusals = {(r.own, r.other): r.refusal for r in typography.vouch_copies(copies, w).collect()}
    assert refusals["a", "b"] is None and refusals["a", "c"] == "copy_other_widths"
    assert rows(typography.pool_letters(copies, w).select("letter", "lender")) == [("q", "b"), ("x", "a"), ("y", "a"), ("z", "a")]


def test_font_catalog(spark):
    meta = 'name: "Foo Sans"\nfonts {\n  filename: "Foo.ttf"\n  weight: 400\n  style: "normal"\n}\nfonts {\n  filename: "Foo[wght].ttf"\n  weight: 400\n  style: "normal"\n}\n'
    tree = spark.createDataFrame([(f"100644 blob 00\tofl/foo/{f}",) for f in ("Foo.ttf", "Foo[wght].ttf", "METADATA.pb")], "line string")
    files = spark.createDataFrame([("ofl/foo/METADATA.pb", meta), ("ofl/foo/OFL.txt", "with Reserved Font Name Foo")], "path string, text string")
    got = ingest.build_font_catalog(tree, files).collect()
    assert [(r.path, r.weight, r.static, r.reserved) for r in got] == [("ofl/foo/Foo.ttf", 400, True, True)]


def test_spans_round_trip(spark, tmp_path):
    spans = build_spans(pieces(spark, ("a", 0.0, 10.0, {}), ("b", 90.0, 99.0, {})))
    ingest.write_spans(spans, str(tmp_path / "s"))
    assert ingest.read_spans(spark, str(tmp_path / "s")).select("ordinal", "text", "fragments").orderBy("ordinal").collect() == spans.select("ordinal", "text", "fragments").orderBy("ordinal").collect()


def test_broken_json_is_set_aside(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"doc_id": 1}\n{broken\n')
    good, bad = ingest.scan_json(spark, str(tmp_path), "doc_id long")
    assert good.cache().count() == 1 and bad.cache().count() == 1


def test_ledger_ties_and_late_reads(spark):
    e = spark.createDataFrame([(1, 1, 7, 10, 100, 5, "invoice.paid"), (1, 2, 7, 10, 100, 5, "invoice.paid"), (2, 3, 7, 10, 200, 5, "invoice.paid"), (3, 4, 7, 10, 300, 6, "invoice.paid"), (4, 5, None, 10, 1, 9, "invoice.paid")], "id long, arrival long, account long, created long, paid_until long, paid_read_at long, type string")
    applied = usage.apply_events(usage.ledger(e))
    assert rows(applied.select("id", "outcome")) == [(1, "applied"), (2, "superseded"), (3, "applied"), (4, "no_account")]
    assert rows(usage.paid_state(applied).select("account", "paid_until")) == [(7, 300)]


def test_spellings(spark):
    cover = spark.createDataFrame([("a", c) for c in "caf\u00e9"] + [("b", c) for c in ("c", "a", "f", "e", "\u0301")], "font_key string, letter string")
    df = spark.createDataFrame([(1, "a", "cafe\u0301"), (2, "b", "caf\u00e9"), (3, "a", "caf\u00e9\u0416"), (4, "a", "zz")], "k long, font string, text string")
    got = {r.k: r.spelling for r in typography.best_spelling(df, cover, ["k"]).collect()}
    assert got == {1: "caf\u00e9", 2: "cafe\u0301", 3: "caf\u00e9\u0416", 4: "zz"}


def test_address_blocks(spark):
    cases = {"1.2.3.4": "1.2.3.4", "::ffff:1.2.3.4": "1.2.3.4", "2001:db8:1:2:3::4": "2001:db8:1:2::/64", "nobody": "nobody", None: None}
    got = {r.address: r.key for r in logs.with_address_block(spark.createDataFrame([(a,) for a in cases], "address string")).collect()}
    assert got == cases


def test_catalog_files(spark):
    catalog = spark.createDataFrame([("Foo", "f-static", 400, "normal", True, False), ("Foo", "f-var", 400, "normal", False, False), ("Bar", "b-var", 400, "normal", False, True)], "family string, path string, weight int, style string, static boolean, reserved boolean")
    fonts = spark.createDataFrame([(1, "Old Foo", 400, "normal"), (2, "Foo", 700, "normal"), (3, "Bar", 400, "normal"), (4, "Foo", 400, "italic"), (5, "Nil", 400, "normal")], "font long, family string, weight int, style string")
    aliases = spark.createDataFrame([("Old Foo", "Foo")], "old string, new string")
    got = {r.font: (r.path, r.reason) for r in typography.catalog_file(fonts, catalog, aliases).collect()}
    assert got == {1: ("f-static", None), 2: ("f-var", None), 3: (None, "reserved_name"), 4: (None, "no_style"), 5: (None, "no_family")}


def test_long_version_chains(spark):
    chain = [(1, i, None if i == 0 else i - 1, f"v{i}") for i in range(100)]
    side = [(1, 200, None, "a"), (1, 201, 200, ""), (2, 5, None, "b"), (2, 7, 5, "c"), (2, 9, None, "d")]
    got = edits.latest_versions(spark.createDataFrame(chain + side, "doc_id long, entry long, replaces long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 99, "v99"), (2, 5, 7, "c"), (2, 9, 9, "d")]


def test_long_logs_are_streamed(spark):
    r = random.Random(3)
    log = [(k, i, r.randrange(200) * 10**5) for i, k in enumerate([None, 1, 1, 2**60 + 1] * 60)]
    opens = [(k, f"d{r.randrange(9)}", i, r.randrange(40) * 40 * 86400 * 10**6) for i, k in enumerate([None, 1, 1, 2] * 60)]
    want, free = [], []
    for key in (None, 1, 2**60 + 1):
        times = []
        for _, i, us in sorted((x for x in log if x[0] == key), key=lambda x: (x[2], x[1])):
            ok = len([t for t in times if t > us - 10**6]) < 2
            times += [us] * ok
            want.append((key, i, us, ok))
    for key in (None, 1, 2):
        held, until = set(), None
        for _, d, i, us in sorted((x for x in opens if x[0] == key), key=lambda x: (x[3], x[2])):
            held = set() if until is not None and us >= until else held
            ok = d in held or len(held) < 3
            until = us + 365 * 86400 * 10**6 if ok and d not in held else until
            held |= {d} if ok else set()
            free.append((key, d, i, us, ok))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        a = logs.admit(spark.createDataFrame(log, "key long, request long, us long"), 2, 1.0)
        m = usage.meter_browsers(spark.createDataFrame(opens, "browser long, digest string, event_id long, us long"), 3)
        assert {tuple(x) for x in a.collect()} == set(want) and {tuple(x) for x in m.collect()} == set(free)
        assert not [1 for df in (a, m) if "FlatMapGroups" in df._jdf.queryExecution().toString()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_broken_files_are_quarantined(spark, tmp_path):
    import gzip

    rows_ = "\n".join(f'{{"doc_id": {i}, "lang": "en"}}' for i in range(5000))
    whole = gzip.compress(rows_.encode())
    for name, content in {"good": whole, "cut": whole[: len(whole) // 2], "empty": b"", "junk": b"x" * 50, "other": gzip.compress(b"no json"), "odd": gzip.compress(b'{"doc_id": 1}\nnot\n'), "bytes": gzip.compress(b"\xff\xfe")}.items():
        (tmp_path / f"{name}.gz").write_bytes(content)
    good, bad = ingest.scan_files(spark, str(tmp_path), "doc_id long, lang string")
    assert {r.file.rpartition("/")[2]: r.note for r in bad.collect()} == {"cut.gz": "truncated", "empty.gz": "empty", "junk.gz": "unreadable", "other.gz": "no rows", "bytes.gz": "unreadable"}
    n = {r.file.rpartition("/")[2]: r["count"] for r in good.groupBy("file").count().collect()}
    assert n.pop("good.gz") == 5000 and n.pop("odd.gz") == 1 and 0 < n.pop("cut.gz") < 5000 and not n
    (tmp_path / "none").mkdir()
    (tmp_path / "none/a.gz").write_bytes(b"x")
    with pytest.raises(ValueError):
        ingest.scan_files(spark, str(tmp_path / "none"), "doc_id long, lang string")


def test_faces_exact_pinned_family_plain(spark):
    listed = ["Calibri Bold", "ABC+X-Bold", "Y-LightItal", "CMBX10", "Calibri,Italic", "Shipped-Bold", "Nobody Black Italic", "Calibri Semi Bold"]
    fonts = typography.normalise_fonts(spark.createDataFrame([(n, n, None) for n in listed], "font string, name string, listed int")).withColumn("kind", F.lit(None).cast("string"))
    got = {r.name: (r.family, r.weight, r.bold, r.slanted, r.usual) for r in fonts.collect()}
    assert got == {
        "Calibri Bold": ("Calibri", 700, True, False, True), "ABC+X-Bold": ("X", 700, True, False, True), "Y-LightItal": ("Y", 300, False, True, False), "CMBX10": ("CMBX10", 400, False, False, True), "Calibri,Italic": ("Calibri", 400, False, True, True),
        "Shipped-Bold": ("Shipped", 700, True, False, True), "Nobody Black Italic": ("Nobody", 900, True, True, False), "Calibri Semi Bold": ("Calibri Semi", 700, True, False, True),
    }
    catalog = spark.createDataFrame(
        [("C-Regular", "Carlito", False, False, "sans", False, ["Calibri"]), ("C-Bold", "Carlito", True, False, "sans", False, ["Calibri"]), ("LM-Bold", "Latin Modern", True, False, "serif", False, ["CMBX10"]), ("Shipped-Bold", "Shipped", True, False, "sans", False, []), ("L-Regular", "Liberation", False, False, "sans", True, [])],
        "face string, family string, bold boolean, slanted boolean, kind string, plain boolean, same_widths array<string>",
    )
    told = {r.font: (r.face, r.found_by, r.same_widths) for r in typography.look_alike(fonts, catalog).collect()}
    assert told == {
        "Calibri Bold": ("C-Bold", "family", True), "ABC+X-Bold": ("L-Regular", "plain", False), "Y-LightItal": ("L-Regular", "plain", False), "CMBX10": ("LM-Bold", "pinned", True), "Calibri,Italic": ("C-Regular", "family", False),
        "Shipped-Bold": ("Shipped-Bold", "exact", True), "Nobody Black Italic": ("L-Regular", "plain", False), "Calibri Semi Bold": ("L-Regular", "plain", False),
    }

"""Texts worked on whole, where they are read: against what a row a piece or a letter gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliomill.operators import edits, layout, typography
from foliomill.operators import spans as spans_op
from foliomill.plans import registry
from foliomill.sources import derive, typeset


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def rows(df):
    return sorted(rows_of(df))


def test_spans_of_whole_texts_equal_those_of_pieces(spark):
    r = random.Random(1)
    odd = [None, "", " ", "\n", "\n\n  \n a", "a\t\x0b b\r\nc", "ünï çödé 日本語 x " + "é" * 11 + " " + "b" * 7 + " " + "c" * 28, "w\n" * 200]
    odd += ["".join(r.choice(["a", "é", "日", "𝒳", " ", " ", "\n", "\t", "abcdefg", "hijklmnopqr"]) for _ in range(r.randrange(1, 600))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    want = spans_op.build_spans(derive.pieces(docs)).drop("fragments")
    got = typeset.spans(docs)
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert rows(typeset.letters(docs)) == [(c,) for c in sorted(set("".join(t or "" for t in odd)) - {"\n"})]


def test_widths_told_text_by_text_equal_a_join(spark, monkeypatch):
    r = random.Random(2)
    some = ["a", "b", "é", "日", "𝒳", " ", " "]
    texts = [(i, r.choice(["F0", "F1", "none", None]), r.choice(["F0", "F1"]), r.choice([9.0, 12.0]), r.choice([0.0, 0.5]), r.choice([None, "", "".join(r.choice(some) for _ in range(r.randrange(20)))])) for i in range(300)]
    t = spark.createDataFrame(texts, "doc_id long, font string, face string, size double, spacing double, text string")
    table = [("F0", "a", 400.0), ("F0", "é", 512.5), ("F0", "𝒳", 700.0), ("F0", " ", 300.0), ("F1", "a", 410.0), ("F1", "b", 0.0), ("F1", "日", 1000.0)]
    widths = spark.createDataFrame(table, "font_key string, letter string, width double")
    box = F.struct(F.lit(0.0).alias("x0"), (F.col("doc_id") % 7 * 10.0).alias("x1"))
    pieces_ = t.select((F.col("doc_id") % 3).alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line_no"), F.col("doc_id").cast("int").alias("piece_no"), F.coalesce("font", F.lit("F0")).alias("font"), "size", "text", box.alias("bbox"))
    space = spark.createDataFrame([("F0", 0.25), ("F1", 0.3)], "font string, space double")
    asked = [
        lambda: typography.line_width(t, widths, ["doc_id"]),
        lambda: typography.usual_gap(pieces_, widths, space),
        lambda: typography.missing_letters(t, widths, ["doc_id"]),
        lambda: typography.substitute_width_delta(t.where("font is not null"), widths, ["doc_id"]),
    ]
    near = [sorted(map(repr, ask().collect())) for ask in asked]
    monkeypatch.setattr(typography, "MOST_WIDTHS", 0)
    assert near == [sorted(map(repr, ask().collect())) for ask in asked] and min(map(len, near)) > 5


@pytest.mark.parametrize("name", ["room", "line_widths", "missing_letters", "width_changes", "replaced_texts", "art_near_text"])
def test_told_without_a_shuffle(spark, monkeypatch, name):
    monkeypatch.setattr(typeset, "FEW_BYTES", 0)
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" not in plan


def test_rooms_and_art_of_whole_texts_equal_those_of_tables(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(r.choice(["a", "bb", "sevensix", " ", " ", "\n", "elevenlette", "fourteenletter"]) for _ in range(r.randrange(500)))) for i in range(12)] + [(99, None)], "doc_id long, text string")
    spans, art = spans_op.build_spans(derive.pieces(docs)), derive.art(docs)
    assert rows(typeset.rooms(docs)) == rows(layout.room(spans, art))
    near = layout.art_near_text(art, spans).select("doc_id", F.col("page").cast("long").alias("page"), "bbox.x0", "bbox.y0", "tall")
    assert rows(typeset.art_near_text(docs)) == rows(near) and near.count() > 12


def test_art_near_text_equals_a_full_scan(spark):
    r = random.Random(4)
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    spans = [(d, p, k, (0.0, (y := float(r.randrange(300))), 9.0, y + r.choice([9.0, 12.0])), r.random() < 0.3) for d in range(3) for p in range(2) for k in range(5)]
    art = [(d, p, (1.0, (y := float(r.randrange(300))), 2.0, y + r.choice([1.0, 5.0, 60.0]))) for d in range(4) for p in range(2) for _ in range(20)]
    art += art[:5]
    want = []
    for d, p, a in art:
        level = [s[3] for s in spans if s[:2] == (d, p) and not s[4]]
        if any(min(a[3], s[3]) - max(a[1], s[1]) > 0.1 for s in level):
            want.append((d, p, a[1], a[3] - a[1] > 4 * max(s[3] - s[1] for s in level)))
    got = layout.art_near_text(spark.createDataFrame(art, f"doc_id long, page int, bbox {box}"), spark.createDataFrame(spans, f"doc_id long, page int, ordinal long, bbox {box}, turned boolean"))
    assert rows(got.select("doc_id", "page", "bbox.y0", "tall")) == sorted(want)


def test_values_of_fields_meet_only_spans_in_them(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    fields = spark.createDataFrame([(1, 0, (10.0, 10.0, 50.0, 40.0), "one  two"), (1, 0, (100.0, 10.0, 150.0, 40.0), "three")], f"doc_id long, page int, bbox {box}, value string")
    texts = [("two", 20.0), ("one two", 20.0), ("three", 20.0), ("three", 120.0), ("one", 300.0), ("e\tt", 30.0)]
    spans = spark.createDataFrame([(1, 0, i, (x, 12.0, x + 4, 24.0), t) for i, (t, x) in enumerate(texts)], f"doc_id long, page int, ordinal long, bbox {box}, text string")
    got = layout.spans_in_fields(spans, fields)
    assert rows(got) == [(1, 0), (1, 1), (1, 3), (1, 5)]
    # the value is not among what the boxes are joined with
    plan = registry.QUERIES["spans_in_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "x0" in joined and all("value" not in line for line in joined.splitlines() if "explode(" in line)


def test_counted_places_do_not_carry_their_texts(spark):
    plan = registry.QUERIES["find_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftAnti" in line)
    assert "AS _n#" in plan[at + 1] and not re.search(r"[\[ ](text|matches)#\d+[,\]]", plan[at + 1])


def test_fits_join_once(spark):
    plan = registry.QUERIES["fits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_page_operations_equal_a_fold_a_document(spark):
    r = random.Random(5)
    docs = [(i, r.randrange(1, 6)) for i in range(40)]
    ops = [(r.randrange(45), k, r.choice(["rotate", "delete_page", "move_page", "replace"]), r.choice([None, 0, 1, 2, 3, 7]), 90, r.choice([None, 0, 1, 2])) for k in range(400)]
    got = edits.fold_page_ops(spark.createDataFrame(ops, "doc_id long, position int, kind string, page int, degrees int, before int"), spark.createDataFrame(docs, "doc_id long, pages int"))
    want = []
    for d, n in docs:
        order, turns = list(range(n)), [0] * n
        for _, _, kind, page, degrees, before in (o for o in ops if o[0] == d and o[3] in order):
            if page not in order:
                continue
            if kind == "rotate":
                turns[page] = (turns[page] + degrees) % 360
            elif kind == "delete_page" and len(order) > 1:
                order.remove(page)
            elif kind == "move_page" and before != page and (before is None or before in order):
                order.remove(page)
                order.insert(len(order) if before is None else order.index(before), page)
        want += [(d, p, turns[p], order.index(p) if p in order else None) for p in range(n)]
    assert sorted(map(str, rows_of(got))) == sorted(map(str, want))
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()

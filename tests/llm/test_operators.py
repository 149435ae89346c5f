"""The operators against brute force and on awkward rows: nulls, empty, very long, ties, repeats, no rows, extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import shutil
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.llm import decontamination, line_dedup, near_dup, packing, pii, rules, scoring, sharding, token_counts, toxicity
from foliomill.llm.common import crc_bucket
from foliomill.llm.components import components
from foliomill.llm.common import Workspace
from foliomill.llm.elias_fano import EliasFano, Trie

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def words(n, seed=0, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one", "de", "a", 3),
        (5, words(30_000), "en", "b", 1),
        (6, words(60, 1), "en", "b", 1),
        (7, words(60, 1), "en", "b", 1),
        (7, words(60, 1), "en", "b", 1),
        (None, words(60, 2), "en", "b", 1),
        (None, None, None, None, None),
        (8, "é ß\U0001f600 <|endoftext|> \x01 á", "fr", "c", 1),
        (9, "9" * 30_000, "en", "c", 1),
        (10, "x@" * 5000 + "a.b" * 5000, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, KIND).withColumn("score", F.lit("taken")).withColumn("slot", F.lit(1)).withColumn("shard", F.lit("x"))


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)


def test_elias_fano_look_ups():
    r = np.random.default_rng(1)
    for top, n in ((10, 5), (1000, 3000), (1 << 50, 2000), (70, 0)):
        values = np.sort(r.integers(0, top, n).astype(np.uint64))
        e = EliasFano.of(values)
        assert (e.access(np.arange(n)) == values).all()
        asked = np.concatenate([values, r.integers(0, top, 500).astype(np.uint64), np.array([0, top, top * 2], np.uint64)])
        zero = np.zeros(len(asked), np.int64)
        assert (e.successor(asked, zero, zero + n) == np.searchsorted(values, asked)).all()
        if n:
            first = r.integers(0, n, len(asked))
            last = np.minimum(first + r.integers(0, 40, len(asked)), n)
            assert (e.successor(asked, first, last) == np.clip(np.searchsorted(values, asked), first, last)).all()


def test_trie_finds_exactly_its_ngrams():
    r = np.random.default_rng(2)
    keys = np.unique((r.integers(0, 50, 400).astype(np.uint64) << np.uint64(32)) | r.integers(0, 50, 400).astype(np.uint64))
    tri = np.unique((r.integers(0, len(keys), 600).astype(np.uint64) << np.uint64(32)) | r.integers(0, 50, 600).astype(np.uint64))
    context, third = (tri >> np.uint64(32)).astype(np.int64), tri & np.uint64(0xFFFFFFFF)
    t = Trie.mapped(Trie.build(keys, np.ones(len(keys)), context, third, np.ones(len(tri)), np.full(len(keys), 9.0), 4.0).to_bytes())
    u, v = np.meshgrid(np.arange(60), np.arange(60))
    u, v = u.ravel().astype(np.uint64), v.ravel().astype(np.uint64)
    at = {int(k): i for i, k in enumerate(keys)}
    want = np.array([at.get((int(a) << 32) | int(b), -1) for a, b in zip(u, v)])
    assert (t.bigram(u, v) == want).all()
    c, w = np.meshgrid(np.arange(len(keys)), np.arange(60))
    at3 = {int(k): i for i, k in enumerate(tri)}
    want3 = np.array([at3.get((int(a) << 32) | int(b), -1) for a, b in zip(c.ravel(), w.ravel())])
    assert (t.trigram(c.ravel(), w.ravel().astype(np.uint64)) == want3).all()


def lm(docs, held):
    """Counts and scores by dictionaries."""
    tokens = [re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in docs]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            s = ["\0", *w, "\0"]
            c1.update(s[1:])
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    n, v, out = sum(c1.values()), len(c1), []
    for w in tokens:
        s = ["\0", *w, "\0"]
        p1 = [(c1[a] + 0.1) / (n + 0.1 * (v + 1)) for a in s[1:]]
        total = 0.0
        for j, p in enumerate(p1, 1):
            p = (c2[s[j - 1], s[j]] + 4 * p) / (c1[s[j - 1]] + 4)
            if j > 1:
                p = (c3[s[j - 2], s[j - 1], s[j]] + 4 * p) / (c2[s[j - 2], s[j - 1]] + 4)
            total += math.log10(p)
        out.append((len(p1), sum(c1[a] > 0 for a in s[1:]), n, sum(map(math.log10, p1)), total))
    return out


@pytest.mark.parametrize("hot", [None, 30])
def test_scores_equal_brute_force(spark, odd, monkeypatch, hot):
    if hot:  # many small shards, and words spread over them
        monkeypatch.setattr(scoring, "SHARD_TOKENS", 8 * hot)
        monkeypatch.setattr(scoring, "BUCKET_WORDS", 50)
    docs = spark.createDataFrame([(i, words(random.Random(i).randrange(60), i, 30)) for i in range(80)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scoring.score_texts(docs, crc_bucket(F.col("doc_id"), 10) == 0).collect())
    rows = docs.collect()
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0 for r in rows]
    want = sorted((r.doc_id or -1, *x) for r, x in zip(rows, lm([r.text for r in rows], held), strict=True))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert abs(g[5] - w[5]) <= 0.06 * w[1]  # probabilities are quantised


def test_unknown_words_after_frequent_bigrams(spark):
    docs = [(i, "a b " * 200 + "c") for i in range(20)] + [(100, "a b new a b newer"), (101, "new"), (102, "a b"), (103, "b new newer a b newest a")]
    held = [i >= 100 for i, _ in docs]
    got = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in scoring.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    for (i, _), (n, known, _, _, want) in zip(docs, lm([t for _, t in docs], held), strict=True):
        assert got[i][:2] == (n, known)
        assert abs(got[i][2] - want) <= 0.06 * n


def test_scores_of_no_rows_and_no_training(spark, none):
    assert scoring.score_texts(none, F.lit(False)).count() == 0
    got = scoring.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def shards_of(got):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return by


@pytest.mark.parametrize("cells", [4, 64, 1 << 16])
def test_shards_are_minimax(spark, cells):
    r = random.Random(cells)
    docs = [(i, f"text {r.randrange(150)}" * r.choice([1, 2, 5, 60])) for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=7, max_cells=cells).collect()
    place = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)
    group = Counter()
    for _, t in docs:
        group[place(t)] += len(t.encode()) + 16
    sizes = [s for _, s in sorted(group.items())]

    def fits(c):
        n, run = 1, 0
        for s in sizes:
            if s > c:
                return False
            if run + s > c:
                n, run = n + 1, 0
            run += s
        return n <= 7

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    by = shards_of(got)
    assert max(sum(r.size for r in rs) for rs in by.values()) == best
    text = dict(docs)
    homes = defaultdict(set)
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_follow_the_mean():
    r = random.Random(11)
    for _ in range(300):
        sizes = [r.choice([1, 5, 17, 40, r.choice([40, 900])]) for _ in range(r.randrange(1, 120))]
        ends, shards = list(np.cumsum(sizes).tolist()), r.randrange(1, 15)
        capacity = sharding.least(ends, shards)
        closed = sharding.balanced(ends, capacity, shards)
        got = np.diff(closed, prepend=0)
        assert closed[-1] == ends[-1] and set(closed) <= set(ends) and got.min() > 0
        assert got.max() <= capacity and len(got) == min(shards, len(sizes))
    even = np.diff(sharding.balanced(list(range(10, 10_001, 10)), 260, 40), prepend=0)
    assert even.min() >= 240 and even.max() <= 260
    hot = sharding.balanced([*range(10, 3001, 10), 63_000, *range(63_010, 66_001, 10)], 60_000, 40)
    others = sorted(np.diff(hot, prepend=0).tolist())[:-1]
    assert len(others) == 39 and others[0] >= 100 and others[-1] <= 170


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard_documents(odd, shards=3).collect()
    assert len(got) == odd.count()
    shards_of(got)
    assert len({r.shard for r in got if r.size == 16 and r.text_crc32 == 0}) <= 2  # null and empty texts are two groups
    assert sharding.shard_documents(none).count() == 0


def test_passages_go_from_all_but_the_first(spark):
    passage = words(55, 5)
    lines = [words(12, 50 + i) for i in range(6)]
    multi = "\n".join(words(15, 90 + i) for i in range(12))
    docs = [(1, "\n".join([words(20, 1), passage, words(20, 2)])), (2, "\n".join([words(20, 3), passage, words(20, 4)])), (3, "\n".join(["head", *lines])), (4, "\n".join(["head", words(30, 9)])), (5, words(9, 70) + "\n" + multi), (6, multi + "\n" + words(9, 71))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage in got[1].text and passage not in got[2].text
    assert got[2].text == "\n".join([words(20, 3), words(20, 4)])
    assert got[3].text == docs[2][1] and got[4].text == docs[3][1]
    assert got[5].text == docs[4][1] and len(got[6].text) < len(docs[5][1]) / 2


def test_passages_of_short_lines_go_whole(spark):
    r, docs, want = random.Random(4), [], {}
    for k, (n, m) in enumerate((n, m) for n in range(2, 21) for m in (3, 8, 15, 30) if n * m >= 50):
        passage = [words(m, 1000 * k + i, 10**6) for i in range(n)]
        a, b, c, d = ([words(r.randrange(1, 40), r.random(), 10**6) for _ in range(r.randrange(4))] for _ in range(4))
        docs += [(2 * k, "\n".join([*a, *passage, *b])), (2 * k + 1, "\n".join([*c, *passage, *d]))]
        want |= {2 * k: docs[-2][1], 2 * k + 1: "\n".join([*c, *d])}
    row, short = words(9, 1), "\n".join(words(7, i) for i in range(7))
    docs += [(900, "\n".join(["x", *[row] * 40, "y"])), (901, "a\n" + short + "\nb"), (902, "c\n" + short + "\nd")]
    want |= {900: "\n".join(["x", *[row] * 6, "y"]), 901: docs[-2][1], 902: docs[-1][1]}
    blank = [words(20, 80 + i) for i in range(4)]
    docs += [(910, "\n\n".join(blank)), (911, "p\n" + "\n\n".join(blank) + "\nq")]
    want |= {910: docs[-2][1], 911: "p\nq"}
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def lines_brute(docs, least=50):
    """Texts without the lines of repeated windows: from each line with words as few lines as have ``least`` words, and as few that end with it; the first place of equal ones stays."""
    found = defaultdict(set)
    for d, t in docs.items():
        lines = t.split("\n")
        held = [i for i, x in enumerate(lines) if x.split()]
        for rank, i in enumerate(held):
            for run in (held[rank:], held[rank::-1]):
                n = 0
                for j in run:
                    n += len(lines[j].split())
                    if n >= least:
                        a, b = min(i, j), max(i, j)
                        found["\n".join(lines[a : b + 1])].add((d, a, b))
                        break
    gone = defaultdict(set)
    for places in found.values():
        first = min(places)
        for d, a, b in places - {first}:
            gone[d] |= set(range(max(a, first[2] - first[1] + first[1] + 1) if d == first[0] else a, b + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def test_chunks_find_every_repeat(spark):
    """Overlapping, nested and three-fold repeats, at any place, blank lines between."""
    r, docs = random.Random(12), {}
    stock = [words(r.choice([1, 2, 5, 9, 17, 30, 52]), i, 10**6) for i in range(160)]
    for d in range(70):
        lines = []
        for _ in range(r.randrange(1, 5)):
            at, n = r.randrange(len(stock)), r.randrange(1, 14)
            lines += r.choice([stock[at : at + n], stock[at : at + n], [words(r.randrange(1, 25), r.random(), 10**6) for _ in range(n)], ["", " "], [stock[at]] * n])
        docs[d] = "\n".join(lines)
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == lines_brute(docs) and sum(got[d] != docs[d] for d in docs) > 30


def test_equal_passages_have_equal_chunks(spark):
    r = random.Random(13)
    rows = []
    for k in range(60):
        passage = []
        while sum(map(len, map(str.split, passage))) < 50:
            passage.append(words(r.choice([1, 2, 7, 20, 49]), r.random(), 10**6))
        for side in range(2):
            before, after = ([words(r.randrange(1, 40), r.random(), 10**6) for _ in range(r.randrange(6))] for _ in range(2))
            rows.append((k, side, "\n".join([*before, *passage, *after])))
    df = line_dedup.chunks(spark.createDataFrame(rows, "k long, side int, text string").select("k", "side", F.split("text", "\n", -1).alias("lines")))
    assert df.groupBy("k", "key").agg(F.count_distinct("side").alias("n")).where("n = 2").select("k").distinct().count() == 60


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, words(60, 1)), (2, words(60, 1))], "doc_id long, text string")
    odd = docs.withColumns({c: F.lit(c) for c in ("_lines", "_id", "_n", "_out", "_hash", "_text", "gone", "marks", "w", "key")})
    got = line_dedup.dedup_lines(odd)
    assert {r.text for r in got.collect()} == {words(60, 1), ""} and got.select(*odd.columns).where("_lines = '_lines' and _n = '_n' and _out = '_out' and gone = 'gone'").count() == 2


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert (1, None) in kept and (2, "") in kept and (7, "") in kept and (6, words(60, 1)) in kept
    assert line_dedup.dedup_lines(none).count() == 0


def windows_brute(text, item):
    w, v = text.lower().split(), item.lower().split()
    n = min(len(v), len(w))
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(max(0, len(x) - 4)))
    b, best = grams(v), 0.0
    for s in range(max(0, len(w) - n) + 1):
        a = grams(w[s : s + n])
        top = sum(max(a[k], b[k]) * len(set(k)) for k in a | b)
        best = max(best, sum(min(a[k], b[k]) * len(set(k)) for k in a & b) / top if top else 0.0)
    return best


def test_leaks_equal_brute_force(spark):
    items = [(i, words(random.Random(i).randrange(12, 50), 1000 + i, 10_000)) for i in range(12)]
    docs = []
    for i in range(60):
        r = random.Random(i)
        t = words(r.randrange(5, 150), 2000 + i, 10_000).split()
        if i % 3:
            v = items[i % 12][1].split()
            for _ in range(i % 4):
                v[r.randrange(len(v))] = "changed"
            at = r.randrange(len(t))
            t[at:at] = v if i % 5 else v[: len(v) // 2]
        docs.append((i, " ".join(t)))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_items=5).collect()}
    want = {(d, i): s for d, t in docs for i, v in items if (s := windows_brute(t, v)) >= 0.8}
    assert want and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("portion", [64, 1 << 14])
def test_leaks_of_long_texts_in_portions(spark, monkeypatch, portion):
    monkeypatch.setattr(decontamination, "STARTS", portion)
    items = [(i, words(30 + i, 500 + i, 10_000)) for i in range(4)]
    docs = [(k, " ".join([items[k % 4][1], words(n, k, 10_000), items[(k + 1) % 4][1]])) for k, n in enumerate([0, 33, 63, 64, 65, 200, 5000])] + [(50, " ".join(items[i % 4][1] for i in range(40)))]
    got = {(r.doc_id, r.item_id): (r.word_start, r.n_words, r.similarity) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(d, i) for d, t in docs for i, v in items if windows_brute(t, v) >= 0.8}
    assert all(s == 1.0 for _, _, s in got.values())


def test_peak_memory_of_long_texts(spark):
    item = words(40, 1, 10_000)
    index = decontamination.ItemIndex([(1, item)], 8, 19)
    batch = pa.RecordBatch.from_arrays([pa.array([item + " " + words(400_000, 2, 10_000) + " " + item])], names=["text"])
    tracemalloc.start()
    found = list(decontamination._scan(batch, index, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1 and peak < 120 << 20


def test_leaks_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, words(60, 1)), (5, words(60, 1))], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(odd, items).collect())
    assert got == Counter({(4, 3): 1, (6, None): 1, (6, 5): 1, (7, None): 2, (7, 5): 2})
    clean = decontamination.without_leaks(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4
    assert decontamination.find_leaks(none, items).count() == 0 and decontamination.find_leaks(odd, items.limit(0)).count() == 0


def test_toxicity_learns_invented_insults(spark, odd, none):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        w = [f"w{r.randrange(300)}" for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["grobnik", "grobnar", "grobnuff"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab, trees=8)
    got = {x.doc_id: x.score for x in toxicity.score(d, model).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) / len(held) > 0.97
    strange = toxicity.score(odd.drop("score"), model).collect()
    assert len(strange) == odd.count() and all(0 <= x.score <= 1 for x in strange)
    assert toxicity.score(none.drop("score"), model).count() == 0
    one = toxicity.score(d.limit(3), toxicity.fit(d, lab.where("toxic = 0"))).collect()
    assert [x.score for x in one] == [0.0] * 3
    assert toxicity.fit(d, lab.limit(0)).rate == 0.0


def toxicity_brute(t, strong, weak):
    """The features of one text, word by word."""
    t = t or ""
    kind = lambda c: "U" if unicodedata.category(c) == "Lu" else "L" if c.isalpha() else c
    held = lambda w, lexicon: bool({f"={w}", w[:4], w[:6]} & set(lexicon))

    def plain(w):
        at = [i for i, c in enumerate(w.lower()) if c.isalpha() or c in "0123456789"]
        return w.lower()[at[0] : at[-1] + 1] if at else ""

    def is_masked(w):
        k = "".join(kind(c) for c in w).replace("U", "L")
        return bool(re.search("L[^L'’-]+L", k)) and not re.search("[@/]|L{3,}[.,;:]L", k)

    raw = re.findall(SPACE, t)
    forms, kinds, masked = [plain(w) for w in raw], [kind(c) for c in t], [w for w in raw if is_masked(w)]
    at = [i for i, w in enumerate(forms) if held(w, strong)]
    n, chars, letters = max(1, len(raw)), max(1, len(t)), max(1, sum(k in "UL" for k in kinds))
    return {
        "strong": len(at) / n,
        "weak": sum(held(w, weak) for w in forms) / n,
        "strong_log": math.log1p(len(at)),
        "near_person": sum(any(w in toxicity.SECOND_PERSON for w in forms[max(i - 3, 0) : max(i - 3, 0) + 7]) for i in at) / n,
        "hidden_hits": sum(held("".join(c for c in w.lower().translate(str.maketrans("013457@$!|", "oieastasil")) if c.isalpha()), strong) for w in masked) / n,
        "capitals": kinds.count("U") / letters,
        "shouted": sum(bool(re.fullmatch("U{3,}[^UL]*", "".join(kind(c) for c in w))) for w in raw) / n,
        "exclaims": t.count("!") / chars,
        "questions": t.count("?") / chars,
        "punctuation": sum(c in "#*$%&|<>.,;:-_~^" for c in t) / chars,
        "obfuscated": len(masked) / n,
        "words_log": math.log1p(len(raw)),
    }


def test_toxicity_features_against_plain_python(spark, odd):
    r = random.Random(8)
    told = ["you", "YOU!", "tú", "idiot", "IDIOT", "Idiots,", "1d1ot", "id.iot", "i*d*i*o*t", "m0r0n", "mo-r0n", "d'accord", "TRASH!!!", "ÄÖÜ.", "gr@bnik", "x@y.z", "here.then", "...", "=", "\x85end\x85"]
    parts = list("aAbBéÉßİΣς0134579@$!|.,;:-_~^#*%&<>?/'’") + ["\u2028", "\xa0", "\U0001f600", "中", "ǅ", "\u0301"]
    rows = []
    for i in range(400):
        ws = [r.choice(told) if r.random() < 0.4 else "".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(25))]
        rows.append((100 + i, "".join(w + r.choice([" ", "  ", "\n", "\t", "\x0b", " \x1c "]) for w in ws)))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    strong, weak = ["=idiot", "=moron", "grab", "fooled"], ["=trash", "tras", "=you"]
    seen = Counter()
    for x in toxicity.with_features(docs, strong, weak).collect():
        want = toxicity_brute(x.text, strong, weak)
        assert {k: x[k] for k in toxicity.FEATURES} == pytest.approx(want, abs=1e-12), x.text[:200]
        seen.update(k for k, v in want.items() if v)
    assert set(seen) == set(toxicity.FEATURES)
    broken = spark.sql("select cast(x'61ff6220696469c3' as string) text")
    assert toxicity.with_features(broken, strong, weak).collect()[0].words_log == math.log1p(2)


def test_toxicity_looks_at_distinct_words_only(spark, monkeypatch):
    plan = toxicity.with_features(spark.createDataFrame([("a b",)], "text string"), ["=a"], [])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.lower() and plan.count("run(") == 1
    asked, facts = [], toxicity.word_facts
    monkeypatch.setattr(toxicity, "word_facts", lambda words, *lexica: asked.append(len(words)) or facts(words, *lexica))
    got = toxicity.text_counts(pa.array(["you idiot " * 500, None, "idiot"] * 300), ["=idiot"], []).to_pylist()
    assert asked == [2]
    assert [(x["words"], x["strong"], x["near"]) for x in got] == [(1000, 500, 500), (0, 0, 0), (1, 1, 0)] * 300
    assert not toxicity.text_counts(pa.array([], pa.string()), [], []).to_pylist()


def rules_brute(t):
    t = t or ""
    w = re.findall(SPACE, t)
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, odd, none):
    docs = [(100 + i, words(random.Random(i).randrange(80), i, 4) + "\n" * (i % 3) + "a b\na b\n \n#x$ <y>", "en") for i in range(60)]
    both = spark.createDataFrame(docs, "doc_id long, text string, lang string").unionByName(odd.select("doc_id", "text", "lang"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judge(both).collect())
    assert got == Counter((r.doc_id, *rules_brute(r.text)) for r in both.collect())
    assert rules.judge(none).count() == 0


def distances_brute(rows, rule):
    """(kept, character distance, word distance) of rows (text, lang), by dictionaries."""

    def classes(t):
        out = dict.fromkeys(rules.CLASSES, 0)
        for c in t:
            if c in " \t\n\x0b\x0c\r":
                k = "space"
            elif unicodedata.category(c) == "Lu":
                k = "upper"
            elif c in "0123456789":
                k = "digit"
            elif c in ".,;:!?'\"()-":
                k = "stop"
            elif c in "#*$%&|<>":
                k = "symbol"
            elif ord(c) < 128 and not c.isalpha():
                k = "sign"
            else:
                k = "lower" if unicodedata.category(c)[0] == "L" else "rest"
            out[k] += 1
        return list(out.values())

    def commons(t, listed):
        w = re.findall(SPACE, t)
        forms = {f: f.lower().strip('.,;:!?"()') for f in rules.common_forms(rule.common)}
        seen = Counter(forms[x] for x in w if x in forms and forms[x] in listed)
        return [*(seen[x] for x in listed), len(w) - seen.total()]

    def distance(a, b):
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        half = lambda u, v: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(u, v) if x)
        return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    told = []
    for t, lang in rows:
        n, _, _, _, again = rules_brute(t)
        told.append((lang, n, n < 10 or 100 * again > 20 * n, classes(t or ""), commons(t or "", rule.common[lang]) if lang in rule.common else None, len(t or "")))
    total = lambda lang, k: [sum(x) for x in zip(*(d[k] for d in told if d[0] == lang and not d[2]))]
    out = []
    for lang, n, failed, chars, words_, size in told:
        long = n >= rule.min_words and size >= rule.min_chars and total(lang, 3)
        a = distance(chars, total(lang, 3)) if long else None
        b = distance(words_, total(lang, 4)) if long and words_ else None
        near = True
        if b is not None:
            ref = total(lang, 4)
            none, bins = distance([0] * (len(ref) - 1) + [1], ref), sum(x > 0 for x in ref[:-1])
            near = b <= min(math.sqrt((rule.max_word_share * none) ** 2 + rule.noise * bins / (8 * math.log(2) * n)), 0.97 * none)
        out.append((not failed and near and (a is None or a <= rule.max_char_distance), a, b))
    return out


def test_distances_equal_brute_force(spark, odd):
    r = random.Random(6)
    made = lambda: "".join(r.choice("abcdeéüABÖ09.;-_/[]{}~^\\@#$µ“") for _ in range(r.randrange(1, 8)))
    rows = []
    for i in range(120):
        lang = r.choice(["en", "de", "fr", None, "xx"])
        listed = rules.COMMON_WORDS.get(lang, ["the"])
        form = lambda w: r.choice([w, w.capitalize(), w.upper(), f'"{w}', f"({w}", f"{w},", f'{w}"'])
        rows.append((i, " ".join(form(r.choice(listed)) if r.random() < r.choice([0.05, 0.3]) else made() for _ in range(r.randrange(5, 160))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(odd.select("doc_id", "text", "lang").where("doc_id > 4 and doc_id not in (7, 9)"))
    all_rows = docs.collect()
    want = {x.doc_id: w for x, w in zip(all_rows, distances_brute([(x.text, x.lang) for x in all_rows], rules.DivergenceRule()), strict=True)}
    got = {x.doc_id: (x.kept, x.char_distance, x.word_distance) for x in rules.judge(docs).collect()}
    assert got.keys() == want.keys() and len({w[0] for w in want.values()}) == 2
    for k, (kept, *far) in want.items():
        assert got[k][0] == kept and all(a == b if b is None else a == pytest.approx(b, abs=1e-7) for a, b in zip(got[k][1:], far, strict=True)), (k, got[k], kept, far)


def test_rules_drop_only_the_strange(spark):
    r = random.Random(8)
    listed = "the of and to cat runs house tree over under Then it, was. river stone bread light".split()
    plain = [(i, " ".join(r.choice(listed) for _ in range(120)), "en") for i in range(40)]
    odd = [(100, "ZXQ!! " * 1 + " ".join(f"{chr(65 + i % 26)}Q{i}!!" for i in range(120)), "en")]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(100) and all(got.values())


def test_rules_drop_wrong_languages_and_salad(spark):
    r = random.Random(9)
    made = lambda n: ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    rest = made(500)
    text = lambda lang, n: " ".join(r.choice(rules.COMMON_WORDS[lang]) if lang and r.random() < 0.27 else r.choice(rest) for _ in range(n))
    size = lambda: r.choice([60, 100, 300, 900])
    clean = [(i, text(lang, size()), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 75)]
    salad = [(1000 + i, text(None, size()), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 2)]
    wrong = [(2000 + i, text(a, 300), b) for i, (a, b) in enumerate((a, b) for a in rules.COMMON_WORDS for b in rules.COMMON_WORDS if a != b)]
    got = {x.doc_id: (x.kept, x.base_failed) for x in rules.judge(spark.createDataFrame(clean + salad + wrong, "doc_id long, text string, lang string")).collect()}
    assert not any(base for _, base in got.values())
    assert {i for i, (kept, _) in got.items() if kept} == {i for i, _, _ in clean}


def test_token_rollup_is_idempotent(spark, tmp_path, odd):
    store = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    make = lambda rows: spark.createDataFrame(rows, token_counts.CHANGES)
    load = make([(1, "v1", "insert", "a", "en", 10, 0), (2, "v1", "insert", "a", "en", 5, 0), (2, "v1", "insert", "a", "en", 6, 1), (3, "v1", "insert", None, None, None, 0), (None, "v1", "insert", "a", "en", 1, 0)])
    assert store.commit("1", load) and not store.commit("1", load)
    assert store.commit("2", make([(1, "v1", "revise", "b", "en", 8, 0), (2, "v1", "delete", None, None, None, 0), (9, "v1", "delete", "a", "en", 3, 0), (4, "v2", "revise", "a", "de", 2, 0)]))
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()}
    assert got == {("b", "en", "v1"): (1, 8), ("a", "en", "v1"): (1, 1), (None, None, "v1"): (1, 0), ("a", "de", "v2"): (1, 2)}
    assert store.commit("3", load.limit(0)) and store.totals().count() == 4
    # a batch that broke off before its marker is written again
    (tmp_path / "r/rollup/2/_SUCCESS").unlink()
    assert store.batches() == ["1", "3"]


def test_token_rollup_counts_the_nameless_and_repeats(spark, tmp_path):
    store = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    make = lambda rows: spark.createDataFrame(rows, token_counts.CHANGES)
    store.commit("1", make([(None, "v", "insert", "a", "en", 5, 0), (None, "v", "insert", "a", "en", 7, 0), (1, "v", "insert", "a", "en", 1, 0), (1, "v", "insert", "a", "en", 1, 0)]))
    store.commit("2", make([(None, "v", "delete", "a", "en", 5, 0), (None, "v", "insert", "a", "en", 2, 0), (1, "v", "revise", "a", "en", 4, 0)]))
    store.commit("3", make([(2, "v", "insert", "b", "en", 9, 0)]))
    store.commit("4", make([(1, "v", "revise", "b", "en", 3, 0), (2, "v", "delete", None, None, None, 0)]))
    assert {(r.source, r.docs, r.tokens) for r in store.totals().collect()} == {("a", 3, 14), ("b", 1, 3)}
    assert [(r.doc_id, r.tokens) for r in store.current().collect()] == [(1, 3)]


def test_token_rollup_compacts(spark, tmp_path):
    store = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    make = lambda rows: spark.createDataFrame(rows, token_counts.CHANGES)
    first, second = [(1, "v", "insert", "a", "en", 5, 0), (2, "v", "insert", "a", None, 7, 0), (None, "v", "insert", "b", "en", 3, 0), (3, "v", "insert", "c", "en", 1, 0)], [(1, "v", "revise", "a", "en", 6, 0), (3, "v", "delete", None, None, None, 0)]
    store.commit("1", make(first))
    store.commit("2", make(second))
    before = sorted(map(str, store.totals(drop_empty=False).collect()))
    assert store.compact("1") and not store.compact("1")
    shutil.rmtree(tmp_path / "r/ledger")  # covered ledgers are not read again
    assert sorted(map(str, store.totals(drop_empty=False).collect())) == before
    assert not store.commit("2", make(second))
    store.commit("3", make([(1, "v", "delete", None, None, None, 0), (2, "v", "revise", "c", "en", 2, 0), (4, "v", "insert", "a", "en", 9, 0)]))
    want = {("b", "en", 1, 3), ("c", "en", 1, 2), ("a", "en", 1, 9)}
    assert {(r.source, r.lang, r.docs, r.tokens) for r in store.totals().collect()} == want
    assert store.compact("2") and {(r.source, r.lang, r.docs, r.tokens) for r in store.totals().collect()} == want
    # a base that broke off before its list is not seen
    (tmp_path / "r/base/2/covers/_SUCCESS").unlink()
    assert {(r.source, r.lang, r.docs, r.tokens) for r in store.totals().collect()} == want and store.compact("2")
    assert sorted((r.doc_id, r.tokens) for r in store.current().collect()) == [(2, 2), (4, 9)]


def test_real_tokenizers_count_as_a_version(spark, odd):
    from tokenizers import Tokenizer

    raw = packing.default_tokenizer()
    t = Tokenizer.from_str(raw)
    got = Counter((r.doc_id, r.tokens) for r in token_counts.tokenizer_counts(odd, raw).collect())
    assert got == Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    raw = packing.default_tokenizer()
    t = Tokenizer.from_str(raw)
    docs = odd.select("doc_id", "text", "source", F.lit("x").alias("ids")).where("doc_id is not null and doc_id <> 7").unionByName(spark.createDataFrame([(100 + i, words(i * 7, i), f"s{i % 3}", "x") for i in range(60)], "doc_id long, text string, source string, ids string"))
    got = packing.pack(docs, raw, window=256, segment=64).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert len(by) == docs.count()
    for r in docs.collect():
        want = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[r.doc_id], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in pieces) == want.tobytes()
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1]) and all(p.doc_tokens == len(want) for p in pieces)
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces)
    full = [sum(p.length for p in ps) for _, ps in sorted(seq.items())]
    assert set(full[:-1]) <= {256} and full[-1] <= 256
    for ps in seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1])
    assert packing.pack(none, raw).count() == 0
    assert packing.pack(odd, raw, with_ids=False).groupBy("doc_id").count().count() == odd.select("doc_id").distinct().count()


def test_packing_keeps_the_mixture(spark):
    docs = spark.createDataFrame([(i, words(200, i), "big" if i % 4 else "small") for i in range(200)], "doc_id long, text string, source string")
    got = packing.pack(docs, packing.default_tokenizer(), window=1024, segment=128).join(docs.select("doc_id", "source"), "doc_id")
    per = got.groupBy("sequence_id").pivot("source").sum("length").orderBy("sequence_id").collect()[:-1]
    big, small = np.cumsum([r.big or 0 for r in per]), np.cumsum([r.small or 0 for r in per])
    assert (np.abs(small - (big + small) * 0.25) <= 300).all()


@pytest.mark.parametrize("shares", [None, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 3, "b": 1}, {"a": 0.5, "b": 0.5, "c": 0.0}, {"nobody": 1.0}, {"a": 0.0}])
def test_schedule_equals_a_walked_round_robin(spark, monkeypatch, shares):
    monkeypatch.setattr(packing, "BUCKET_SEGMENTS", 16)
    monkeypatch.setattr(packing, "ROUNDS_A_BLOCK", 3)
    r = random.Random(2)
    rows = [(uid, 8 * k, r.choice([8, 8, 3]), source) for uid in range(90) for source in [r.choice("aaabcd")] for k in range(r.randrange(1, 4))]
    at = {(x.uid, x.start): x.at for x in packing.schedule(spark.createDataFrame(rows, "uid long, start long, length int, source string"), 64, shares).collect()}
    stream = sorted(rows, key=lambda x: at[x[:2]])
    assert [at[x[:2]] for x in stream] == list(np.cumsum([0] + [x[2] for x in stream])[:-1])
    queues, held = defaultdict(list), Counter()
    for x in stream:
        queues[x[3]].append(x)
        held[x[3]] += x[2]
    named = {k: Fraction(v) / sum(Fraction(x) for x in shares.values()) for k, v in (shares or {}).items() if v}
    want = []
    for group in ([s for s in queues if s in named], [s for s in queues if s not in named]):
        deficit = dict.fromkeys(sorted(group), Fraction(0))
        while any(queues[s] for s in group):
            for s in deficit:
                deficit[s] += 64 * named.get(s, Fraction(held[s], sum(held.values())))
                while queues[s] and queues[s][0][2] <= deficit[s]:
                    deficit[s] -= queues[s][0][2]
                    want.append(queues[s].pop(0))
    assert [x[3] for x in stream] == [x[3] for x in want] and stream == want


def test_words_are_encoded_as_within_their_texts():
    from tokenizers import Tokenizer

    raw = packing.default_tokenizer()
    t, encoder = Tokenizer.from_str(raw), packing.WordEncoder(raw, limit=300)
    r = random.Random(3)
    parts = ["haus", "Haus", "é", "e\u0301", "it's", "'s", "x.'s", "...", ".", '!")', "9", "12.5", "a.b,", "ß!", "ﬁn.", "\u0130.", "_", "#tag;", "ab\u0301.", "<|endoftext|>", "中文。", "\x01", "İ"]
    for _ in range(30):
        texts = [" ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(40)) for _ in range(5)]
        ids, counts = packing.encode_texts(pa.array(texts), encoder)
        assert np.split(ids, np.cumsum(counts))[:-1] and [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_whole_text_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    raw = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    t = Tokenizer.from_str(raw)
    docs = spark.createDataFrame([(1, "Hello  World\n"), (2, None)], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.pack(docs, raw, spaced=False, end_id=50256).collect()}
    assert got == {1: [*t.encode("Hello  World\n", add_special_tokens=False).ids, 50256], 2: [50256]}


def links_brute(texts):
    sets = {}
    for t in texts:
        w = tuple((t or "").lower().split())
        sets[w] = {w[i : i + 5] for i in range(len(w) - 4)} or ({w} if w else set())
    keys, links, root = list(sets), Counter(), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return keys, links, find


@pytest.mark.parametrize("block", [8, 512])
def test_near_duplicates_equal_brute_force(spark, odd, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = []
    for g in range(6):
        base = words(60, g, 5000).split()
        for k in range([2, 3, 30, 1, 5, 8][g]):
            r, w = random.Random(k), list(base)
            for _ in range(k % 3):
                w[r.randrange(len(w))] = f"e{r.randrange(9)}"
            rows.append((100 * g + 100 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id is not null"))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect())
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, links, find = links_brute([t for _, t in all_rows])
    key = lambda t: tuple((t or "").lower().split())
    least = {}
    for i, t in all_rows:
        least[find(key(t))] = min(i, least.get(find(key(t)), i))
    assert got == sorted((i, least[find(key(t))], links[key(t)]) for i, t in all_rows)


def test_near_duplicates_without_ids(spark):
    base = words(60, 3, 5000).split()
    rows = [(None, " ".join([*base[: 60 - k % 4], f"x{k % 4}"])) for k in range(40)] + [(7, " ".join(base)), (None, words(50, 9, 5000)), (8, words(40, 10, 5000))]
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 7, 4, 10): 40, (7, 7, 4, 1): 1, (None, None, 0, 1): 1, (8, 8, 0, 1): 1})


def test_one_of_each(spark, odd, none):
    kept = near_dup.one_of_each(odd)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns
    assert ids == Counter({1: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, 10: 1, None: 2})
    assert near_dup.one_of_each(none).count() == 0
    twice = odd.where("doc_id = 6").unionByName(odd.where("doc_id = 6"))
    assert near_dup.one_of_each(twice).count() == 1


def test_bayesian_limits():
    fewest = near_dup.least_matches(0.8, 1e-6)
    assert list(fewest) == [32, 64, 96, 128] and all(0 < m / k < 0.8 for k, m in fewest.items())
    assert fewest[128] / 128 > fewest[32] / 32


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(25)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0


def pii_brute(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data_equals_brute_force(spark, odd, none):
    r = random.Random(5)
    parts = ["a.b@c.co", "x@y", "@", "a@b.co_x@d.e", "+1 (743) 555-3824", "+12", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "é\U0001f600", " ", "-", "GB82 WEST 1234 5698 7654 32", "00012.1.1.255"]
    rows = [(100 + i, "".join(r.choice(parts) + r.choice(["", " ", "x"]) for _ in range(12))) for i in range(150)] + [(99, "7" * 3000 + ".1.1.1"), (98, "a@" + "b." * 3000 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id <> 10 or doc_id is null"))
    base = F.filter("spans", lambda x: x["rank"] < 4)
    got = Counter((x.doc_id, x.s) for x in pii.find_spans(docs).select("doc_id", pii.written(base).alias("s")).collect())
    assert got == Counter((x.doc_id, pii_brute(x.text)) for x in docs.collect())
    assert pii.find_spans(odd).count() == odd.count() and pii.find_spans(none).count() == 0


def test_many_numbers_cost_linear_time(spark):
    numbers = " ".join(str(k) for k in range(200_000))
    cards = " x ".join("4111 1111 1111 1111" for _ in range(10_000))
    docs = spark.createDataFrame([(1, numbers + " +1 (743) 555-3824"), (2, cards), (3, " ".join("1.2.3.4" for _ in range(30_000)))], "doc_id long, text string")
    began = time.monotonic()
    got = {x.doc_id: [(s.kind, s.start) for s in x.spans] for x in pii.find_spans(docs).collect()}
    assert time.monotonic() - began < 60
    assert got[1][-1] == ("phone", len(numbers) + 1) and ("card", 22 * 9_999) in got[2] and len(got[2]) == 10_000
    assert got[3] == [("ip", 8 * k) for k in range(30_000)]


def test_runs_of_digits_are_cards_only_whole(spark):
    r = random.Random(7)
    rows = [(i, "".join(r.choice(["4", "11", " ", "-", "  ", "x", "4111111111111111", "411111111111111"]) for _ in range(r.randrange(1, 30)))) for i in range(400)]
    got = {x.doc_id: x.s for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written(F.filter("spans", lambda x: x["rank"] < 4)).alias("s")).collect()}
    assert got == {i: pii_brute(t) for i, t in rows}


def test_secrets_need_context(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{key}"'), (2, key), (3, f"commit {key}"), (4, f"password {key}{key}" + "a1" * 100), (5, "secret " + "a" * 40)]
    got = {x.doc_id: [(s.kind, s.score) for s in x.spans] for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("secret", 0.7)], 2: [], 3: [], 4: [], 5: []}


def test_iban_needs_its_checksum_and_context(spark):
    rows = [(1, "my bank account GB82 WEST 1234 5698 7654 32 now"), (2, "account GB82WEST12345698765433"), (3, "serial GB82WEST12345698765432"), (4, "GB82WEST12345698765432")]
    got = {x.doc_id: [(s.kind, s.match, s.score) for s in x.spans if s.kind == "iban"] for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("iban", "GB82 WEST 1234 5698 7654 32", 0.9)], 2: [], 3: [], 4: [("iban", "GB82WEST12345698765432", 0.6)]}

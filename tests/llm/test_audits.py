"""Substring dedup, source divergence and filter interaction against SQL and plain Python, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.llm import divergence, filter_audit, substring_dedup
from foliomill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents, with columns of the operators' own names."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one", "de", "a", 3), (5, words(30_000), "en", "b", 1),
        (6, words(60, 1), "en", "b", 1), (7, words(60, 1), "en", "b", 1), (7, words(60, 1), "en", "b", 1), (None, words(60, 2), "en", "b", 1), (9, words(60, 2), "en", "b", 1),
        (None, None, None, None, None), (8, "é ß\U0001f600 <|x|> \x01 á É", "fr", "c", 1), (10, "9" * 30_000, "en", "c", 1), (11, words(30_000), "en", "b", 1), (12, "x y\x00z", "", "", 1),
    ]
    return spark.createDataFrame(rows, KIND).withColumns({c: F.lit("taken") for c in ("batch", "ids", "texts", "bits", "mask", "head", "slot", "n", "part", "p", "block")})


@pytest.mark.parametrize("name", ["op11_divergence", "op12_substring_dedup", "op13_filter_audit"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    answer = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    got = Counter(map(tuple, df.collect()))
    assert len(answer) > 100 and got == Counter(answer)


def cut_brute(docs, size):
    """(words, words that go, kept words joined) of each row; a null id is the smallest."""
    ids = [float("-inf") if i is None else i for i, _ in docs]
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in docs]
    least = {}
    for i, w in zip(ids, split):
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in zip(ids, split):
        gone = {j for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("rule", [substring_dedup.WindowRule(7), substring_dedup.WindowRule(7, batch_bytes=600, bucket_windows=40, task_bytes=2000), substring_dedup.WindowRule(1, batch_bytes=900)])
def test_windows_go_as_by_brute_force(spark, rule):
    r = random.Random(rule.words + rule.batch_bytes)
    stock = [words(40, i, 10**6).split() for i in range(12)]
    docs = []
    for d in range(120):
        w = []
        for _ in range(r.randrange(4)):
            s = r.choice(stock)
            a = r.randrange(len(s))
            w += s[a : a + r.randrange(1, 30)] + [f"x{r.randrange(50)}" for _ in range(r.randrange(6))]
        docs.append((None if d % 40 == 3 else r.randrange(60), r.choice([" ", "\n", " \t "]).join(w)))
    docs += [(5, None), (1, "same " * 30), (2, "same " * 31), (0, "")]
    got = substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), rule).collect()
    want = Counter((i, n, m, kept) for (i, _), (n, m, kept) in zip(docs, cut_brute(docs, rule.words)))
    assert Counter((x.doc_id, x.n_words, sum(s.stop - s.start for s in x.removed), x.kept) for x in got) == want
    for x in got:  # maximal: intervals of a document do not touch
        assert all(a.stop < b.start for a, b in zip(x.removed, x.removed[1:]))


def test_rolling_hashes_tell_runs_apart():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    h = np.concatenate([h, h[100:200], h[::-1]])
    got = substring_dedup.rolling(h, 50, substring_dedup.BASES[0])
    runs = [h[k : k + 50].tobytes() for k in range(len(h) - 49)]
    assert len(got) == len(runs) and len(set(got.tolist())) == len(set(runs)) == len(set(zip(got.tolist(), runs)))
    base = substring_dedup.BASES[0]
    assert int(got[7]) == sum(int(x) * pow(base, 49 - k, 1 << 64) for k, x in enumerate(h[7:57])) % (1 << 64)
    assert len(substring_dedup.rolling(h[:49], 50, base)) == 0


def test_substring_dedup_of_odd_rows(odd):
    got = substring_dedup.without_repeats(odd).collect()
    docs = [(x.doc_id, x.text) for x in odd.collect()]
    assert Counter((x.doc_id, x.n_words, x.kept) for x in got) == Counter((i, n, kept) for (i, _), (n, _, kept) in zip(docs, cut_brute(docs, 50)))
    assert {x.doc_id: x.kept for x in got}[9] == "" and {x.doc_id: x.kept for x in got}[11] == ""
    assert substring_dedup.without_repeats(odd.limit(0)).count() == 0


def audit_brute(docs, rule):
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or "")) for t, _, _ in docs]
    df = Counter((lang or "", w) for (_, lang, _), ws in zip(docs, terms) for w in set(ws))
    kept = defaultdict(list)
    for (lang, w), n in df.items():
        if n >= rule.least_docs:
            kept[lang].append(w)
    n = defaultdict(Counter)
    for (_, lang, source), ws in zip(docs, terms):
        n[lang or "", source or ""].update(w for w in ws if w in set(kept[lang or ""]))
    p = lambda c, total, v: 1 + 10**9 * (c + 2) // (total + 2 * v)
    out = set()
    for lang, source in n:
        v, mine = kept[lang], n[lang, source]
        whole = sum((n[g] for g in n if g[0] == lang), Counter())
        share = lambda c: {w: p(c[w], sum(c.values()), len(v)) for w in v}  # noqa: B023, E731
        a, q = share(mine), share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        others = [(s, sum(f(a[w], b[w]) for w in v)) for lg, s in n if lg == lang and s != source for b in [share(n[lg, s])]]
        apart = [(w, f(a[w], q[w])) for w in v if mine[w] and a[w] > q[w]]
        for part, items, most in (("pair", others, None), ("term", apart, rule.top)):
            out |= {(lang, source, part, i, x, k + 1) for k, (i, x) in enumerate(sorted(items, key=lambda t: (-t[1], t[0].encode()))[:most])}
    return out


@pytest.mark.parametrize("rule", [divergence.AuditRule(3), divergence.AuditRule(3, top=2, shard_terms=7, broadcast_bytes=500, dense_bytes=300, batch_bytes=900, block=5)])
def test_divergence_equals_plain_counts(spark, rule):
    r = random.Random(4)
    pool = [f"t{'abcdefghij'[i % 10]}{'éßxyzÀ'[i % 6]}{'q' * (i // 10)}" for i in range(60)]
    docs = [(" ".join(r.choice([str.upper, str])(r.choice(pool)) + r.choice(["", "-", "1", "'s"]) for _ in range(r.randrange(30))), r.choice(["en", "de", None]), r.choice(["a", "b", "", None, "c"])) for _ in range(150)]
    docs += [(None, "fr", "x"), ("", "fr", "y"), ("lone", "it", "z"), ("a\x00b", "en", "a")]
    got = divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string").repartition(4), rule)
    assert {tuple(x) for x in got.collect()} == audit_brute(docs, rule)


def test_divergence_of_odd_rows(odd):
    got = {tuple(x) for x in divergence.divergence(odd, divergence.AuditRule(2)).collect()}
    assert got == audit_brute([(x.text, x.lang, x.source) for x in odd.collect()], divergence.AuditRule(2))
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = pa.array([f"en\0k{i}" for i in range(5000)])
    p = divergence.PerfectHash.of(keys)
    slots = p.slots(keys, divergence.hashes(keys))
    assert sorted(slots.tolist()) == list(range(5000)) and p.keys.take(pa.array(slots)).equals(keys)
    foreign = pa.array([f"de\0k{i}" for i in range(5000)])
    assert (p.slots(foreign, divergence.hashes(foreign)) == -1).all()
    # keys that no level can part are listed
    clash = divergence.PerfectHash(p.sizes, p.words, p.keys, {"de\0k7": 99})
    assert clash.slots(foreign, divergence.hashes(foreign))[7] == 99
    assert len(divergence.PerfectHash.of(pa.array([], pa.string())).slots(foreign, divergence.hashes(foreign))) == 5000


def mask_brute(docs):
    first = {}
    for i, t in docs:
        i = float("-inf") if i is None else i
        first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), (float("-inf") if i is None else i) > first[t]
        out.append((i, sum(f << k for k, f in enumerate(fails))))
    return Counter(out)


@pytest.mark.parametrize("rule", [filter_audit.TrieRule(), filter_audit.TrieRule(capacity=200, task_bytes=900, first=1), filter_audit.TrieRule(capacity=3000, task_bytes=3000, first=2, most_heavy=0)])
def test_masks_equal_brute_force(spark, rule):
    r = random.Random(6)
    head = "The same long beginning of very many texts, " * 3
    texts = [head + words(r.randrange(4), i % 30) for i in range(150)] + ["", None, "A", "AB", "é" * 90, "é" * 91, head, head[:-1], "x " * 250, words(230, 3) + " $"]
    docs = [(None if i % 50 == 7 else r.randrange(400), r.choice(texts)) for i in range(400)]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").repartition(6)
    assert Counter((x.doc_id, x.mask) for x in filter_audit.document_masks(df, rule).collect()) == mask_brute(docs)


def test_trie_keeps_strings_apart():
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(3000)] + [b"a" * k for k in range(3000)]
    trie = filter_audit.RadixTrie()
    for i, t in enumerate(texts):
        trie.insert(t, i)
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert sorted(trie.terminals()) == sorted(want.values())


def test_audit_walks_every_order(spark, odd):
    r = random.Random(9)
    rows = [(i, r.choice(["a", None, "b"]), r.randrange(32)) for i in range(300)]
    labels = [(i, r.choice([0, 1, None]), r.randrange(2)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.interactions(spark.createDataFrame(rows, "doc_id long, source string, mask int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    falls = Counter()
    for part in ("a", "", "b"):
        mine = [(i, m) for i, s, m in rows if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                b = 1 << "ABCDE".index(x)
                out = [(i, m) for i, m in left if m & b]
                left = [(i, m) for i, m in left if not m & b]
                fails = [m for _, m in mine if m & b]
                falls[part, x] += len(out)
                want = (len(left), len(out), len(fails) - len(out), sum(m == b for m in fails), sum(i in good for i, _ in out), sum(i in bad for i, _ in out))
                assert got[part, "".join(order), step][:-1] == want
    assert len(got) == 3 * 600 and all(v[-1] == falls[k[0], k[1][k[2] - 1]] for k, v in got.items())
    masks = filter_audit.document_masks(odd)
    assert Counter((x.doc_id, x.mask) for x in masks.collect()) == mask_brute([(x.doc_id, x.text) for x in odd.collect()])
    assert filter_audit.interactions(filter_audit.document_masks(odd.limit(0)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_digests_are_of_the_kept_words(spark):
    got = {x.doc_id: x for x in QUERIES["op12_substring_dedup"](spark, DATA).collect()}
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for (i, _), (n, m, kept) in zip(docs, cut_brute(docs, 50)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, m, hashlib.sha256(kept.encode()).hexdigest())

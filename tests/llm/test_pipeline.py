"""Each stage of the pipeline on what its predecessor kept, held against a plain version."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from foliomill.llm import packing
from foliomill.llm.common import Workspace, table
from test_operators import links_brute, windows_brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    work = Workspace(spark, "t")
    docs = table(spark, DATA, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(work.write(stage(spark, kept[-1], DATA), name))
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    raw, calm, cut, single, clean = ({r.doc_id: r.text for r in df.collect()} for df in kept[:-1])

    assert set(calm) < set(raw) and all(raw[i] == t for i, t in calm.items())
    toxic = {r.doc_id for r in table(spark, DATA, "labels").where("toxic = 1").collect()}
    fine = {r.doc_id for r in table(spark, DATA, "labels").where("toxic = 0").collect()}
    assert len(toxic & set(calm)) <= 0.4 * len(toxic) and len(fine - set(calm)) <= 0.05 * len(fine)

    assert set(cut) == set(calm)
    seen = Counter(x for t in cut.values() for x in t.split("\n") if len(x.split()) >= 50)
    assert not [x for x, n in seen.items() if n > 1]
    left = {x for t in cut.values() for x in t.split("\n")}
    assert all(x in left for t in calm.values() for x in t.split("\n") if len(x.split()) >= 50)

    _, _, find = links_brute(list(cut.values()))
    groups = defaultdict(list)
    for i, t in cut.items():
        groups[find(tuple(t.lower().split()))].append(i)
    assert set(single) == {min(g) for g in groups.values()}

    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    leaks = {i for i, t in single.items() for v in items if grams(t) & grams(v) and windows_brute(t, v) >= 0.8}
    assert set(clean) == set(single) - leaks

    pieces = defaultdict(int)
    for r in kept[-1].collect():
        pieces[r.doc_id] += r.length
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(packing.default_tokenizer())
    assert dict(pieces) == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in clean.items()}
    assert np.all([n > 0 for n in pieces.values()])

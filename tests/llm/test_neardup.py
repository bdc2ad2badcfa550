import random
import re

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from symbolmill.llm.neardup import _posts, _survey, all_pairs, components, near_duplicates
from symbolmill.llm.shingles import tokens

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^ \t\n\r\v\fA-Za-z0-9_]")


def brute(rows, t10=7, least=60):
    sets = {}
    for i, t in rows:
        k = TOKEN.findall(t or "")
        if len(k) >= least:
            sets[i] = {tuple(k[j : j + 5]) for j in range(len(k) - 4)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if a % 2 == b % 2 and 10 * len(sets[a] & sets[b]) >= t10 * len(sets[a] | sets[b])}


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["(", ")", "é", "中", "_x", ";"]
    rows = []
    for i in range(260):
        if i and r.random() < 0.6:
            t = list(r.choice(rows)[1].split(" "))
            for _ in range(r.randrange(0, 12)):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.choice([10, 59, 60, 61, 100, 300]))]
        rows.append((i, " ".join(t)))
    rows += [(1000, None), (1002, ""), (1004, "a " * 500), (1006, "a\n" * 600), (1008, rows[3][1].replace(" ", "\r\n")), rows[5]]
    return rows


def test_tokens():
    t = ["foo(bar) é中", "", "a_b 1\u00a0x", "foo ( bar )"]
    h, cuts = tokens(t)
    assert [b - a for a, b in zip(cuts, cuts[1:])] == [len(TOKEN.findall(x)) for x in t]
    assert list(h[:4]) == list(h[cuts[3] :])


def test_pairs_and_groups(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "rid bigint, text string, a string")
    links, classes = near_duplicates(df, bits=16)
    got = [(r["a"], r["b"]) for r in all_pairs(links, classes).collect()]
    want = brute({i: t for i, t in rows}.items())
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    group = {r["rid"]: r["group_id"] for r in components(links, classes).collect()}
    assert all(group[a] == group[b] and group[a] <= a for a, b in want)
    parent = {i: i for i in group}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert group == {i: find(i) for i in group}


def test_empty(spark):
    links, classes = near_duplicates(spark.createDataFrame([], "rid bigint, text string"), bits=16)
    assert all_pairs(links, classes).count() == 0 and components(links, classes).count() == 0


def joined(texts, bits):
    """Pairs that the posting join makes of ``texts`` under sketches of 2^bits counters."""
    batch = pa.RecordBatch.from_pydict({"rid": [2 * i for i in range(len(texts))], "text": texts})
    counts = np.zeros(2 << bits, np.int64)
    for b in _survey(5, 60, bits)[0]([batch]):
        for k, at, c in zip(*(b.column(n).to_pylist() for n in ("block", "places", "counts"))):
            if k is not None:
                counts[(k << 16) + np.frombuffer(at, np.uint16).astype(np.int64)] += np.frombuffer(c, np.uint32)
    steps = np.minimum(np.round(8 * np.log2(counts + 1)), 255).astype(np.uint8)
    keys = np.concatenate([b.column("key").to_numpy() for b in _posts(5, 60, 7, bits, SimpleNamespace(value=steps.tobytes()))[0]([batch])])
    n = np.unique(keys, return_counts=True)[1].astype(np.int64)
    return int((n * (n - 1) // 2).sum())


def test_a_full_sketch_keeps_the_join_small():
    """Two hundred occurrences a counter: a sketch of runs would hold noise alone, those of tokens and pairs still order them."""
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])
    common = [" ".join(words[r.integers(0, 40, 30)]) for _ in range(20)]
    texts = [" ".join([common[r.integers(20)], *words[np.minimum(r.zipf(1.3, 400), 3000) - 1], common[r.integers(20)]]) for _ in range(16000)]
    assert sum(t.count(" ") for t in texts) > 100 * (1 << 16)
    assert joined(texts, 16) <= 2 * joined(texts, 22)

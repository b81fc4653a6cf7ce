"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.test_text_ops import frame
from wayfold.llm import ngram_join, periodic_runs, prefix_trie, registry, sketch_dedup
from wayfold.operators import ordered

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# 11
def runs_by_brute_force(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(i + 1, j)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_brute_force(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    for _ in range(1500):
        n, k = rnd.randrange(90), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(3) if n else 0):
            a, p = rnd.randrange(n), rnd.randrange(1, 9)
            for i in range(a, min(n, a + p * rnd.randrange(2, 9))):
                w[i] = w[a + (i - a) % p]
        assert periodic_runs.runs_of(np.array(w, "int64")) == runs_by_brute_force(w)


def test_runs_of_long_texts():
    assert periodic_runs.runs_of(np.zeros(400_000, "int64")) == [(0, 400_000, 1)]
    w = np.arange(300_000)
    w[1_000:201_000] = np.tile(np.arange(40_000) + 10**6, 5)
    w[250_000:250_040] = np.tile([7, 8], 20)
    assert periodic_runs.runs_of(w) == [(1_000, 200_000, 40_000), (250_000, 40, 2)]


def test_query_gives_runs_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    df = registry.QUERIES["op11_periodic_runs"](spark, SF)
    assert df.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] and [t for _, t in df.dtypes[:8]] == ["bigint"] * 6 + ["string"] * 2
    got = sorted(tuple(r)[:8] for r in df.collect())
    assert got == sorted(expected_runs(r.doc_id, r.text) for r in docs) and any(r[1] for r in got)


def test_run_edges(spark, tmp_path):
    texts = [None, "", " \n", "ab " * 5, "ab " * 6, "x y\x0bx y\tx y x y x y", "a b a b a b a b c c c c c c", "é é " * 9]
    # 8 and others have a period written in: crc32 of the id is a multiple of ten.
    ids = [*range(len(texts)), next(i for i in range(100, 999) if zlib.crc32(str(i).encode()) % 10 == 0), None, 3]
    rows = list(zip(ids, [*texts, " ".join(map(str, range(500))), "z " * 30_000, texts[3]]))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, w string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r) for r in got), key=lambda r: str(r)) == sorted((expected_runs(i, t) for i, t in rows), key=lambda r: str(r)), key
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(df, "text", ["doc_id", "w"]).where("doc_id = 6").collect()}
    assert [tuple(r) for r in out[6].runs] == [(0, 8, 2), (8, 6, 1)] and out[6].collapsed == "a b c" and out[6].w == "clash"
    assert periodic_runs.periodic_runs(df.limit(0), "text", ["doc_id"]).count() == 0


# 12
def expected_components(rows):
    def shingles(text):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in SPACED.findall(text or "")]
        return frozenset(tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            by[s].append(i)
    some = list(by)
    for s in some:
        for i in by[s]:
            root[find(i)] = find(by[s][0])
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(by[b][0])] = find(by[a][0])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, float("inf")), float("inf") if doc_id is None else doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = least[find(i)]
        c = None if c == float("inf") else c
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=str)


def copies(rnd, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(edits)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [16, 256])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    """Groups of near copies, a chain of drifting copies, borderline pairs, in buckets of one block and of many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(sketch_dedup, "PAIRS", 3 * block)
    rnd = random.Random(12 + block)
    word = lambda: f"v{rnd.randrange(5000)}"
    texts = [None, "", " \t ", "one", "ONE", "two words", "Ä b c", "ä b c", "a b c d", "A B\x0bC\nd"]
    for _ in range(6):
        texts += copies(rnd, [word() for _ in range(rnd.choice([20, 60, 200]))], 30, rnd.choice([2, 4, 8]))
    chain = [word() for _ in range(120)]
    for k in range(60):
        chain[2 * k] = f"c{k}"
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(50)) for _ in range(100)] + texts[:30]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(7, texts[50]), (7, texts[50])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, key string")
    assert sorted((tuple(r) for r in sketch_dedup.near_components(df).collect()), key=str) == expected_components(rows)


def test_large_groups_of_copies(spark):
    """A third are one text, another third near copies of one: every link is found."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    texts = ["same text every time it is"] * 1500 + list(copies(rnd, base, 1500, 3)) + [" ".join(f"r{rnd.randrange(10**5)}" for _ in range(30)) for _ in range(1500)]
    out = sketch_dedup.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    heads = {r.component_id for r in out.where("doc_id < 3000").collect()}
    assert heads == {0, 1500} and out.where("kept").count() == 1502


def test_no_documents(spark):
    assert sketch_dedup.near_components(frame(spark).limit(0)).count() == 0


def test_sketches_estimate_similarity():
    """Every coordinate is filled at any size, and agreement keeps as close to the similarity as independent draws would."""
    rnd = np.random.RandomState(3)
    for n in (5, 9, 40, 900, 5000):
        both, agree = round(n * 8 / 9), []
        for _ in range(60):
            u = rnd.randint(0, 1 << 62, 2 * n).astype("uint64")
            a, b = sketch_dedup.sketch(u[:n]), sketch_dedup.sketch(np.concatenate([u[:both], u[n : 2 * n - both]]))
            agree.append(int((a == b).sum()))
        j = both / (2 * n - both)
        assert abs(np.mean(agree) / sketch_dedup.T - j) < 0.03 and np.std(agree) < 1.25 * (sketch_dedup.T * j * (1 - j)) ** 0.5
    one = np.array([5], "uint64")
    assert (sketch_dedup.sketch(one) == sketch_dedup.sketch(one)).all() and len(set(sketch_dedup.sketch(one).tolist())) > 100


# 13
def expected_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    walks = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        walks[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, w in walks.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
            if d:
                kids[w[: d - 1]].add(w[:d])
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(SPACED.findall(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if walks[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), sum(not kids[x] for x in below), saved, sha(ends)))
    return sorted(out, key=str)


TRIE = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("large", [1_000_000, 40])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, large):
    """Nulls in all columns, repeated rows, one long conversation (in parts if ``large`` is small), lists of ends in pieces."""
    monkeypatch.setattr(ordered, "LARGE", large)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "HELD", 16)
    rnd, rows = random.Random(13), []
    for c in range(150):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 6])):
            rows.append((c, t, rnd.choice(["user", "bot"]), f"w{rnd.randrange(2)} same words\there"))
    rows += [(500, t, "user", "a a") for t in range(120)] + [(c, t, "u", "hot text") for c in range(600, 680) for t in range(2)]
    rows += [(None, 1, "u", "x"), (40, None, None, None), (40, None, None, None), (40, 1, "u", ""), (333, 2, None, "z"), (333, 2, "\x1f", "z"), (334, 2, "", "\x1fz"), (-7, 0, "u", "neg")]
    df = spark.createDataFrame([(*r, 1) for r in rows], TRIE + ", node int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = registry.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected_trie([r for r in rows if r[0] is None or r[0] >= 0] + [r for r in rows if (r[0] or 0) < 0])


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame([], TRIE))).count() == 0

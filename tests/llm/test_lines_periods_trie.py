"""Line dedup, periodic runs and the prefix trie against plain versions, and their defined results on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from coastline.llm import lines, periods, trie

CLASH = ("line", "doc", "keeper", "version", "gone", "lines_n", "period_runs", "h", "a", "p", "words", "conv", "at", "prefix", "digest", "depth", "chars")
DOC = "doc_id long, text string"
TURN = "conv_id long, turn long, role string, text string"


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# 12: lines


def plain_lines(rows, least_docs, least_chars):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                where[key(line)].add(i)
    often = {k: max(v) for k, v in where.items() if len(v) >= least_docs}
    out = []
    for i, t in rows:
        cut = (t or "").split("\n")
        left = [x for x in cut if i is None or often.get(key(x), i) == i]
        out.append((i, len(cut), len(cut) - len(left), "\n".join(left)))
    return Counter(out)


def line_rows(spark, rows, **how):
    out = lines.drop_frequent_lines(clashing(spark.createDataFrame(rows, DOC)), **how)
    assert set(out.columns) == {"doc_id", "text", *CLASH, "lines_n", "lines_dropped", "lines_text"} and all(r.keeper == "x" for r in out.collect())
    return Counter((r.doc_id, r.lines_n, r.lines_dropped, r.lines_text) for r in out.collect())


def test_lines_against_plain_version(spark):
    rng = random.Random(1)
    pool = ["A shared line of some length", "  a shared LINE of some length\t", "short", "", "Ärger über Öl und noch viel mehr", "ärger über Öl und noch viel mehr", "exactly twenty chars", "nineteen characters", "\x0bwith feeds at its ends\r", "with feeds at its ends"]
    rows = [(i, "\n".join(rng.choice([*pool, f"a line that only document {i} has"]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    for least_docs, least_chars in ((3, 20), (2, 1), (40, 5)):
        assert line_rows(spark, rows, least_docs=least_docs, least_chars=least_chars) == plain_lines(rows, least_docs, least_chars)


def test_lines_odd_rows(spark):
    hot = "this line is in every single document"
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, hot), (None, f"{hot}\n{hot}"), (4, hot), (4, hot), (4, f"other\n{hot}"), (5, f"{hot}\n{hot}\nown"), (6, "x" * 2_000_000 + "\n" + hot), (7, (hot + "\n") * 20_000)]
    got = line_rows(spark, rows)
    assert got == plain_lines(rows, 3, 20)
    assert got[None, 1, 0, hot] == 1 and got[4, 1, 1, ""] == 2 and got[7, 20_001, 0, (hot + "\n") * 20_000] == 1
    assert lines.drop_frequent_lines(spark.createDataFrame([], DOC)).count() == 0


# 13: runs


def plain_runs(w, least=6, repeats=4):
    seen = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in seen.items())


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, most):
    w, k = [], rng.randint(1, 5)
    while len(w) < most:
        part = [f"w{rng.randint(0, k)}" for _ in range(rng.randint(1, 7))]
        w += part * (rng.randint(2, 9) if rng.random() < 0.5 else 1)
    return w


def run_rows(spark, rows, **how):
    out = periods.find_runs(clashing(spark.createDataFrame(rows, DOC)), **how)
    assert set(out.columns) == {"doc_id", "text", *CLASH, "period_words", "period_runs", "period_text"}
    return [(r.doc_id, r.period_words, [tuple(x) for x in r.period_runs], r.period_text) for r in out.collect()]


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 2), (9, 3)])
def test_runs_against_plain_version(spark, least, repeats):
    rng = random.Random(least)
    texts = [periodic(rng, rng.randint(0, 90)) for _ in range(300)]
    want = []
    for i, w in enumerate(texts):
        runs = plain_runs(w, least, repeats)
        want.append((i, len(w), runs, plain_collapse(w, runs)))
    assert sorted(run_rows(spark, [(i, " \n\t".join(w)) for i, w in enumerate(texts)], least=least, repeats=repeats)) == want


def test_runs_of_long_texts_and_small_blocks(monkeypatch):
    rng = random.Random(8)
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(periods, "PAIRS", pairs)
        w = np.array([int(x[1:]) for x in periodic(rng, 400)])
        got = periods.runs_of(w, np.array([0]), np.array([len(w)]))
        assert [tuple(r[1:]) for r in got.tolist()] == plain_runs(w.tolist())


def test_runs_are_verified_word_by_word(monkeypatch):
    """At first with hashes that do not tell the order of words, so that other stretches hash alike."""
    turns, good = [], periods.base

    def base(turn):
        turns.append(turn)
        return good(turn) if turn else np.uint64(1)

    monkeypatch.setattr(periods, "base", base)
    rng = random.Random(5)
    for _ in range(200):
        w = np.array([int(x[1:]) for x in periodic(rng, 60)])
        got = periods.runs_of(w, np.array([0]), np.array([len(w)]))
        assert [tuple(r[1:]) for r in got.tolist()] == plain_runs(w.tolist())
    assert 1 in turns and max(turns) == 1


def test_runs_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 6), (4, "b " * 5), (4, "b " * 5), (5, "word " * 300_000), (6, "a b c d " * 4 + "x y " * 4), (7, "a\x1cb " * 8)]
    got = {i: (n, runs, text) for i, n, runs, text in run_rows(spark, rows)}
    assert got == {
        1: (0, [], ""), 2: (0, [], ""), 3: (0, [], ""), None: (6, [(0, 6, 1)], "a"), 4: (5, [], "b b b b b"), 5: (300_000, [(0, 300_000, 1)], "word"),
        6: (24, [(0, 16, 4), (16, 8, 2)], "a b c d x y"), 7: (8, [(0, 8, 1)], "a\x1cb"),
    }
    assert periods.find_runs(spark.createDataFrame([], DOC)).count() == 0


# 11: trie


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = set()
    for k, own in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ids = ",".join(map(str, sorted(ends[k])))
        out.add((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), kids[k], sum(not kids[x] for x in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def some_convs(rng, n, longest):
    return {c: [(rng.choice("ua"), rng.choice(["", "x", "hello", "ä b"])) for _ in range(rng.randint(1, longest))] for c in range(n)}


def test_trie_against_plain_version(spark):
    convs = some_convs(random.Random(2), 80, 5)
    rows = [(c, 10 - t if c % 2 else t, *turn) for c, turns in convs.items() for t, turn in (enumerate(turns) if c % 2 == 0 else enumerate(turns))]
    convs = {c: t[::-1] if c % 2 else t for c, t in convs.items()}
    random.Random(3).shuffle(rows)
    df = clashing(spark.createDataFrame(rows, TURN)).repartition(5)
    assert trie_rows(trie.prefix_trie(df)) == plain_trie(convs)


def test_trie_of_deep_conversations(spark, monkeypatch):
    """Blocks of blocks: chains and sums go over several levels."""
    from coastline.operators import spread

    monkeypatch.setattr(spread, "CHUNK", 4)
    rng = random.Random(4)
    long = [("u", str(rng.randint(0, 3))) for _ in range(150)]
    convs = {1: long, 2: long[:100] + [("a", "else")] * 30, 3: long[:7], 4: long, 5: [], 6: [("a", "z")] * 70}
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    steps = trie.steps(spark.createDataFrame(rows, TURN))
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    assert trie_rows(trie.trie(steps, ids, block=4)) == plain_trie(convs)


def test_ids_are_hashed_in_order_over_pieces(spark):
    df = spark.range(1000).selectExpr("unhex(if(id % 7 = 0, 'AA', 'BB')) as prefix", "id * 3 - 500 as conv").repartition(7)
    want = {bytes.fromhex(k): hashlib.sha256(",".join(str(i * 3 - 500) for i in range(1000) if (i % 7 == 0) == (k == "AA")).encode()).hexdigest() for k in ("AA", "BB")}
    for piece in (1, 13, 10_000):
        assert {bytes(r.prefix): r.ends_sha256 for r in trie.ids_digests(df, piece).collect()} == want


def test_trie_odd_rows(spark):
    text = "long " * 100_000
    rows = [(1, None, None, None), (1, 2, "u", "b"), (1, 2, "u", "b"), (None, 1, "u", "lost"), (2, 1, "", ""), (2, 5, "u", "b"), (3, 0, "a:", "b"), (4, 0, "a", ":b"), (-7, 0, "u", text)]
    want = plain_trie({1: [("", ""), ("u", "b"), ("u", "b")], 2: [("", ""), ("u", "b")], 3: [("a:", "b")], 4: [("a", ":b")], -7: [("u", text)]})
    assert trie_rows(trie.prefix_trie(clashing(spark.createDataFrame(rows, TURN)))) == want
    assert trie.prefix_trie(spark.createDataFrame([], TURN)).count() == 0


def test_rebuilt_conversations(spark):
    rng = random.Random(6)
    convs = {c: [("u", f"{rng.randint(0, 2)}") for _ in range(rng.randint(1, 6))] for c in [*range(100, 130), *range(205, 220), 300, 301]}
    heads = lambda c: c * 7 % 6
    want = {c: convs.get(c - c % 100, [])[: heads(c)] + turns[heads(c) :] for c, turns in convs.items()}
    steps = trie.steps(spark.createDataFrame([(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)], TURN))
    ids = steps.select("conv").distinct()
    assert trie_rows(trie.trie(trie.rebuilt(steps, ids, 100, F.col("conv") * 7 % 6, 5), ids)) == plain_trie(want)

"""Chat formatting, the trie of turns and centroid clusters against plain re-computations."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from arborlens.llm import centroids, chat, turn_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, written string, record string, path string"
HARD = ["", "### ", "###", "####", "#### ", "\\### ", "\\\\### x", "</turn>", "\\</turn>\n", "\n</turn>\n### assistant: no", "a: b", "\\", "\\\\", "### \\",
        "é</turn>ü### 漢", "\n", " ", ":", "\\1\\0", "</tur", "n>", "x" * 3000, "\\" * 500 + "### " * 50, None]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", "r", "p") for r in rows], TURNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    """Turns by conversation: null turns first, then role and text."""
    out = {}
    for conv_id, turn, role, text in rows:
        out.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(v)] for c, v in out.items()}


def read_back(formatted):
    """A scanner of its own: from mark to mark, sign by sign."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith("### ", at)
        colon = formatted.index(":", at)
        role = formatted[at + 4:colon]
        assert formatted[colon + 1] == " "
        text, at = [], colon + 2
        while not formatted.startswith("</turn>", at):
            assert not formatted.startswith("### ", at), "a mark within a turn"
            step = next((1 + len(m) for m in ("### ", "</turn>") if formatted.startswith("\\" + m, at)), 0)
            text.append(formatted[at + 1:at + step] if step else formatted[at])
            at += step or 1
        assert text.pop() == "\n" and formatted[at + 7] == "\n"
        at += 8
        for i, sign in reversed(list(enumerate("\\:#<"))):
            role = role.replace(f"\\{i}", sign)
        turns.append((role, "".join(text)))
    return turns


def check_chat(spark, rows):
    source = ordered(rows)
    written = chat.chat(turns_of(spark, rows))
    got = {r.conv_id: r for r in written.collect()}
    assert set(got) == set(source)
    for conv_id, turns in source.items():
        row = got[conv_id]
        assert read_back(row.formatted) == turns
        raw = row.formatted.encode()
        spans = [raw[s.start:s.start + s.length].decode().replace("\\### ", "### ").replace("\\</turn>", "</turn>") for s in row.loss]
        assert spans == [t for r, t in turns if r == "assistant"]
    for r in chat.fields(written).collect():
        turns = source[r.conv_id]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
            len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), sha(learnt), len(got[r.conv_id].formatted))


def test_chats_read_back(spark):
    draw = random.Random(3)
    roles = ["user", "assistant", "assistant", None, "", "a:b", "\\", "x\\1", "### ", "</turn>", ": ", "\n", "#<"]
    rows = [(c, draw.choice([None, 0, 1, 2, 2, 3]), draw.choice(roles), draw.choice(HARD) if i % 2 else "".join(draw.choices(["###", " ", "\\", "</turn>", ":", "\n", "a"], k=9)))
            for c in (None, -7, 0, 5, 2**60) for i in range(40)]
    check_chat(spark, rows + rows[:20])
    check_chat(spark, [(1, i, "assistant", "x" * 2000 + "### ") for i in range(400)] + [(2, 0, "user", "\\" * 200_000), (3, 0, "assistant", "#" * 200_000)])
    assert chat.fields(chat.chat(turns_of(spark, []))).count() == 0


def test_only_conflicting_content_is_escaped(spark):
    rows = [(0, 0, "user", "a \\ b: # </tur"), (1, 0, "a#<\\b", "x"), (2, 0, "user", "### "), (3, 0, "a:", "### ")]
    got = {r.conv_id: r.formatted for r in chat.chat(turns_of(spark, rows)).collect()}
    assert got == {0: "### user: a \\ b: # </tur\n</turn>\n", 1: "### a#<\\b: x\n</turn>\n", 2: "### user: \\### \n</turn>\n", 3: "### a\\1: \\### \n</turn>\n"}


@pytest.mark.parametrize("text", ["x", "### user: a", "### user: a\n</turn>", "### user:a\n</turn>\n", "### user: a\n</turn>\n### ", "### u: a ### b: c\n</turn>\n", "### u\n</turn>\n", " ### u: a\n</turn>\n"])
def test_what_is_not_of_the_grammar(spark, text):
    assert spark.createDataFrame([(text,)], "f string").select(chat.parse(F.col("f"))).first()[0] is None


# The trie


def trie_by_brute_force(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            pair = ((role or ""), (text or ""))
            order = sha(f"{len(pair[0].encode())}:{pair[0]}{pair[1]}")
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, order, pair))
    own = {c: [r[3] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - math.fmod(c, 100), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids(path)), sum(not kids(p) for p in below),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                    sha(",".join(str(c) for c in sorted(ids) if len(built[c]) == len(path)))))
    return sorted(out, key=repr)


def conversations(seed, n, texts=4, most=7, step=7):
    draw = random.Random(seed)
    return [(i * step, k, draw.choice(["user", "assistant", None, ""]), draw.choice([None, "", "é漢", *[f"t{j}" * (j + 1) for j in range(texts)]]))
            for i in range(n) for k in range(draw.randrange(1, most))]


@pytest.mark.parametrize("run, shard, fan", [(50_000, 400_000, 64), (4, 9, 2), (1, 1, 3), (30, 40, 64)])
def test_trie(spark, run, shard, fan):
    rows = conversations(1, 60) + conversations(2, 30, texts=1, most=4, step=13)
    rows += [(1000 + i, k, "user", "same") for i in range(40) for k in range(3)]  # equal conversations over many runs
    rows += [(2000, k, "user", f"long {k}") for k in range(60)] + [(2099, k, "user", f"long {k}") for k in range(45)]
    rows += [(5, None, "user", "first"), (5, 0, "a", "x"), (5, 0, "a", "x"), (5, 0, "b", "y"), (-105, 0, "a", "x"), (-100, 3, "a", "x"), (None, 0, "a", "x")]
    got = turn_trie.trie(turns_of(spark, rows).repartition(5), run, shard, fan)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_brute_force(rows)


def test_trie_of_little(spark):
    assert turn_trie.trie(turns_of(spark, [])).count() == 0
    assert turn_trie.trie(turns_of(spark, [(None, 0, "a", "x")])).count() == 0
    few = next(c for c in range(1, 50) if zlib.crc32(str(c).encode()) % 6 > 1)  # its only turn falls away, and it has no source
    assert [tuple(r) for r in turn_trie.trie(turns_of(spark, [(few, 0, "user", "x")])).collect()] == [(few, 0, None, 1, 0, 1, 0, sha(str(few)))]


def test_trees_are_balanced():
    tree = turn_trie.Tree()
    tree.fill([[i] for i in range(1000)])
    deepest, stack = 0, [(tree.down[0], 1)]
    while stack:
        node, depth = stack.pop()
        if node:
            deepest = max(deepest, depth)
            stack += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest == 10


# Centroids


def clusters_by_brute_force(rows, dims, k=8, rounds=10, seed=3):
    kept = [(i, tuple(math.floor(Fraction(x) * 1024) for x in v), v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[2]))
    middle = [r[1] for r in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v, _ in kept]
        groups = [[v for (_, v, _), o in zip(kept, of) if o == c] for c in range(len(middle))]
        middle = [tuple(sum(x) // len(g) for x in zip(*g)) if g else middle[c] for c, g in enumerate(groups)]
    last = [nearest(v) for _, v, _ in kept]
    inertia = [sum(d for d, c in last if c == i) for i in range(len(middle))]
    fit = lambda x: x if -2**63 <= x < 2**63 else None
    return sorted(((i, c, fit(d), fit(inertia[c]), fit(sum(inertia)), sha(",".join(map(str, middle[c])))) for (i, _, _), (d, c) in zip(kept, last)), key=repr)


def check_clusters(spark, rows, dims, **how):
    table = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, places string").repartition(3)
    got = centroids.clusters(table, dims=dims, **how)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clusters_by_brute_force(rows, dims, how.get("k", 8))


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 16)
    draw = random.Random(4)
    rows = [(i, [draw.gauss(i % 5, 0.3) for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 1.0]) for i in range(100)]  # a hot vector
    odd = [(None, [1.0, 2.0, 3.0]), (7, [0.1, 0.2, 0.3]), (7, [0.1, 0.2, 0.3]), (8, None), (9, []), (10, [1.0, 2.0]), (11, [None, 1.0, 2.0]),
           (12, [math.nan, 0.0, 0.0]), (13, [math.inf, 0.0, 0.0]), (14, [-0.0, 0.0, -1e-9])]
    check_clusters(spark, rows + odd, 3)
    check_clusters(spark, rows, 3, k=3)
    check_clusters(spark, odd[:4], 3)  # fewer vectors than centroids
    check_clusters(spark, [(i, [1.0, 1.0]) for i in range(20)], 2)  # empty clusters stay
    check_clusters(spark, [], 64)


def test_clusters_of_large_numbers(spark):
    draw = random.Random(5)
    for scale in (2.0**27, 2.0**45, 1e30, 1e300):  # beyond 64 bits a distance is null, its cluster still exact
        check_clusters(spark, [(i, [draw.uniform(-scale, scale) for _ in range(2)]) for i in range(60)], 2, k=3)
    table = spark.createDataFrame([(1, [1e307, 0.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in centroids.clusters(table, dims=2).collect()] == [2]

"""Hard negatives, bit-sliced search and the prefix trie: brute force, odd rows, ties, copies and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from footstats.llm import prefix_trie
from footstats.llm.bitslices import SlicedRows, bitmap, rows_of, slice_columns, top_products
from footstats.llm.mining import emit_negatives, mine_negatives, pack_pair, unpack_pair
from footstats.llm.prefix_trie import conversation_trie
from footstats.llm.tiles import LIMIT, products

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank string, id int, q string, note string"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1.0, "x", 3, "q", "n") for r in rows], VECTORS)


def plain_vectors(rows, scale):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(max(-LIMIT, min(LIMIT, scale * float(np.float32(x))))) for x in v]
        kept.setdefault(i, []).append((label, q))
    return kept


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, k, scale, every):
    sound = {i: min(q for _, q in r) for i, r in plain_vectors(rows, scale).items()}
    out = []
    for a in sorted(sound):
        if a % every == 0:
            best = sorted((-dot(sound[a], sound[b]), b) for b in sound if b != a and len(sound[a]) == len(sound[b]))[:k]
            out += [(a, n, b, -s) for n, (s, b) in enumerate(best, 1)]
    return out


def plain_mined(rows, scale, every):
    kept = plain_vectors([r for r in rows if r[2] is not None], scale)
    sound = {i: min(r) for i, r in kept.items()}
    out = []
    for a in sorted(sound):
        if a % every:
            continue
        label, q = sound[a]
        scored = sorted((-dot(q, r), b, lab) for b, (lab, r) in sound.items() if b != a and len(r) == len(q))
        for s, b, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, b, n, c, -s, -t) for n, (t, c, _) in enumerate(fit, 1)]
    return sorted(out)


def random_rows(seed, n, dim=6, spread=3):
    pick = random.Random(seed)
    rows = [(i, [pick.randint(-spread, spread) / 4 for _ in range(dim)], pick.randint(0, 2)) for i in range(n)]
    copies = [(n + i, rows[0][1], pick.randint(0, 2)) for i in range(40)]  # a group of copies
    odd = [
        (None, rows[0][1], 1), (1000, None, 1), (1001, [], 1), (1005, [], 2), (1002, [None] * dim, 1), (1003, [math.nan] * dim, 1),
        (1004, [math.inf] * dim, 0), (1010, [0.0] * dim, 1), (1011, [1.0, 2.0], 1), (1020, [0.5, -1.0], 2), (1015, rows[3][1], None),
        (1025, [3e38] * dim, 1), (1030, [-3e38] * dim, 2), (-20, rows[1][1], 0), (2**60 + 4, rows[2][1], 1),
    ]
    return rows + copies + odd + rows[:15] + [(4, rows[9][1], 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bitsliced_search_matches_brute_force(spark, seed):
    rows = random_rows(seed, 120)
    got = top_products(vectors(spark, rows), F.col("id") % 5 == 0, k=7, shard_rows=40)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 7, 64, 5)
    assert got.schema["rank"].dataType.simpleString() == "int"


def test_vector_operators_on_an_empty_table(spark):
    none = vectors(spark, [])
    assert top_products(none, F.col("id") % 5 == 0).collect() == []
    assert mine_negatives(none, F.col("id") % 5 == 0, F.col("label")).collect() == []


def test_sums_of_slices_order_rows_as_products_do():
    pick = np.random.default_rng(5)
    for dim, n in [(1, 1), (3, 64), (5, 65), (9, 300)]:
        matrix, weights = pick.integers(-40, 41, (n, dim)), pick.integers(-40, 41, dim)
        index = SlicedRows(np.arange(n), matrix, slice_columns(matrix))
        total = np.zeros(n, np.int64)
        for place, digit in enumerate(index.weighted_sum(weights)):
            total[rows_of(digit)] += 1 << place
        exact = products(weights[None, :], matrix)[0]
        assert len(set(total - exact)) == 1
    flags = pick.integers(0, 2, 130)
    assert rows_of(bitmap(flags)).tolist() == np.flatnonzero(flags).tolist()


def test_products_beyond_exact_floating_point():
    a = np.array([[LIMIT, LIMIT - 1], [3, 4]])
    b = np.array([[LIMIT, 1], [LIMIT - 1, LIMIT]])
    assert products(a, b).tolist() == [[dot(x, y) for y in b.tolist()] for x in a.tolist()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hard_negatives_match_brute_force(spark, seed):
    rows = random_rows(seed, 150)
    got = mine_negatives(vectors(spark, rows), F.col("id") % 5 == 0, F.col("label"), shard_rows=50)
    want = plain_mined(rows, 256, 5)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_of_equal_score_and_smaller_id_belong_to_the_window():
    pairs = [(7, 100, 0, 50), (7, 100, 1, 3), (7, 90, 1, 2), (7, 90, 0, 60), (7, 79, 1, 1), (8, -5, 0, 1), (8, -5, 1, 2), (9, 0, 0, 4), (9, 0, 1, 5)]
    keys = sorted(pack_pair(*p) for p in pairs)
    assert sorted(map(unpack_pair, keys)) == sorted(pairs)
    assert list(emit_negatives(keys, 5, 5, 80)) == [
        (7, 50, 1, 3, 100, 100), (7, 50, 2, 2, 100, 90), (7, 60, 1, 2, 90, 90), (7, 60, 2, 1, 90, 79), (9, 4, 1, 5, 0, 0),
    ]


# --- prefix trie

TURNS = "conv_id long, turn long, role string, text string, name string, depth int, words string"


def plain_trie(rows):
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r[2], r[3]) for r in sorted(t)] for c, t in by_conv.items()}
    seqs = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))  # the remainder has the sign of c
        seqs[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", s[-1][1]) if w]) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * words
    return sorted((
        m[0], len(s), members[s[:-1]][0] if s else -1, len(m), children[s], leaves[s], saved[s],
        hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest(),
    ) for s, m in members.items())


def trie_rows(spark, rows):
    got = conversation_trie(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for _, t in got.dtypes[:-1])
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)  # several pieces for the digests of copied conversations
    monkeypatch.setattr(prefix_trie, "CHUNK_TURNS", 4)
    pick, rows = random.Random(seed), []
    stems = [[(pick.choice(["user", "assistant"]), " ".join(pick.choices("ab", k=pick.randint(0, 3)))) for _ in range(20)] for _ in range(3)]
    for c in itertools.chain(range(0, 47), range(100, 110), range(-25, -15)):
        turns = pick.choice(stems)[: pick.choice([1, 2, 3, 5, 9, 17])] + [("user", pick.choice("cd"))] * pick.randint(0, 2)
        rows += [(c, n, *t) for n, t in enumerate(turns)]
    rows += [(c, n, "user", "the same") for c in range(200, 260) for n in range(3)]
    rows += [(300, n, "user", f"long {n}") for n in range(41)] + [(301, n, "user", f"long {n}") for n in range(38)]
    rows += [(None, 0, "user", "lost"), (50, None, None, None), (50, 0, None, "z"), (50, 0, "user", None), (50, 0, "user", None), (51, 5, "a:b", "c")]
    rows += [(2**60 + 4, 0, "user", "x \t\n y z"), (63, 7, "user", "w" * 30_000)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_prefix_trie_of_no_and_of_turnless_conversations(spark):
    assert trie_rows(spark, []) == []
    # Each of them loses all its turns, and there is no conversation it could begin with.
    bare = [c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "hi") for c in bare]
    want = hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest()
    assert trie_rows(spark, rows) == [(bare[0], 0, -1, 3, 0, 1, 0, want)] == plain_trie(rows)

"""Operators that join rows: brute force on small fixtures, hot groups, odd rows and ties."""

import glob
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footstats.llm import jaccard, nearest
from footstats.llm.common import cut, tokenizer_path
from footstats.llm.contamination import build_index, find_contamination, test_windows as windows_of, word_list
from footstats.llm.jaccard import components, similarity_classes
from footstats.llm.lattice import WORD_START, Lattice, score_documents, vocabulary
from footstats.llm.nearest import nearest_neighbours
from tests.llm.test_texts import ODD, frame

WORDS = ["".join(x) for x in itertools.product("bdfgklmn", "aeiou", "rst")]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# --- similarity join


def plain_classes(rows, width, percent):
    sets, parent = [], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), smallest[root(i)]) for i, (doc_id, _) in enumerate(rows))


def families(seed, n=24, members=9):
    """Texts in families of near copies with growing edits, exact copies and a passage that many hold."""
    pick, out = random.Random(seed), []
    passage = " ".join(pick.choices(WORDS, k=40))
    for _ in range(n):
        base = pick.choices(WORDS, k=pick.choice([2, 6, 30, 90]))
        for _ in range(pick.randint(1, members)):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
                words[pick.randrange(len(words))] = pick.choice(WORDS)
            out.append(" ".join(words) + (" " + passage if pick.random() < 0.3 else ""))
    return out


@pytest.mark.parametrize("width, percent, pair_rows", [(3, 90, 48), (3, 90, 1), (5, 80, 3)])
def test_classes_match_brute_force(spark, monkeypatch, width, percent, pair_rows):
    monkeypatch.setattr(jaccard, "PAIR_ROWS", pair_rows)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    monkeypatch.setattr(jaccard, "TILE_COLUMNS", 7)
    texts = families(width) + ODD + ["Two words", "two  WORDS", "É b c", "é b c"]
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in similarity_classes(docs, width, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain_classes(list(enumerate(texts)), width, percent)


def test_hot_family_of_near_copies(spark, monkeypatch):
    """One family holds most rows; all its pairs go through tiles, not through rows."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 32)
    pick = random.Random(9)
    base = pick.choices(WORDS, k=80)
    texts = []
    for _ in range(220):
        words = list(base)
        for _ in range(pick.choice([0, 1, 2, 3])):
            words[pick.randrange(80)] = pick.choice(WORDS)
        texts.append(" ".join(words))
    texts += families(3, 6)
    got = sorted(tuple(r) for r in similarity_classes(frame(spark, texts), 3, 90).collect())
    assert got == plain_classes(list(enumerate(texts)), 3, 90)


def test_classes_of_odd_tables(spark):
    assert similarity_classes(frame(spark, []), 3, 90).count() == 0
    assert {tuple(r) for r in similarity_classes(frame(spark, [None, ""]), 3, 90).collect()} == {(0, 0, 0), (1, 0, 1)}
    twice = frame(spark, ["a b c d"]).unionByName(frame(spark, ["a b c d"])).unionByName(frame(spark, ["x y z v"]))
    assert sorted(tuple(r) for r in similarity_classes(twice, 3, 90).collect()) == [(0, 2, 0)] * 3


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffle files behind a written table go at once, not when the driver happens to collect garbage."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    counts = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert counts.count() == 7


def test_similarity_leaves_no_shingles_or_texts_on_disk(spark):
    """What is left of the written tables is what the result is read from: no leading shingles, no texts, no rounds of components."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    folders = lambda: set(glob.glob(f"{top}/llm-{spark.sparkContext.applicationId}/*"))
    before = folders()
    assert similarity_classes(frame(spark, families(3, 6)), 3, 90).count()
    left = folders() - before
    assert not {c for f in left for c in spark.read.parquet(f).columns} & {"lead", "text"}
    assert len(left) <= 6


@pytest.mark.parametrize("percent, pair_rows, listed", [(90, 128, 7), (80, 4, 1), (90, 1, 3)])
def test_column_blocks_give_all_pairs_whose_sizes_link(percent, pair_rows, listed, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED_PAIRS", listed)
    pick = random.Random(percent + pair_rows)
    sizes = {i: pick.choice([9, 10, 11, 12, 40, 43, 300]) for i in range(-40, 40)}
    entries = np.zeros(400, jaccard.ENTRY)
    rows = [(pick.choice([0, 1, 2, 3, 250]) << pick.choice([0, 32]), pick.choice(list(sizes))) for _ in range(400)]
    for e, (s, i) in zip(entries, rows):
        e["s"], e["set_id"], e["n"] = np.frombuffer(s.to_bytes(5, "little"), np.uint8), i, sizes[i]
    want = Counter((min(a, b), max(a, b)) for (s, a), (t, b) in itertools.combinations(rows, 2)
                   if s == t and a != b and 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b]))
    got, chains = Counter(), []
    for part in jaccard.list_pairs(entries, percent, pair_rows):
        for a, b, na, nb in zip(*(x.tolist() for x in part)):
            if na:
                assert (na, nb) == (sizes[a], sizes[b])
                got[a, b] += 1
            else:
                chains.append((a, b))
    root = {i: i for i in sizes}
    for a, b in chains:
        old, new = root[a], root[b]
        root = {i: new if r == old else r for i, r in root.items()}
    assert all(got[p] == n or root[p[0]] == root[p[1]] for p, n in want.items()) and set(got) <= set(want)
    assert bool(chains) == (pair_rows < 128)


def test_rows_of_other_sizes_do_not_meet_in_a_hot_block(spark, monkeypatch):
    """Texts that share words and differ in length by a factor: blocks of many rows, and only those of like sizes are compared."""
    met = []
    real = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: met.append(edges.count()) or real(edges))
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 2)
    texts = [" ".join(f"w{j}" for j in range(9 * 3**i)) for i in range(5)]
    got = similarity_classes(frame(spark, texts), 1, 50).collect()
    assert sorted(r["component_id"] for r in got) == list(range(5))
    assert met[0] == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


# --- decontamination


def plain_hits(texts, items, width):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for i, t in enumerate(texts):
        w, hit, owners = words(t), set(), set()
        for window, its in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    owners |= its
        out.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_matches_brute_force(spark):
    pick = random.Random(11)
    items = [(i, " ".join(pick.choices(WORDS[:60], k=pick.choice([1, 2, 3, 7, 12])))) for i in range(14)]
    items += [(20, items[4][1]), (21, None), (22, "..."), (23, items[5][1].upper())]
    texts = ODD + [" ".join(pick.choices(WORDS[:60], k=50)) for _ in range(30)]
    texts += [f"{texts[-k]} {pick.choice(items[:14])[1]}, {pick.choice(items[:14])[1]}!" for k in range(1, 30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(frame(spark, texts), table, width=4)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == plain_hits(texts, items, 4)


def test_one_passage_in_most_documents(spark):
    passage = " ".join(WORDS[:15])
    texts = [f"{WORDS[i % 100]} {passage} {passage} end" for i in range(200)] + ["clean"]
    got = find_contamination(frame(spark, texts), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert {(r["n_hit"], r["n_items"]) for r in got.where("doc_id < 200").collect()} == {(30, 1)}


def test_contamination_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ODD)
    assert {r["contaminated"] for r in find_contamination(docs, none).collect()} == {False}
    assert find_contamination(docs.limit(0), none).count() == 0
    same_id = frame(spark, ["one two"]).unionByName(frame(spark, ["three"]))
    got = find_contamination(same_id, spark.createDataFrame([(1, "three")], "item_id long, text string"))
    assert sorted(r["n_hit"] for r in got.collect()) == [0, 1]


def test_near_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["alpha beta x gamma delta", "alpha beta gamma delta", "alpha x x x x x beta gamma delta", "delta gamma beta alpha"]
    rows = frame(spark, texts).select(F.col("doc_id").alias("row"), word_list(F.col("text")).alias("words"))
    near = build_index(rows, windows_of(items, 4), rare_words=4).near(slack=2, width=4)
    assert {r["row"] for r in near.collect()} == {0, 1}
    got = find_contamination(frame(spark, texts), items, width=4, slack=2)
    assert {(r["doc_id"], r["contaminated"], r["n_near"] > 0) for r in got.collect()} >= {(0, False, True), (1, True, True), (2, False, False)}


def test_items_with_one_id_or_none(spark):
    a, b, c, d = (" ".join(WORDS[k : k + 6]) for k in (0, 10, 20, 30))
    items = [(1, a), (1, b), (1, "nowhere to be found here"), (None, c), (None, d), (2, a), (None, a)]
    texts = [a, f"{b} {c}", d, "clean text", f"{a} {b}"]
    got = find_contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), width=4)
    want = [(0, 6, 3, "1,2", True), (1, 12, 2, "1", True), (2, 6, 1, "", True), (3, 0, 0, "", False), (4, 12, 3, "1,2", True)]
    assert [(r["doc_id"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.orderBy("doc_id").collect()] == [
        (i, n, k, hashlib.sha256(ids.encode()).hexdigest(), hit) for i, n, k, ids, hit in want
    ]


def plain_near(texts, items, width, slack):
    windows = {tuple(w[i : i + width]) for _, t in items if (w := t.split()) for i in range(max(1, len(w) - width + 1))}
    out = []
    for i, t in enumerate(texts):
        w, near = t.split(), 0
        for window in windows:
            n = len(window)
            near += any(
                sum(window[k] in w[max(p + k - slack, 0) : max(p + k + slack + 1, 0)] for k in range(n)) >= n - n // 5
                for p in range(-n - slack, len(w) + slack)
            )
        out.append((i, near))
    return out


def test_near_passages_match_brute_force(spark):
    pick = random.Random(12)
    items = [(i, " ".join(pick.choices(WORDS[:70], k=pick.choice([1, 3, 6, 25])))) for i in range(12)]
    items += [(20, " ".join(WORDS[70:80] + ["nowhere"] + WORDS[80:95]))]
    texts = [" ".join(pick.choices(WORDS[:70], k=40)) for _ in range(10)] + [" ".join(WORDS[70:80] + WORDS[80:95])]
    for _, t in items:
        w = t.split()
        texts.append(" ".join("other" if k % 5 == 2 else x for k, x in enumerate(w)))
        texts.append("start " + " ".join(f"{x} more" if k % 4 == 1 else x for k, x in enumerate(w)))
    got = find_contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), slack=2)
    rows = [(r["doc_id"], r["n_near"]) for r in got.orderBy("doc_id").collect()]
    assert rows == plain_near(texts, items, 10, 2)
    assert rows[10][1] > 0 and rows[-1][1] > 0 and rows[-2][1] > 0


# --- nearest neighbours


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 4)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 3)
    pick = np.random.RandomState(12)
    vectors = [pick.randint(-2, 3, 4).astype(float).tolist() for _ in range(150)] + [[1.0, 1.0, 1.0, 1.0]] * 60
    vectors += [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, rank string, score double")
    got = nearest_neighbours(df, F.col("vec_id") % 5 == 0, k=10, shard_rows=40)
    usable = {i: np.array(v) for i, v in enumerate(vectors) if i < 210 and any(v)}
    want = []
    for q in usable:
        if q % 5 == 0:
            best = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(usable[q], v))), i) for i, v in usable.items() if i != q)[:10]
            want += [(q, r, i, d) for r, (d, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_relaxed_search_visits_less(spark):
    pick = np.random.RandomState(13)
    matrix = np.concatenate([pick.normal(c, 0.3, (200, 3)) for c in pick.uniform(-9, 9, (10, 3))])
    ids = np.arange(len(matrix))
    tree = nearest.build_tree(matrix, ids, 16)
    exact, loose = (nearest.BlockSearch(tree, ids, matrix, matrix[::20], ids[::20], 10, f) for f in (1.0, 2.0))
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.found, loose.found)])
    assert loose.compared < exact.compared < 0.5 * len(matrix) * 100 and recall >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest_neighbours(df, F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]
    assert nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


# --- lattice


def test_lattice_sums_all_segmentations():
    pieces, weights = vocabulary(tokenizer_path("piece_bpe_32k.model"))
    lattice, number = Lattice(pieces, weights), {p: i for i, p in enumerate(pieces)}

    def total(word):
        if not word:
            return 1.0
        out = 0.0
        for j in range(1, len(word) + 1):
            if word[:j] in number:
                out += math.exp(weights[number[word[:j]]]) * total(word[j:])
            elif j == 1:
                out += math.exp(sum(weights[n] for n in lattice.byte_numbers(word[0]))) * total(word[1:])
        return out

    for word in ("the", "nation", "été", "x😀", "日本"):
        assert math.isclose(lattice.log_probability(word), math.log(total(WORD_START + word)), rel_tol=1e-9)
    counts = [0.0] * len(weights)
    lattice.expect("nation", 3, counts)
    assert math.isclose(sum(n * len(pieces[i]) for i, n in enumerate(counts) if n and i < len(pieces)), 3 * len("▁nation"), rel_tol=1e-6)
    assert lattice.log_probability("long" * 3000) < -1000


def test_base_scores_match_brute_force(spark, monkeypatch):
    from collections import Counter

    from footstats.llm import lattice

    monkeypatch.setattr(lattice, "HOT_WORDS", 5)
    pick = random.Random(14)
    texts = ODD + [" ".join(pick.choices(WORDS[:40], k=pick.randint(1, 30))) for _ in range(40)] + ["Never seen"]
    learn = F.col("doc_id") % 5 != 1
    got = {r["doc_id"]: r for r in score_documents(frame(spark, texts), learn, tokenizer_path("piece_bpe_32k.model")).collect()}
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w] + ["\n"] for t in texts]
    c = Counter(w for i, ws in enumerate(tokens) if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(tokens):
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert math.isclose(got[7]["score"], got[8]["score"], rel_tol=1e-12)
    assert score_documents(frame(spark, []), learn, tokenizer_path("piece_bpe_32k.model")).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    pick = random.Random(15)
    texts = families(16, 12, 6) + ODD
    item = " ".join(WORDS[40:56])
    texts += [" ".join(pick.choices(WORDS, k=30)) + " " + item, " ".join(pick.choices(WORDS, k=60)) + " bar@dor.kis"]
    docs = frame(spark, texts, ["xx"] * len(texts)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, cut(stage(spark, now, str(tmp_path)))
        kept.append({r["doc_id"]: r for r in now.collect()})
        if name != "packing":
            assert now.columns == docs.columns and set(kept[-1]) <= {r["doc_id"] for r in before.collect()}
    language, copies, tests, personal, packed = kept
    assert {i for i, t in enumerate(texts) if not t or not re.search(r"[^\W\d_]", t)}.isdisjoint(language)
    rows = [(i, r["text"]) for i, r in sorted(language.items())]
    assert set(copies) == {d for d, _, c in plain_classes(rows, 5, 80) if d == c}
    assert set(copies) - set(tests) == {len(texts) - 2} & set(copies)
    assert "[email]" in personal[len(texts) - 1]["text"] and personal[len(texts) - 1]["n_chars"] == len(personal[len(texts) - 1]["text"])
    assert set(packed) == set(personal) == set(tests)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(now.collect())


def test_rows_of_null_ids_link_like_others(spark):
    base = WORDS[:40]
    near = [*base[:20], "other", *base[20:]]
    rows = [(7, " ".join(base)), (None, " ".join(near)), (None, " ".join(near)), (3, "quite another text of words"), (None, "a b c d e f g h"), (3, " ".join(base[:39]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similarity_classes(docs, width=3, percent=80).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [
        (-1, 6, -1), (-1, 39, 3), (-1, 39, 3), (3, 3, 3), (3, 37, 3), (7, 38, 3),
    ]


def test_near_copy_stage_keeps_rows_of_null_and_shared_ids(spark):
    base = " ".join(WORDS[:60])
    rows = [
        (7, base), (None, base + " more"), (None, "a text that no other row holds at all"), (3, "one more of its own kind here"), (3, "and a different one that shares the id"),
        (9, None), (10, ""), (11, " "), (5, base), (5, base), (None, "a text that no other row holds at all"),
    ]
    docs = spark.createDataFrame([(*r, None, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "-") for r in kept.collect()) == sorted([
        (5, base), (-1, "a text that no other row holds at all"), (3, "one more of its own kind here"), (3, "and a different one that shares the id"),
        (9, "-"), (10, "-"), (11, " "),
    ])
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), "").count() == 0


def test_decontamination_stage_tells_rows_apart(spark, tmp_path):
    item = " ".join(WORDS[40:56])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item}"), (None, "clean one"), (3, f"{item} y"), (3, "another clean one"), (4, None)]
    docs = spark.createDataFrame([(*r, None, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_test_items(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, "clean one"), (3, "another clean one"), (4, "")]
    assert kept.columns == docs.columns

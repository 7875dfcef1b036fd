"""Interval rules against golden rows and plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from footstats.functions import intervals as iv
from footstats.operators import intervals as ops
from footstats.operators import statistics as st
from footstats.plans.label_flow import raw_intervals, second_labels
from footstats.sources import schemas as sc

LISTS = "file string, matches array<struct<start:double,end:double>>, actives array<struct<start:double,end:double>>, standings array<struct<start:double,end:double>>"


def clamp_loop(children, parents):
    out = list(children)
    for ps, pe in parents:
        for i, (s, e) in enumerate(out):
            if s <= ps and ps <= e <= pe:
                out[i] = (ps, e)
            elif s >= ps and e >= pe and s <= pe:
                out[i] = (s, pe)
    return out


def gap_loop(lo, hi, children):
    if not children:
        return [(lo, hi)]
    c = sorted(children)
    out = [(lo, c[0][0])] if lo < c[0][0] else []
    out += [(a[1], b[0]) for a, b in zip(c, c[1:])]
    return out + ([(c[-1][1], hi)] if hi > c[-1][1] else [])


def all_kinds(match, active, standing):
    active = clamp_loop(active, match)
    standing = clamp_loop(standing, active)
    inside = lambda cs, p: [c for c in cs if p[0] <= c[0] <= c[1] <= p[1]]
    return {
        "Match": match, "Active": active, "Standing": standing,
        "Not Active": [g for p in match for g in gap_loop(*p, inside(active, p))],
        "Not Standing": [g for p in active for g in gap_loop(*p, inside(standing, p))],
        "Not Match": gap_loop(0.0, 30.0, match),
    }


def label_loop(kinds, step):
    every = [i for k in kinds.values() for i in k]
    lo, hi = min(s for s, _ in every), max(e for _, e in every)
    points, i = [], 0
    while lo + i * step < hi:
        points.append(lo + i * step)
        i += 1
    ends = points[1:] + [hi]
    cover = lambda k, p, q: int(any(s <= p and e >= q for s, e in kinds[k]))
    return [(p, *[cover(k, p, q) for k in ("Match", "Active", "Standing")]) for p, q in zip(points, ends)]


def random_interval(rng):
    s = rng.choice([rng.randint(0, 25), rng.uniform(0, 25)])
    return (float(s), float(s + rng.choice([1, 2, 7, rng.uniform(0, 9)])))


def test_clamp_golden(spark):
    cases = [((2, 10), (5, 10)), ((15, 25), (15, 20)), ((0, 30), (0, 30)), ((6, 8), (6, 8)), ((21, 25), (21, 25)), ((20, 25), (20, 20)), ((5, 20), (5, 20))]
    rows = [("f", [(5.0, 20.0)], [tuple(map(float, c)) for c, _ in cases], [])]
    got = ops.clamp_intervals(spark.createDataFrame(rows, LISTS)).first()
    assert [tuple(a) for a in got.actives] == [tuple(map(float, w)) for _, w in cases]


def test_clamp_strict(spark):
    rows = [("f", [(5.0, 20.0)], [(0.0, 30.0), (20.0, 25.0), (2.0, 10.0)], [])]
    got = ops.clamp_intervals(spark.createDataFrame(rows, LISTS), strict=True).first()
    assert [tuple(a) for a in got.actives] == [(5.0, 20.0), (20.0, 25.0), (5.0, 10.0)]


def test_complement_golden(spark):
    cases = [([(5, 20)], [(0, 5), (20, 30)]), ([], [(0, 30)]), ([(0, 10), (10, 30)], [(10, 10)]), ([(12, 14), (3, 4)], [(0, 3), (4, 12), (14, 30)])]
    for children, want in cases:
        df = spark.createDataFrame([("f", [tuple(map(float, c)) for c in children], [], [])], LISTS)
        got = df.select(iv.complement(F.lit(0.0), F.lit(30.0), F.col("matches")).alias("g")).first().g
        assert [tuple(g) for g in got] == want


def test_discretize_golden(spark):
    rows = [
        ("a", [("Match", 0.0, 3.0), ("Active", 0.0, 1.5)]),
        ("b", [("Match", 0.0, 1.5), ("Match", 1.5, 3.0)]),
        ("c", [("Match", 2.0, 2.0)]),
    ]
    got = ops.discretize(spark.createDataFrame(rows, sc.INTERVALS), 1).orderBy("file", "time").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0.0, 1, 1, 0), ("a", 1.0, 1, 0, 0), ("a", 2.0, 1, 0, 0),
        ("b", 0.0, 1, 0, 0), ("b", 1.0, 0, 0, 0), ("b", 2.0, 1, 0, 0),
    ]


@pytest.mark.parametrize("step", [1, 5])
def test_whole_flow_random(spark, step, tmp_path):
    rng = random.Random(step)
    tasks, want_kinds, want_labels = [], [], []
    for n in range(40):
        lists = {k: [random_interval(rng) for _ in range(rng.randint(0, 3))] for k in ("Match", "Active", "Standing")}
        results = [
            {"origin": "manual", "value": {"start": s, "end": e, "labels": [k]}} for k, i in lists.items() for s, e in i
        ] + [{"origin": "manual", "value": {"start": 1.0, "end": 2.0, "labels": ["Unsure"]}}]
        rng.shuffle(results)
        lists = {k: [(r["value"]["start"], r["value"]["end"]) for r in results if r["value"]["labels"][0] == k] for k in lists}
        file = f"data/clips/mat_01/{n:04d}.mp4"
        tasks.append({"id": n, "annotations": [{"result": results}], "data": {"video_url": f"http://localhost:8080/{file}"}})
        kinds = all_kinds(lists["Match"], lists["Active"], lists["Standing"])
        want_kinds += [(file, k, *map(float, i)) for k, i_s in kinds.items() for i in i_s]
        want_labels += [(file, *r) for r in label_loop(kinds, step)]
    tasks.append({"id": 99, "annotations": [], "data": {"video_url": "http://localhost:8080/a/b/c/none.mp4"}})
    (tmp_path / "export.json").write_text(json.dumps(tasks))
    from footstats.sources.readers import read_json_array

    export = read_json_array(spark, str(tmp_path / "export.json"), sc.ANNOTATION_EXPORT)
    got = ops.intervals_long(raw_intervals(export)).collect()
    assert sorted(map(tuple, got)) == sorted(want_kinds)
    labels = sorted(map(tuple, second_labels(export, step).collect()))
    assert len(labels) == len(want_labels)
    for a, b in zip(labels, sorted(want_labels)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2:] == b[2:]


@pytest.mark.parametrize("width", [2, 64])
def test_join_covering(spark, width):
    rng = random.Random(width)
    ivs = [(rng.choice("ab"), *random_interval(rng)) for _ in range(60)]
    pts = [(k, float(t), t + rng.choice([0.5, 1.0])) for k in "abc" for t in range(30)]
    got = ops.join_covering(
        spark.createDataFrame(pts, "file string, time double, next_time double"),
        spark.createDataFrame(ivs, "file string, start double, end double"),
        width=width,
    ).select("file", "time", "next_time", "start", "end")
    want = [(k, t, n, s, e) for k, t, n in pts for f, s, e in ivs if f == k and s <= t and e >= n]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_discretize_a_recording_of_many_intervals(spark, monkeypatch):
    """20 000 short intervals and some long ones: work grows with points and intervals, not with their product."""
    rng = random.Random(4)
    labels = ["Match", "Active", "Standing", "Not Match"]
    spans = [(rng.choice(labels), s, s + rng.choice([0.5, 1.0, 2.5, 7.0])) for s in (i * 1.25 for i in range(20_000))]
    spans += [("Match", 100.0, 20_000.0), ("Active", 0.25, 60.0), ("Standing", 24_000.0, 25_010.0)]
    nested = spark.createDataFrame([("f", spans)], "file string, annotations array<struct<labels:string,start:double,end:double>>")
    got = {r.time: (r.is_match, r.is_active, r.is_standing) for r in ops.discretize(nested, 1).collect()}
    end = max(e for _, _, e in spans)
    assert len(got) == math.ceil(end)
    furthest, at = dict.fromkeys(labels, -1.0), 0
    ordered = sorted(spans, key=lambda x: x[1])
    for t in range(math.ceil(end)):
        while at < len(ordered) and ordered[at][1] <= t:
            furthest[ordered[at][0]] = max(furthest[ordered[at][0]], ordered[at][2])
            at += 1
        assert got[float(t)] == tuple(int(furthest[x] >= min(t + 1, end)) for x in labels[:3])


@pytest.mark.parametrize("widths", [(8, 4, 2), (1,), (5, 3)])
def test_discretize_in_small_pieces(spark, monkeypatch, widths):
    monkeypatch.setattr(ops, "PIECE_POINTS", widths)
    rng = random.Random(sum(widths))
    rows = [(f"f{k}", [(rng.choice(["Match", "Active", "Standing"]), *random_interval(rng)) for _ in range(k)]) for k in range(12)]
    nested = spark.createDataFrame(rows, "file string, annotations array<struct<labels:string,start:double,end:double>>")
    got = {(r.file, r.time): (r.is_match, r.is_active, r.is_standing) for r in ops.discretize(nested, 2).collect()}
    want = {}
    for f, spans in rows:
        if spans:
            low, end = min(s for _, s, _ in spans), max(e for _, _, e in spans)
            for i in range(math.ceil((end - low) / 2)):
                t, n = low + i * 2, min(low + (i + 1) * 2, end)
                want[f, t] = tuple(int(any(x == l and s <= t and e >= n for x, s, e in spans)) for l in ("Match", "Active", "Standing"))
    assert got == want


def test_interval_cells_are_few_and_partition_the_interval(spark):
    rng = random.Random(8)
    spans = [(a, a + n) for a, n in [(-70, 200), (0, 0), (5, -1), (0, 511), (1, 510), (0, 8 * 512)] + [(rng.randint(-999, 999), rng.randint(0, 700)) for _ in range(60)]]
    df = spark.createDataFrame(spans, "a long, b long")
    for levels, fan in ((1, 8), (3, 8), (4, 2)):
        for r in df.withColumn("cells", ops.interval_cells(F.col("a"), F.col("b"), levels, fan)).collect():
            covered = sorted(x for level, cell in r.cells for x in range(cell * fan**level, (cell + 1) * fan**level))
            assert covered == list(range(r.a, r.b + 1))
    hours = spark.createDataFrame([(s, s + 7 * 3600.0) for s in (0.0, 63.0, 1000.0, 30000.5)], "start double, end double")
    base = [F.floor(F.col(c) / 64) for c in ("start", "end")]
    assert hours.select(F.max(F.size(ops.interval_cells(*base, 4, 8)))).first()[0] < 50


def test_label_statistics(spark):
    rows = [("f", 0, 1, 1, 0), ("f", 1, 1, 0, 0), ("g", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, sc.SECOND_LABELS)
    r = st.label_rates(df).first()
    assert (r.pct_match, r.pct_active, r.pct_standing) == (0.667, 0.5, 0.0)
    assert st.label_rates(df.where("is_match = 0")).first().pct_active is None
    assert [tuple(x) for x in st.label_combo_counts(df).collect()] == [(1, 1, 0, 1), (1, 0, 0, 1), (0, 0, 0, 1)]
    assert st.distinct_count(df, ["file"]).first().distinct_count == 2
    d = {x.column: x for x in st.describe_cols(df, ["is_match"]).collect()}["is_match"]
    assert (d["count"], round(d["mean"], 4), d["min"], d["max"]) == (3, 0.6667, 0.0, 1.0)

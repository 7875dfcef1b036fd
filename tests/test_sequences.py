"""Chunked sequence operators against plain Python loops, with chunks far smaller than the data."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from footstats.operators import clock as ck
from footstats.operators import matches as mt
from footstats.operators import motion as mo
from footstats.operators.quantiles import exact_quantile
from footstats.operators.sequences import nearest_marks, spread_over_chunks, with_global_position, with_halo, with_position

SIZES = [1, 4, 7, 1000]


def series(rng, n, kinds):
    return [rng.choice(kinds) for _ in range(n)]


def frame_df(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(5)


def by_video(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_with_position(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), t) for t in rng.sample(range(300), 90)]
    df = frame_df(spark, rows, "video string, t long")
    got = with_position(df, ["video"], ["t"], F.floor(F.col("t") / width)).collect()
    want = {(v, t): i for v, g in by_video(rows).items() for i, (_, t) in enumerate(g)}
    assert {(r.video, r.t): r.pos for r in got} == want


def test_with_global_position(spark):
    names = [f"/mnt/videos/recording {i * 7919 % 1000:03d}.mp4" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "path string").repartition(6)
    got = {r.path: r.pos for r in with_global_position(df, ["path"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


@pytest.mark.parametrize("size", SIZES)
def test_with_halo_row_and_range_frames(spark, size):
    rng = random.Random(size)
    rows = [(v, i, rng.random()) for v, n in (("a", 40), ("b", 3)) for i in range(n)]
    df = frame_df(spark, rows, "video string, frame long, x double")

    def cols(w):
        return {
            "lag2": F.lag("x", 2).over(w),
            "mean": F.avg("x").over(w.rowsBetween(-3, 2)),
            "n": F.count("x").over(w.rangeBetween(-3, 2)),
        }

    got = {(r.video, r.frame): r for r in with_halo(df, ["video"], "frame", 3, 2, cols, size).collect()}
    assert len(got) == len(rows)
    for v, g in by_video(rows).items():
        xs = [x for _, _, x in g]
        for i in range(len(xs)):
            r, span = got[v, i], xs[max(0, i - 3) : i + 3]
            assert r.lag2 == (xs[i - 2] if i >= 2 else None)
            assert r.n == len(span) and math.isclose(r["mean"], sum(span) / len(span))


@pytest.mark.parametrize("size", SIZES)
def test_nearest_marks(spark, size):
    rng = random.Random(size)
    rows = [(v, i, rng.choice([None, None, None, 1.0, 2.0])) for v, n in (("a", 50), ("b", 5), ("c", 1)) for i in range(n)]
    df = frame_df(spark, rows, "video string, frame long, x double")
    got = nearest_marks(df, ["video"], "frame", F.col("x").isNotNull(), ["x"], size=size).collect()
    got = {(r.video, r.frame): r for r in got}
    for v, g in by_video([(a, b, -1.0 if c is None else c) for a, b, c in rows]).items():
        known = [(i, x) for _, i, x in g if x != -1.0]
        for _, i, _ in g:
            r = got[v, i]
            assert (r.prev and tuple(r.prev)) == max((k for k in known if k[0] <= i), default=None)
            assert (r.next and tuple(r.next)) == min((k for k in known if k[0] >= i), default=None)
            assert (r.first_pos, r.last_pos) == (0, len(g) - 1)


@pytest.mark.parametrize("size", SIZES)
def test_spread_over_chunks(spark, size):
    rows = [("a", i, float(i)) for i in range(30)] + [("b", 0, 5.0)]
    df = frame_df(spark, rows, "video string, frame long, x double")
    got = spread_over_chunks(df, ["video"], "frame", {"m": (F.max, F.col("x")), "s": (F.sum, F.col("x"))}, size)
    assert {(r.video, r.m, r.s) for r in got.collect()} == {("a", 29.0, 435.0), ("b", 5.0, 5.0)}
    assert got.count() == 31


def test_rows_without_key_or_position_are_kept(spark):
    rows = [("a", 0, 1.0), ("a", None, 2.0), (None, 0, 3.0), (None, None, 4.0), ("a", 1, None)]
    df = spark.createDataFrame(rows, "video string, frame long, x double")
    assert with_position(df, ["video"], ["frame"], F.col("frame"), "n").count() == 5
    assert nearest_marks(df, ["video"], "frame", F.col("x").isNotNull(), ["x"], size=1).count() == 5
    halo = with_halo(df, ["video"], "frame", 1, 1, lambda w: {"l": F.lag("x").over(w)}, 1)
    assert sorted((r.video or "", -1 if r.frame is None else r.frame, r.l) for r in halo.collect() if r.video and r.frame is not None) == [("a", 0, None), ("a", 1, 1.0)]
    assert halo.count() == 5
    assert spread_over_chunks(df, ["video"], "frame", {"m": (F.max, F.col("x"))}, 1).count() == 5


# --- clock ------------------------------------------------------------------------------


def clock_cases():
    """Every minute and second in two spellings, and texts that no clock shows."""
    cases = {None: (False, None, None), "": (False, None, None)}
    for minute in range(0, 125, 3):
        for second in range(0, 100, 7):
            good = minute < 100 and second < 60
            want = (True, minute, second) if good else (False, None, None)
            for text in (f"{minute}:{second:02d}", f" {minute} : {second:02d}\nscore {second}", f"\n\n{minute}: {second:02d} \n"):
                cases[text] = want
    for left, right in (("x", "10"), ("1", "y"), ("7", "123"), ("12", "3"), ("", "15"), ("5", "")):
        cases[f"{left}:{right}"] = (False, None, None)
    cases["8:\n15"] = cases["no digits"] = (False, None, None)
    return cases


def test_parse_clock_rule(spark):
    cases = clock_cases()
    df = spark.createDataFrame([(t,) for t in cases], "raw_text string")
    got = {r.raw_text: r for r in ck.parse_clock(df).collect()}
    for text, (ok, m, s) in cases.items():
        r = got[text]
        assert (r.available, r.minutes, r.seconds) == (ok, m, s), text
        assert r.time_seconds == (None if m is None else m * 60 + s)


def fill_loop(values, fps):
    """Plain restatement of the filling rule."""
    out, i = [None if v is None else float(v) for v in values], 0
    while i < len(values):
        if values[i] is not None:
            i += 1
            continue
        j = i
        while j < len(values) and values[j] is None:
            j += 1
        if i > 0 and j < len(values):
            a, b, n = values[i - 1], values[j], j - i
            for k in range(n):
                held = n / fps > b - a or n == 1
                out[i + k] = float(a) if held else a + (b - a) * k / (n - 1)
        i = j
    return out


def test_fill_clock_golden(spark):
    _ = None
    golden = [
        ([10, _, _, 9], [10, 10, 10, 9]), ([10, _, _, 20], [10, 10, 20, 20]),
        ([10, _, _, _, 20], [10, 10, 15, 20, 20]), ([10, _], [10, None]), ([_, 10], [None, 10]),
    ]
    rows = [(str(g), i, x) for g, (xs, _w) in enumerate(golden) for i, x in enumerate(xs)]
    got = ck.fill_clock(frame_df(spark, rows, "video string, frame long, time_seconds int"), 4, size=2)
    found = {(r.video, r.frame): r.time_seconds_filled for r in got.collect()}
    for g, (xs, want) in enumerate(golden):
        assert [found[str(g), i] for i in range(len(xs))] == want


@pytest.mark.parametrize("size", SIZES)
def test_clock_chain_random(spark, size):
    rng = random.Random(size)
    data = {v: series(rng, n, [None, None, 5, 6, 7, 30]) for v, n in (("a", 60), ("b", 9), ("c", 2))}
    rows = [(v, i, x) for v, xs in data.items() for i, x in enumerate(xs)]
    df = frame_df(spark, rows, "video string, frame long, time_seconds int")
    filled = ck.fill_clock(df, 3, size=size)
    smooth = ck.smooth_clock(filled, 4, size=size)
    runs = ck.suppress_short_runs(smooth, [2, 3, 5], size=size)
    got = {(r.video, r.frame): r for r in runs.collect()}
    for v, xs in data.items():
        want = fill_loop(xs, 3)
        means = []
        for i in range(len(xs)):
            span = want[i - 2 : i + 2] if i >= 2 else []
            means.append(sum(span) / 4 if len(span) == 4 and None not in span else None)
        signs = [
            -1 if i and means[i] is not None and means[i - 1] is not None and round(means[i] - means[i - 1], 9) < 0 else 0
            for i in range(len(xs))
        ]
        for n in (2, 3, 5):
            held, i = signs[:], 0
            while i < len(held):
                j = i
                while j < len(held) and signs[j] == 0:
                    j += 1
                if j > i and j - i < n:
                    held[i:j] = [-1] * (j - i)
                i = max(j, i + 1)
            assert [got[v, i][f"direction_over{n}frames"] for i in range(len(xs))] == held
        for i in range(len(xs)):
            assert got[v, i].time_seconds_filled == pytest.approx(want[i])
            assert got[v, i].time_seconds_smooth == pytest.approx(means[i])


def test_short_runs_golden(spark):
    flags = [-1, 0, 0, -1, 0, 0, 0, -1]
    df = frame_df(spark, [("v", i, x) for i, x in enumerate(flags)], "video string, frame long, direction int")
    got = ck.suppress_short_runs(df, [3], size=3).orderBy("frame").collect()
    assert [r.direction_over3frames for r in got] == [-1, -1, -1, -1, 0, 0, 0, -1]


# --- matches ----------------------------------------------------------------------------


def plain_segments(flags, limit, cumulative=True):
    """The rule over runs: paused frames spent since the last match, and where a pause takes them above the limit."""
    runs = [(running, [i for i, _ in group]) for running, group in itertools.groupby(enumerate(flags), key=lambda x: bool(x[1]))]
    found, opened, spent = [], None, 0
    for running, frames in runs:
        if running:
            opened = frames[0] if opened is None else opened
            continue
        if not cumulative:
            spent = 0
        left = max(limit - spent, 0)  # paused frames the match may still take
        if opened is not None and len(frames) > left:
            found.append((opened, frames[left]))
            opened, spent = None, len(frames) - left - 1
        else:
            spent += len(frames)
    return found


def segments(spark, videos, limit, size, cumulative=True):
    rows = [(v, i, x) for v, xs in videos.items() for i, x in enumerate(xs)]
    df = frame_df(spark, rows, "video string, frame long, running int")
    got = mt.segment_matches(df, limit, size=size, cumulative_pause=cumulative).collect()
    out = {v: [] for v in videos}
    for r in sorted(got):
        out[r.video].append((r.start_frame, r.end_frame))
    return out


def test_segments_golden(spark):
    videos = {"a": [1, 0, 0, 0, 1], "b": [0, 0, 0, 1, 0], "c": [1, 0, 1, 0, 1, 0], "d": [1, 1, 0]}
    want = {"a": [(0, 3)], "b": [(3, 4)], "c": [(0, 5)], "d": []}
    for size in (1, 2, 100):
        assert segments(spark, videos, 2, size) == want


@pytest.mark.parametrize("size", [1, 3, 8, 1000])
@pytest.mark.parametrize("limit", [0, 1, 4])
def test_segments_random(spark, size, limit):
    rng = random.Random(size * 10 + limit)
    videos = {f"v{k}": series(rng, rng.randint(1, 60), [0, 1] if k % 3 else [0, 0, 0, 1]) for k in range(25)}
    assert segments(spark, videos, limit, size) == {v: plain_segments(x, limit) for v, x in videos.items()}


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
@pytest.mark.parametrize("limit", [0, 1, 3])
def test_segments_unbroken_pause(spark, size, limit):
    rng = random.Random(3 + size)
    videos = {f"v{k}": series(rng, 50, [0, 0, 0, 1] if k % 2 else [0, 1]) for k in range(20)}
    got = segments(spark, videos, limit, size, cumulative=False)
    assert got == {v: plain_segments(x, limit, False) for v, x in videos.items()}


@pytest.mark.parametrize("cumulative", [True, False])
def test_segments_over_several_levels_of_the_scan(spark, cumulative, monkeypatch):
    monkeypatch.setattr(mt, "FAN", 2)
    rng = random.Random(11)
    videos = {f"v{k}": [x for _ in range(40) for x in [rng.choice([0, 1])] * rng.randint(1, 9)] for k in range(4)}
    got = segments(spark, videos, 12, 5, cumulative)
    assert got == {v: plain_segments(x, 12, cumulative) for v, x in videos.items()}


def test_segments_with_missing_frames_and_flags(spark):
    rows = [("v", f, x) for f, x in [(10, 1), (11, None), (20, 0), (21, 0), (22, 1), (30, 1), (31, 0), (40, 0), (41, 0), (50, None)]]
    df = frame_df(spark, rows, "video string, frame long, running int")
    for size in (1, 4, 100):
        assert [(r.start_frame, r.end_frame) for r in mt.segment_matches(df, 2, size=size).orderBy("start_frame").collect()] == [(10, 21), (22, 41)]
    assert mt.segment_matches(df.limit(0), 2).collect() == []


def test_frame_runs(spark):
    rows = [("v", f, x) for f, x in [(0, 1), (1, 1), (2, 0), (3, None), (4, None), (6, None), (7, 0), (8, 0), (9, 0)]]
    got = mt.frame_runs(frame_df(spark, rows, "video string, frame long, running int"), size=8).orderBy("start").collect()
    assert [(r.chunk, r.start, r.frames, r.flag) for r in got] == [(0, 0, 2, 1), (0, 2, 1, 0), (0, 3, 2, None), (0, 6, 1, None), (0, 7, 1, 0), (1, 8, 2, 0)]


def test_rest_ratios(spark):
    rng = random.Random(5)
    flags = series(rng, 300, [0, 1])
    found = plain_segments(flags, 20)
    df = frame_df(spark, [("v", i, x) for i, x in enumerate(flags)], "video string, frame long, running int")
    segs = spark.createDataFrame([("v", s, e) for s, e in found], "video string, start_frame long, end_frame long")
    got = mt.rest_ratios(df, segs, width=16).orderBy("start_frame").collect()
    assert [(r.start_frame, r.count_zero, r.count_not_zero) for r in got] == [
        (s, flags[s:e].count(0), flags[s:e].count(1)) for s, e in found
    ]
    golden = mt.rest_ratios(
        frame_df(spark, [("v", i, x) for i, x in enumerate([1, 0, 0, 0, 1])], "video string, frame long, running int"),
        spark.createDataFrame([("v", 0, 3)], "video string, start_frame long, end_frame long"),
    ).first()
    assert (round(golden.zero_ratio, 4), round(golden.not_zero_ratio, 4)) == (0.6667, 0.3333)
    for size in (7, 64, 4096):  # runs cut elsewhere than the ranges
        again = mt.run_ratios(mt.frame_runs(df, size=size), segs, width=16).orderBy("start_frame").collect()
        assert list(map(tuple, again)) == list(map(tuple, got))
    mean = mt.mean_rest_ratio(mt.rest_ratios(df, segs)).first()
    assert mean.mean_zero_ratio == pytest.approx(sum(flags[s:e].count(0) / (e - s) for s, e in found) / len(found))


# --- motion -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", SIZES)
def test_motion_chain(spark, size):
    rng = random.Random(size)
    videos = {
        "a": [None if rng.random() < 0.4 else (rng.random() * 100, rng.random() * 100) for _ in range(70)],
        "tiny": [(rng.random() / 10, rng.random() / 10) for _ in range(8)],
        "none": [None] * 4,
    }
    rows = [(v, i, c and c[0], c and c[1]) for v, cs in videos.items() for i, c in enumerate(cs)]
    df = frame_df(spark, rows, "video string, frame long, cx double, cy double")
    moved = mo.intensity(mo.fill_gaps_locf(df, size=size), size=size)
    smooth = mo.rolling_mean(mo.boost_normalized(moved, size=size), "intensity_score", "smooth", 6, size=size)
    got = {(r.video, r.frame): r for r in smooth.collect()}
    for v, cs in videos.items():
        known = [c for c in cs if c]
        last, filled = (known[0] if known else (0.0, 0.0)), []
        for c in cs:
            last = c or last
            filled.append(last)
        score = [0.0] + [math.dist(p, q) for p, q in zip(filled, filled[1:])]
        if 0 < max(score) < 1:
            score = [s * 1000 for s in score]
        for i in range(len(cs)):
            span = score[max(0, i - 5) : i + 1]
            assert got[v, i].intensity_score == pytest.approx(score[i])
            assert got[v, i].smooth == pytest.approx(sum(span) / len(span))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.995, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(1)
    groups = {
        "same": [3.0] * 9, "mixed": [rng.uniform(-5, 5) for _ in range(101)], "one": [7.0],
        "small": [rng.random() * 1e-9 for _ in range(30)], "zeros": [0.0] * 50 + [1.0, 2.0], "steps": [float(i) for i in range(11)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None)]
    got = exact_quantile(frame_df(spark, rows, "g string, x double"), "x", q, ["g"], "out").collect()
    assert len(got) == len(groups)
    for r in got:
        xs = sorted(groups[r.g])
        k = q * (len(xs) - 1)
        lo, hi = xs[math.floor(k)], xs[math.ceil(k)]
        assert r.out == pytest.approx(lo + (hi - lo) * (k - math.floor(k)), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("small", [1, 3, 20])
def test_exact_quantile_divides_narrow_bands(spark, small):
    rng = random.Random(small)
    groups = {
        "clock": [1.7e12 + rng.randint(0, 86_400_000) for _ in range(200)], "copies": [5.5] * 150 + [5.5 + i * 1e-12 for i in range(50)],
        "below": [-1e300 * (1 + i * 1e-15) for i in range(99)], "tiny": [5e-324 * i for i in range(40)],
    }
    df = frame_df(spark, [(g, x, i) for g, xs in groups.items() for i, x in enumerate(xs)], "g string, x double, at long")
    for q in (0.1, 0.5, 0.995):
        got = exact_quantile(df, "x", q, ["g"], "out", extent="at", small=small).collect()
        assert {(r.g, r.at_first, r.at_last) for r in got} == {(g, 0, len(xs) - 1) for g, xs in groups.items()}
        for r in got:
            xs = sorted(groups[r.g])
            k = q * (len(xs) - 1)
            lo, hi = xs[math.floor(k)], xs[math.ceil(k)]
            assert r.out == pytest.approx(lo + (hi - lo) * (k - math.floor(k)), rel=1e-15, abs=1e-323)


def test_exact_quantile_without_groups(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"))
    assert exact_quantile(df, "x", 0.995, [], "q").first().q == pytest.approx(9.95)


@pytest.mark.parametrize("size", SIZES)
def test_major_actions(spark, size):
    xs = [float(i % 17) for i in range(200)]
    df = frame_df(spark, [("v", i, x) for i, x in enumerate(xs)] + [("flat", i, 0.0) for i in range(9)], "video string, frame long, smoothed_intensity double")
    got = mo.major_actions(df, q=0.8, step=3, size=size).collect()
    ordered = sorted(xs)
    k = 0.8 * 199
    limit = ordered[math.floor(k)] + (ordered[math.ceil(k)] - ordered[math.floor(k)]) * (k - math.floor(k))
    peaks = [i for i, x in enumerate(xs) if x > limit][::3]
    assert sorted(r.frame for r in got) == peaks and {r.video for r in got} == {"v"}

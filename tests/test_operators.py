"""Curation operators on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import columns, raster, recipes, svg
from quillon.operators import dedup, graph, sampling, scoring, similarity
from quillon.sources import scans
from quillon.streaming import events


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (999, 999)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {tuple(r) for r in graph.connected_components(df).collect()} == {(x, find(x)) for x in root}
    assert graph.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_band_pairs_match_all_pairs(spark, radius):
    rng = random.Random(radius)
    v = [rng.getrandbits(64) - (1 << 63) for _ in range(80)]
    v += [x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(radius + 3))) for x in v[:60]]
    df = spark.createDataFrame([*enumerate(v), (900, None)], "id long, h long")
    want = {(i, j, d) for i in range(len(v)) for j in range(i + 1, len(v)) if (d := bin((v[i] ^ v[j]) & (2**64 - 1)).count("1")) <= radius}
    assert {tuple(r) for r in similarity.band_pairs(df, radius).collect()} == want


@pytest.mark.parametrize("plan", [(1, 2), (2, 1), (3, 0), None])
def test_near_values_by_any_plan(spark, plan):
    rng = random.Random(7)
    v = sorted({rng.getrandbits(64) - (1 << 63) for _ in range(40)})
    w = sorted({x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(5))) for x in v} | {-1, 0})
    df = lambda x: spark.createDataFrame([(i,) for i in x], "v long")
    gap = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    got = similarity.near_values(df(v), df(w), 2, plan).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, gap(a, b)) for a in v for b in w if gap(a, b) <= 2)


def test_gate_with_a_radius_layer(spark):
    """Leaks and repeats by distance alone, the order of the layers, and records without a fingerprint."""
    rows = [(1, "bench", "e1", "n1", 0b0), (2, "train", "e2", "n2", 0b1111), (3, "val", "e3", "n3", 0xFF00), (4, "corpus", "e4", "n4", 0xFF03), (5, "train", "e5", "n5", 0x7F << 40), (6, "train", "e5", "n6", 0x7F << 40)]
    rows += [(7, "train", "e7", "n5", 0x3FF << 50), (8, "train", "e8", "n8", 0x1F << 40), (9, "train", "e9", "n9", 0x7F3 << 36), (10, "train", "e10", "n10", None), (11, "corpus", "e11", "n11", None), (12, "test", "e12", "n12", 0xFFFF << 46)]
    df = spark.createDataFrame(rows, "ord long, split string, exact string, norm string, phash long").repartition(3)
    fate = {r.ord: r.fate for r in similarity.layered_gate(df, ["exact", "norm"], fingerprint="phash", radius=4).collect()}
    assert fate == {1: "reference", 2: "bench", 3: "reference", 4: "held-out", 5: "kept", 6: "exact", 7: "norm", 8: "phash", 9: "phash", 10: "kept", 11: "kept", 12: "reference"}
    assert {r.ord: r.fate for r in similarity.layered_gate(df, ["exact", "norm"]).collect()}[2] == "kept"


def test_containing_whole_texts(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, say(rng.randrange(1, 60))) for i in range(60)] + [(98, ""), (99, None)]
    refs = [(i, say(rng.randrange(1, 12))) for i in range(30)] + [(30, docs[5][1]), (31, ""), (32, None), (33, docs[7][1] + " a")]
    df = lambda rows: spark.createDataFrame(rows, "ord long, norm_text string").repartition(3)
    want = {(i, j) for i, t in docs for j, u in refs if t and u and f" {u} " in f" {t} "}
    assert {tuple(r) for r in similarity.containing(df(docs), df(refs), words=4).collect()} == want
    assert similarity.containing(df(docs), df(refs).limit(0)).count() == 0


def test_fingerprints_from_images(spark):
    rng = np.random.default_rng(2)
    base = np.minimum(rng.uniform(0, 320, (16, 16)), 255)  # a fifth is white, so not nearly all is ink
    bits = lambda h: bin(h & (2**64 - 1)).count("1")
    images = [(1, base), (2, np.clip(base + 3, 0, 255)), (3, np.minimum(rng.uniform(0, 320, (16, 16)), 255)), (4, np.full((16, 16), 255.0)), (5, np.zeros((16, 16))), (6, rng.uniform(0, 9, (3, 3)))]
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in images] + [(7, None), (8, [1.0, 2.0])], "id int, gray array<double>")
    got = {r.id: r for r in similarity.fingerprints(df).collect()}
    assert bits(got[1].phash ^ got[2].phash) <= 6 < bits(got[1].phash ^ got[3].phash)
    assert [got[i].degenerate for i in range(1, 9)] == [False, False, False, True, True, False, False, False] and [got[i].render_ok for i in range(1, 9)] == [True] * 5 + [False] * 3
    assert all(got[i].phash is None for i in range(4, 9))
    m = similarity.dct_matrix(16)
    assert np.allclose(m @ m.T, np.eye(16))
    c = (m[:8] @ base @ m[:8].T).ravel()
    want = int("".join("1" if v > sorted(c[1:])[31] else "0" for v in c), 2)
    assert got[1].phash & (2**64 - 1) == want


def test_running_sums_and_quantiles(spark):
    from quillon.operators import prefix

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(9)) for _ in range(400)] + [("c", 5, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, g string, k long, v long").repartition(6)
    got = {r.i: r.v_upto for r in prefix.running(df, [F.desc("k"), "i"], ["v"], ["g"]).collect()}
    for i, (g, k, _) in enumerate(rows):
        assert got[i] == sum(w for j, (h, l, w) in enumerate(rows) if h == g and (-l, j) <= (-k, i))
    assert sorted((r.i, r.rank) for r in prefix.numbered(df, ["k", "i"]).collect()) == sorted((i, n + 1) for n, (_, i) in enumerate(sorted((r[1], i) for i, r in enumerate(rows))))
    q = {r.g: (r.p0, r.p37, r.p100) for r in prefix.quantiles(df, "k", {"p0": 0.0, "p37": 0.37, "p100": 1.0}, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        own = [k for h, k, _ in rows if h == g]
        assert q[g] == pytest.approx(tuple(np.percentile(own, p) for p in (0, 37, 100)))
    assert prefix.quantiles(df, "k", {"m": 0.5}).first().m == np.median([r[1] for r in rows]) and prefix.running(df.limit(0), ["k"], ["v"]).count() == 0


def test_runs_are_stamped_and_tailed(spark):
    ev = [("a", 1, "status"), ("a", 2, "start"), ("a", 3, "metric"), ("a", 4, "start"), ("a", 5, "metric"), ("b", 1, "start"), ("b", 2, "metric"), ("c", 9, "metric")]
    df = spark.createDataFrame(ev, "s string, seq long, type string").repartition(4)
    runs = events.stamped(df, "s", "seq", F.col("type") == "start")
    assert {(r.s, r.seq): r.run for r in runs.collect()} == {("a", 1): "a#0", ("a", 2): "a#1", ("a", 3): "a#1", ("a", 4): "a#2", ("a", 5): "a#2", ("b", 1): "b#1", ("b", 2): "b#1", ("c", 9): "c#0"}
    assert {(r.s, r.seq) for r in events.cleared(runs, "s").collect()} == {("a", 4), ("a", 5), ("b", 1), ("b", 2), ("c", 9)}
    lines = spark.createDataFrame([("x", 1, "go"), ("x", 2, "job exited rc=0"), ("x", 3, "more"), ("y", 1, "a"), ("y", 2, None)], "log string, n long, line string")
    assert sorted((r.log, r.n) for r in events.tailed(lines, "log", "n", "line").collect()) == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]
    assert sorted((r.log, r.n) for r in events.tailed(lines, "log", "n", "line", seen=1).collect()) == [("x", 2), ("y", 2)]


def test_clusters_chain_and_equal_hashes(spark):
    df = spark.createDataFrame([(1, 0), (2, 0b1111), (3, 0b11111111), (4, 0), (5, -1), (6, None)], "id long, h long")
    assert {tuple(r) for r in similarity.hamming_clusters(df, 4).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_gate_priority_and_first_wins(spark):
    rows = [(1, "train", "a", "x"), (2, "bench", "a", "q"), (3, "val", "z", "x"), (4, "train", "b", "x"), (5, "train", "c", "m"), (6, "corpus", "c", "m"), (7, "train", "d", "m"), (8, "train", "e", None)]
    df = spark.createDataFrame(rows, "ord long, split string, exact string, norm string").repartition(3)
    fate = {r.ord: r.fate for r in similarity.layered_gate(df, ["exact", "norm"]).collect()}
    assert fate == {1: "bench", 2: "reference", 3: "reference", 4: "held-out", 5: "kept", 6: "exact", 7: "norm", 8: "kept"}
    assert [r.ord for r in dedup.keep_first(df, ["exact"], "ord").orderBy("ord").collect()] == [1, 3, 4, 5, 7, 8]


def test_scratch_drops_what_was_stored_within(spark):
    from quillon.session import Scratch, store

    outside = store(spark.range(3))
    with Scratch() as scratch:
        inner = store(spark.range(5))
        kept = scratch.keep(store(inner.df.where("id > 1")))
    assert outside.df.count() == 3 and kept.df.count() == 3
    with pytest.raises(Exception):
        inner.df.count()


def test_sampling_is_stable_and_checks_the_pool(spark):
    df = spark.range(100).toDF("id")
    a = [r.id for r in sampling.sample(df, "id", 10, 3).collect()]
    assert a == [r.id for r in sampling.sample(df.repartition(7), "id", 10, 3).collect()] and len(set(a)) == 10
    drawn = sampling.sample(df, "id", 10, 3)
    assert sorted(r.id for i in range(3) for r in sampling.shard_slice(drawn, i, 3).collect()) == sorted(a)
    with pytest.raises(ValueError):
        sampling.sample(df, "id", 101, 3)


def test_auc_and_threshold_edges(spark):
    one = spark.createDataFrame([(0.5, 1), (0.7, 1)], "p double, y int")
    assert scoring.roc_auc(one).first().auc is None
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int")
    assert scoring.roc_auc(tied).first().auc == 0.5
    assert scoring.poison_threshold(spark.createDataFrame([(0.1, 1), (0.2, 0), (0.9, 1)], "p double, y int")).first().threshold == 0.1


DRAWINGS = {
    "clean": ('<svg viewBox="0 0 10 10"><rect fill="red"/></svg>', "clean", [], []),
    "broken": ("<svg", "reject", ["parse-error"], []),
    "html": ("<p/>", "reject", ["not-svg"], []),
    "huge": ("x" * 200_001, "reject", ["huge"], []),
    "script": ('<svg viewBox="0 0 9 9"><script/><rect onload = "x"/></svg>', "reject", ["script"], []),
    "sizeless": ("<svg><rect/></svg>", "reject", ["no-size"], []),
    "zero": ('<svg width="0" height="5"><rect/></svg>', "reject", ["zero-size"], []),
    "empty": ('<svg viewBox="0 0 9 9"><g/></svg>', "reject", ["no-drawables"], []),
    "hidden": ('<svg viewBox="0 0 9 9"><rect opacity="0"/><path fill="none" d="M0 0"/></svg>', "reject", ["all-invisible"], ["low-occupancy"]),
    "away": ('<svg viewBox="0 0 9 9"><path d="M50 50 l1 1"/></svg>', "reject", ["off-canvas"], []),
    "moved": ('<svg viewBox="0 0 9 9"><g transform="scale(2)"><path d="M50 50 l1 1"/></g></svg>', "clean", [], []),
    "text": ('<svg viewBox="0 0 9 9"><style/><text/><svg/></svg>', "warn", [], ["css-block", "live-text", "nested-svg"]),
    "odd path": ('<svg viewBox="0 0 9 9"><path d="M0 0 Z 5"/></svg>', "reject", ["analyzer-error"], []),
}


def test_quality_tiers(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in DRAWINGS.items()] + [("null", None)], "name string, svg string")
    got = {r.name: (r.tier, r.reject, r.warn) for r in svg.classified(df).collect()}
    assert {k: got[k] for k in DRAWINGS} == {k: v[1:] for k, v in DRAWINGS.items()}


def test_segments():
    s, points = svg.segments("m1 1 2 0 h-1.50 C0 0 1 1 2 2 a1 1 0 0 0 1 0z")
    assert [x["cmd"] for x in s] == ["M", "L", "H", "C", "A", "Z"] and (2.0, 2.0) in points
    assert s[2]["decimals"] == [2] and s[1]["turn"] == pytest.approx(math.pi / 4) and s[5]["chord"] == pytest.approx(3)
    assert [x["cmd"] for x in svg.segments("M0 0 L1 1 2")[0]] == ["M", "L"] and svg.segments("5 5")[0] == []


def test_canonical_form():
    a = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:i="http://inkscape.org/x" id="q"><!-- c --><metadata/><path i:k="1" fill="#ABC" d="M1.04 2.00" /></svg>'
    b = '<svg xmlns="http://www.w3.org/2000/svg"><path d="M1.0 2" style="x" fill="#abc"/></svg>'
    assert svg.canonical(a) == svg.canonical(b) == "<svg><path d=M1 2 fill=#abc></path></svg>"
    assert svg.canonical("<svg <a id=\"x\">  <b>") == "<svg <a><b>" and svg.canonical(None) is None
    assert svg.rounded("0.25 -0.01 1234567.89") == "0.2 -0 1.23457e+06"
    assert svg.canonical('<a><b fill="#00000A"/><text x="1">words<desc>d</desc></text></a>') == "<a><b fill=#0A></b><text x=1></text></a>"
    assert svg.recoloured('<a fill="#f0F1ff" stroke="#abc" x="#1234567"/>', 20) == '<a fill="#ffffff" stroke="#abc" x="#1234567"/>' and svg.recoloured(None, 1) is None


def test_trace_features(spark):
    df = spark.createDataFrame([('<svg viewBox="0 0 10 10"><path d="M0 0 H5 V5 C1 1 2 2 3 3"/><circle id="Logo"/></svg>',), ("<",)], "svg string")
    f, bad = (r.asDict() for r in svg.traced_features(df).orderBy("parse_error").collect())
    assert f["path_frac"] == f["prim_frac"] == 0.5 and f["axis_frac"] == 1 and f["curve_frac"] == pytest.approx(1 / 3) and f["has_named_id"] == 1 and f["cmds_per_path"] == 4
    assert bad["parse_error"] == 1 and bad["n_paths"] == 0


def test_degradations_are_seeded_and_change_pixels():
    x = np.add.outer(np.arange(16) * 7, np.arange(16) ** 2 % 91).astype(float)
    for op in raster.OPS:
        y = raster.apply_op(op, x, 0.7, 5)
        assert y.shape == x.shape and (y == raster.apply_op(op, x, 0.7, 5)).all() and not np.allclose(y, x) and y.min() >= 0 and y.max() <= 255, op
    labels = np.arange(64.0).reshape(8, 8)
    assert set(raster.geometric_warp(labels, 0.5, np.random.default_rng(1), nearest=True).ravel()) <= set(labels.ravel())
    assert raster.noise_sigma(np.zeros((8, 8))) == 0 and raster.edge_ringing(np.zeros((8, 8))) == 0


def test_recipes_repeat():
    all_ = [recipes.sample_recipe(s) for s in range(400)]
    assert all_ == [recipes.sample_recipe(s) for s in range(400)]
    assert 0.05 < sum(r["global_severity"] == 0 for r in all_) / 400 < 0.2 and {r["family"] for r in all_} == set(recipes.FAMILIES)
    assert recipes.replay(np.ones((8, 8)) * 99, all_[3], 1).shape == (8, 8)


def test_jpeg_quality(spark):
    """A table made at a quality gives it back, within the rounding of the table's entries."""
    made = [(q, [float(v) for v in np.clip(np.floor((raster.LUMA_TABLE.ravel() * (5000 / q if q < 50 else 200 - 2 * q) + 50) / 100), 1, 255)]) for q in (20, 35, 50, 75, 90)]
    df = spark.createDataFrame([*made, (0, [57.625] * 64), (1, [1.0] * 64), (2, [300.0] * 64), (3, [1.0])], "q int, t array<double>")
    got = {r.q: r.v for r in df.select("q", columns.jpeg_quality("t").alias("v")).collect()}
    assert all(got[q] == pytest.approx(q, abs=0.7) for q, _ in made)
    assert got[0] == pytest.approx((200 - (5762.5 - 50) / 57.625) / 2) and got[1] == pytest.approx((200 - 50 / 57.625) / 2) and got[2] == pytest.approx(5000 / (29950 / 57.625)) and got[3] is None


def test_forensics_by_definition():
    rng = np.random.default_rng(3)
    noise = 128 + rng.normal(0, 10, (200, 200))
    assert raster.noise_sigma(noise) == pytest.approx(5.0, rel=0.05)  # half the deviation
    x = rng.uniform(0, 255, (12, 12))
    d = [(x[i, j] - x[i, j + 1] - x[i + 1, j] + x[i + 1, j + 1]) / 4 for i in range(11) for j in range(11)]
    m = sorted(d)[60]
    assert raster.noise_sigma(x) == pytest.approx(sorted(abs(v - m) for v in d)[60] / 0.6745)
    step = np.where(np.arange(64)[None] < 32, 0.0, 200.0) * np.ones((64, 1))
    step[31, 32] += 5  # one pixel bends more than the rest of the edge
    wave = step + 12 * np.sin(np.arange(64)[None] * 2) * (np.abs(np.arange(64)[None] - 32) < 6)
    assert raster.edge_ringing(wave) > 0 and raster.edge_ringing(np.zeros((8, 8))) == 0


def test_capture_operations_by_definition():
    from quillon.functions import capture

    rng = np.random.default_rng(5)
    x = np.floor(rng.uniform(0, 256, (12, 16, 3)))
    run = lambda op, **p: capture.replay(x, [{"op": op, "params": p}], 1)[0]
    assert (run("nearest_decimate", stride=3)[:, :, 0] == np.array([[x[i * 4 // 12 * 3, j * 6 // 16 * 3, 0] for j in range(16)] for i in range(12)])).all()
    assert (run("posterize", bits=3) == x // 32 * 32 + 16).all()
    assert (run("downscale_upscale", factor=0.5, down_filter="area", up_filter="nearest")[::2, ::2] == np.floor(x.reshape(6, 2, 8, 2, 3).mean((1, 3)))).all()
    assert len(np.unique(run("dither", n_colours=5).reshape(-1, 3), axis=0)) == 5
    assert (run("ink_bleed", mode="thicken", ksize=3, flip=0.0)[1, 1] == x[:3, :3].min((0, 1))).all()
    light = run("illumination", angle=0.0, strength=0.4)
    assert (light[:, 0] == np.floor(x[:, 0] * 0.8)).all() and np.allclose(light[:, 15], np.floor(np.clip(x[:, 15] * 1.2, 0, 255)), atol=1)
    shade = run("cast_shadow", poly=[[0, 0], [16, 0], [16, 12], [0, 12]], blur=0.5, opacity=0.25)
    assert (shade == np.floor(x * 0.75)).all()
    assert np.abs(run("jpeg_cycle", quality=98, subsampling=0) - x).mean() < 4 < np.abs(run("jpeg_cycle", quality=10, subsampling=2) - x).mean()
    for op in ("gaussian_noise", "poisson_noise"):
        grey = run(op, **({"std": 9} if op[0] == "g" else {"gain": 0.2}), gray=True) - x
        inside = (x > 80).all(2) & (x < 180).all(2)
        assert np.abs(np.ptp(grey[inside], axis=1)).max() <= 1
    turn = [[0, -1, 11], [1, 0, 0], [0, 0, 1]]  # a quarter turn of a square
    sq = x[:, :12]
    out, m = capture.replay(sq, [{"op": "geometric_warp", "params": {"matrix": turn}}], 1)
    assert (out == np.rot90(sq, -1)).all() and not capture.is_identity(m) and capture.is_identity(np.eye(3))
    label = np.arange(144).reshape(12, 12)
    assert (capture.warp_labels(label, m) == np.rot90(label, -1)).all()
    moved = capture.warp_labels(label + 1, np.array([[1, 0, 5], [0, 1, 0], [0, 0, 1.0]]))
    assert (moved[:, :5] == 0).all() and (moved[:, 5:] == label[:, :7] + 1).all()
    corners = np.array([[0, 0], [9, 0], [9, 9], [0, 9.0]])
    to = corners + rng.uniform(-1, 1, (4, 2))
    p = recipes.projection(corners, to) @ np.column_stack([corners, np.ones(4)]).T
    assert np.allclose(p[:2] / p[2], to.T)


def test_recipes_follow_their_families():
    drawn = [recipes.sample_recipe(s, 32) for s in range(4000)]
    for r in drawn:
        assert bool(r["ops"]) == (r["global_severity"] > 0)  # at severity 0 the image stays as it is
        names = [o["op"] for o in r["ops"]]
        own = [n for n in names if n != "sinc_ringing"]
        order = [op for _, op, _ in recipes.STEPS[r["family"]]]
        at = -1
        for n in own:
            at = order.index(n, at + 1)
        assert not {"posterize", "dither"} <= set(names) and set(names) <= set(recipes.capture.OPS)
    of = lambda f: [r for r in drawn if r["family"] == f and r["ops"]]
    share = lambda f, op: np.mean([any(o["op"] == op for o in r["ops"]) for r in of(f)])
    assert share("scan", "halftone") == pytest.approx(0.7, abs=0.08) and share("scan", "poisson_noise") == share("scan", "geometric_warp") == 1
    assert share("office_roundtrip", "posterize") == pytest.approx(0.32, abs=0.07) and share("office_roundtrip", "dither") == pytest.approx(0.3, abs=0.07)
    assert share("web_upscale", "sinc_ringing") == pytest.approx(0.6, abs=0.07) and share("mild", "sinc_ringing") == 0
    for r in of("jpeg_chain"):
        p = next(o["params"] for o in r["ops"] if o["op"] == "jpeg_chain")
        assert p["passes"] in (2, 3, 4) and len(p["qualities"]) == len(p["grid_shifts"]) == p["passes"] and p["grid_shifts"][0] == 0 and all(30 <= q <= 95 for q in p["qualities"])
    x = np.floor(np.random.default_rng(1).uniform(0, 256, (32, 32, 3)))
    for r in drawn[:40]:
        a, b = (recipes.replay(x, r, 9) for _ in range(2))
        assert (a == b).all() and (r["ops"] or (a == x).all())


def test_sources(spark, tmp_path):
    for name, sub in (("train-00000-of-00002", "a"), ("val-00001-of-00002", "a"), ("val-00001-of-00002", "b")):
        (tmp_path / sub).mkdir(exist_ok=True)
        spark.createDataFrame([(f"{name}.svg", "<svg/>")], "Filename string, Svg string").toPandas().to_parquet(tmp_path / sub / f"{name}.parquet")
    paths = scans.discover_shards(spark, str(tmp_path), 2)
    assert {r.split for r in scans.read_shards(spark, paths).collect()} == {"train", "val"}
    with pytest.raises(ValueError):
        scans.discover_shards(spark, str(tmp_path), 14)
    (tmp_path / "m.jsonl").write_text('{"sha": "a", "split": "val"}\n{"sha": "a", "split": "train"}\n')
    assert [tuple(r) for r in scans.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == [("a", "train")]
    (tmp_path / "manifests").mkdir()
    (tmp_path / "manifests" / "a.json").write_text("".join(f'{{"sha": "s{i % 50}", "split": "old{i}"}}\n' for i in range(3000)))  # larger, so it is planned first or last
    (tmp_path / "manifests" / "b.json").write_text('{"sha": "s7", "split": "val"}\nnot json\n')
    got = {r.sha: r.split for r in scans.read_manifest(spark, str(tmp_path / "manifests")).collect()}
    assert got["s7"] == "val" and got["s8"] == "old2958" and len(got) == 50
    assert [tuple(r) for r in scans.read_manifest(spark, str(tmp_path / "manifests"), spark.createDataFrame([("s9",)], "sha string")).collect()] == [("s9", "old2959")]
    assert sorted(r.doc for r in scans.off_split(spark.createDataFrame([(1, "train"), (2, "val"), (3, None)], "doc int, split string"), "split", "train", "doc").collect()) == [2, 3]
    scans.append_ledger(spark.createDataFrame([("x",), ("y",)], "sha string"), str(tmp_path / "ledger"))
    assert scans.read_ledger(spark, str(tmp_path / "ledger")).count() == 2
    for d, files in (("s1", ["clean.png", "wrecked_00.png"]), ("s2", ["clean.png"]), ("_s3", ["clean.png", "wrecked_00.png"]), ("s4", ["clean.png", "wrecked_01.png"])):
        (tmp_path / "set" / d).mkdir(parents=True)
        for f in files:
            (tmp_path / "set" / d / f).write_bytes(b"x")
    assert [r.name for r in scans.sample_dirs(spark, str(tmp_path / "set"), spark.createDataFrame([("s4",)], "name string")).collect()] == ["s1"]
    scans.write_tiers(spark.createDataFrame([("ab1", "clean", "<svg/>")], "sha string, tier string, svg string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/drawings")).first().prefix == "ab"
    assert scans.write_drawings(spark.createDataFrame([("ab1", "clean", "<svg/>"), ("cd2", "warn", "é")], "sha string, tier string, svg string"), str(tmp_path / "files")) == 2
    assert (tmp_path / "files/clean/ab/ab1.svg").read_text() == "<svg/>" and (tmp_path / "files/warn/cd/cd2.svg").read_text() == "é"
    drawn = [{r.path for r in scans.sample_drawings(spark, str(tmp_path / "files"), n, 5).collect()} for n in (0, 1, 9)]
    assert [len(x) for x in drawn] == [0, 1, 2] and drawn[1] < drawn[2]
    (tmp_path / "set/s1/palette.json").write_text('{"palette": [[255, 255, 255], [1, 2, 3]], "background_index": 1}')
    (tmp_path / "set/s4/palette.json").write_text('{"palette": [[9, 9, 9]]}')
    assert sorted(tuple(r) for r in scans.read_palettes(spark, str(tmp_path / "set")).collect()) == [("s1", 0, 255, 255, 255, False), ("s1", 1, 1, 2, 3, True), ("s4", 0, 9, 9, 9, True)]
    (tmp_path / "plan.json").write_text('{"comment": "c", "runs": [{"name": "a", "n": 5, "wreck": "x"}, {"name": "b", "lr": 0.1}]}')
    runs = scans.read_plan(spark, str(tmp_path / "plan.json")).orderBy("run").collect()
    assert [(r.run, r.name, r.n, r.lr) for r in runs] == [(1, "a", 5, None), (2, "b", None, 0.1)] and "wreck" in runs[0].settings
    ordered = scans.with_ord(spark.createDataFrame([(x,) for x in "dbca"], "k string"), "k")
    assert sorted((r.ord, r.k) for r in ordered.collect()) == list(enumerate("abcd"))


def test_event_streams(spark, tmp_path):
    log = tmp_path / "in"
    log.mkdir()
    lines = [f'{{"_run": "r{i % 2}", "_seq": {i}, "type": "{("metric", "sample", "status")[i % 3]}", "step": {i if i % 3 == 0 else "null"}, "elapsed_s": {i / 4}}}' for i in range(60)]
    (log / "a.json").write_text("\n".join(lines))
    q = events.write_log(events.read_events(spark, str(log)), str(tmp_path / "log"), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert spark.read.schema(events.EVENT).json(str(tmp_path / "log")).count() == 40
    q = events.live_retention(events.read_events(spark, str(log))).writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(90)
    assert {(r._run, r.n, r.last_seq) for r in spark.table("kept").collect()} == {("r0", 21, 58), ("r1", 21, 59)}
    q = events.live_throttle(events.read_events(spark, str(log))).writeStream.format("memory").queryName("slow").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(60)
    assert spark.table("slow").count() == 30


def test_labels_from_pixels():
    from quillon.functions import labels

    img = np.full((40, 40, 3), 255.0)
    img[5:20, 5:20], img[20:35, 20:35] = (200, 16, 16), (16, 16, 200)
    img[5:20, 20] = (232, 144, 144)  # between red and white
    label, palette = labels.labels_from_pixels(img)
    assert len(palette) == 3 and label[0, 0] == 0 and label[10, 10] != label[30, 30] and 0 not in (label[10, 10], label[30, 30])
    assert labels.labels_from_pixels(np.full((4, 4, 3), 255.0))[1].tolist() == [[255, 255, 255]]
    picks = [labels.background(palette, s) for s in range(300)]
    assert 0.3 < picks.count((255, 255, 255)) / 300 < 0.5 and all(np.linalg.norm(palette[1:] - np.array(p, float), axis=1).min() > 60 for p in picks)


def test_tier_recipes():
    for tier, ((least, most), (low, high), _) in recipes.TIERS.items():
        drawn = [recipes.tier_recipe(s, tier) for s in range(300)]
        assert all(least <= len(r) <= most and all(low <= x["severity"] <= high for x in r) for r in drawn)
    drawn = [recipes.tier_recipe(s, "medium", True) for s in range(600)]
    assert 0.07 < sum(not r for r in drawn) / 600 < 0.17


def kinds(spark, body, head=""):
    from quillon.functions import paint

    r = paint.painted(spark.createDataFrame([(f"<svg {head}>{body}</svg>",)], "svg string")).first()
    return r.cause, r.leaves and [(x.fill and tuple(x.fill), round(x.fill_alpha, 4), x.stroke and tuple(x.stroke), round(x.stroke_alpha, 4)) for x in r.leaves], r.fill_kinds, r.n_opaque, r.n_translucent


def test_paint_is_inherited(spark):
    assert kinds(spark, '<rect/><g fill="red" opacity=".5"><path style="fill: #0f0; stroke: currentColor" color="blue"/><circle fill-opacity="0.5"/></g>') == (None, [((0, 0, 0), 1.0, None, 0.0), ((0, 255, 0), 0.5, (0, 0, 255), 0.5), ((255, 0, 0), 0.25, None, 0.0)], ["opaque", "translucent", "translucent"], 1, 3)
    use = '<defs><rect id="a" fill="inherit"/><symbol id="b"><path/></symbol></defs><use href="#a" fill="navy"/><use href="#b" stroke="rgb(100%, 0%, 50.2%)" fill="none"/><use href="#no"/>'
    assert kinds(spark, use)[:2] == (None, [((0, 0, 128), 1.0, None, 0.0), (None, 0.0, (255, 0, 128), 1.0)])
    assert kinds(spark, '<animate fill="freeze"/><mask><rect/></mask><text fill="hsl(120, 100%, 50%)">a<tspan fill="#fafafaff">b</tspan></text>')[1:4] == ([((0, 255, 0), 1.0, None, 0.0), ((250, 250, 250), 1.0, None, 0.0)], ["opaque", "paper"], 1)


@pytest.mark.parametrize("body, cause", [("<style>a</style>", "css-block"), ('<rect fill="url(#g)"/>', "paint-server"), ('<rect fill="blurple"/>', "unknown-colour"), ("<g", "parse-error"), ('<g id="a"><use href="#a"/></g>', "use-cycle"), ('<rect opacity=".5"/>' * 33, "too-translucent"), ("".join(f'<rect fill="rgb(0,0,{i})"/>' for i in range(209)), "too-many-colours"), ("<style> </style>", None)])
def test_paint_that_cannot_be_told(spark, body, cause):
    assert kinds(spark, body)[0] == cause


def test_code_colours():
    from quillon.functions import paint

    codes = paint.code_colours().astype(int)
    assert len({tuple(c) for c in codes}) == len(codes) == 208 and tuple(codes[0]) == (0, 0, 0) and all(c.min() < 204 for c in codes)
    gap = [((codes[:i] - codes[i]) ** 2).sum(1).min() for i in range(1, 208)]
    assert gap == sorted(gap, reverse=True)


def shrunk(label, ink, f):
    h, w = ink.shape
    out, none = np.zeros((h, w), int), np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            n = np.bincount(label[y * f : y * f + f, x * f : x * f + f].ravel())
            out[y, x] = n.argmax()
            if not out[y, x] and ink[y, x]:
                none[y, x] = not n[1:].sum()
                out[y, x] = n[1:].argmax() + 1 if n[1:].sum() else 0
    done = out.copy()
    for y, x in zip(*np.nonzero(none)):
        near = [((y - v) ** 2 + (x - u) ** 2, v, u, out[v, u]) for v in range(h) for u in range(w) if out[v, u] and abs(v - y) <= 2 and abs(u - x) <= 2]
        done[y, x] = min(near)[3] if near else 0
    return done


def test_labels_are_shrunk_and_settled(spark):
    from quillon.operators import labelmaps

    rng = np.random.default_rng(4)
    label = np.where(rng.random((24, 24)) < 0.12, rng.integers(1, 5, (24, 24)), 0)
    label[12:] = 0
    ink = rng.random((8, 8)) < 0.6
    fine = spark.createDataFrame([(1, y, x, int(label[y, x])) for y in range(24) for x in range(24)], "vec_id long, y long, x long, label int")
    inked = spark.createDataFrame([(1, y, x, bool(ink[y, x])) for y in range(8) for x in range(8)], "vec_id long, y long, x long, ink boolean")
    got = {(r.y, r.x): r.label for r in labelmaps.shrink(fine, inked, 3).collect()}
    want = shrunk(label, ink, 3)
    assert got == {(y, x): want[y, x] for y in range(8) for x in range(8)} and (want[4:6] > 0).any() and (want[6:] == 0).all()
    assert labelmaps.shrink(fine.limit(0), inked, 3).count() == 0

    px = [(1, y, x, 1 if 1 <= y <= 3 and 1 <= x <= 3 else 2 if (y, x) == (5, 5) else 3 if y == 0 else 0) for y in range(6) for x in range(6)]
    tint = {1: (10, 20, 30), 2: (252, 250, 255), 3: (9, 9, 9), 0: (255, 255, 255)}
    rows = [(*p, *((11, 20, 31) if p[1:3] == (2, 2) else tint[p[3]])) for p in px]
    df = spark.createDataFrame(rows, "vec_id long, y long, x long, label int, r int, g int, b int")
    assert sorted(tuple(r)[1:] for r in labelmaps.settled(df).collect()) == [(1, 1, 11, 20, 31, 9), (2, 0, 252, 250, 255, 1), (3, 2, 9, 9, 9, 6)]


def test_quantised_and_dithered():
    x = np.add.outer(np.arange(19) * 7, np.arange(13) ** 2 % 91).astype(float)
    loss = [np.abs(raster.quantised(x, q) - x).mean() for q in (100, 75, 30, 5)]
    assert loss[0] < 0.5 and loss == sorted(loss) and np.allclose(raster._DCT @ raster._DCT.T, np.eye(8))
    assert (raster.quantised(np.full((8, 8), 128.0), 50) == 128).all()
    y = raster.apply_op("dither_palette_crush", x, 0.75, 1)
    assert len(np.unique(y)) <= 4 and abs(y.mean() - x.mean()) < 6


def test_damage_by_epoch(spark):
    df = spark.createDataFrame([(i, [((i + j * j) % 17) / 16 - 0.5 for j in range(64)]) for i in range(12)], "vec_id long, embedding array<double>")
    run = lambda epoch, freeze=False: {r.vec_id: r.damage for r in recipes.damaged(df.repartition(epoch + 1), epoch, freeze=freeze).collect()}
    first = run(0)
    assert first == run(2, True) and first != run(1) and run(1) == run(1) and all(len(v) == 64 for v in first.values())
    assert recipes.damaged(df.limit(0), 1).count() == 0

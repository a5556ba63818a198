"""Identities, known values and edge cases of the point-cloud operators."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom import FeatureConfig, features_for_points
from cloudloom.demo import run as run_demo
from cloudloom.functions import metrics, windows
from cloudloom.functions.columns import float_list, number_label, short_number
from cloudloom.operators import alignment, balls, cones, laplacian, models, neighbors, places, protocols, resampling, spectral, summary
from cloudloom.plans.config import strategy
from cloudloom.sources import pdb, sinks, tables
from cloudloom.streaming.structures import write_features


def cloud(spark, xyz, grp=0):
    return spark.createDataFrame([(grp, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)], "grp int, id long, x double, y double, z double")


def clouds():
    rng = np.random.default_rng(3)
    yield rng.normal(size=(9, 3))
    yield np.zeros((3, 3))  # coincident
    yield np.array([(i, 0, 0) for i in range(6)], float)  # collinear
    yield np.array([(0, 0, 0), (50, 0, 0)], float)  # isolated
    yield np.vstack((rng.normal(size=(4, 3)), rng.normal(size=(4, 3)) + 3))


@pytest.mark.parametrize("sheaf", ["constant", "center_labeled"])
@pytest.mark.parametrize("p", [0.0, 0.5])
def test_closed_forms_equal_the_kernel(spark, sheaf, p):
    points = None
    for g, xyz in enumerate(clouds()):
        points = cloud(spark, xyz, g) if points is None else points.unionByName(cloud(spark, xyz, g))
    config = FeatureConfig((1.5, 2.5), sheaf, "both", (0, 1, 2), (p,))
    kernel = {(r["grp"], r["center"], r["radius"], r["degree"], r["stat"]): r["value"] for r in spectral.kernel_statistics(points, config).collect()}
    for k, form in enumerate((spectral.degree0, spectral.degree1, spectral.degree2)):
        for r in form(points, [1.5, 2.5], sheaf, p).collect():
            for s in set(r.asDict()) & {"max", "mean", "std", "zeros"}:
                if r[s] is not None:
                    assert math.isclose(r[s], kernel[r["grp"], r["center"], r["radius"], k, s], rel_tol=1e-5, abs_tol=5e-6), (r, k, s)


def test_two_and_three_points():
    two = spectral.local_spectra(np.array([(0, 0, 0), (1, 0, 0)], float), None, 1.1, 0.0, (0,))
    assert np.allclose(two[0], [0, 2])
    three = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0)], float)
    spectra = spectral.local_spectra(three, None, 2.0, 0.0, (0, 1, 2))
    assert len(spectra[1]) == 3 and len(spectra[2]) == 1
    assert not np.allclose(spectra[0], spectral.local_spectra(three, np.array([0.0, 1, 1]), 2.0, 0.0, (0,))[0])


def test_feature_names_and_shape(spark):
    config = FeatureConfig((2.0, 3.0), "constant", "both", (0,))
    table = features_for_points(cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)]), config)
    assert table.count() == 3 and len(table.columns) == 2 + 12 == 2 + len(config.names())
    assert FeatureConfig((4.0,)).names()[2] == "r4_p0_d0_mean" and number_label(0, "variant") == "0p0" and number_label(-6.5) == "m6p5"
    assert strategy(("max", "min", "mean"), 0, 0.0).kernel == ("min",) and "max" in strategy(("max",), 0, 0.5).kernel
    for bad in ({"stats": "x"}, {"sheaf": "x"}, {"degrees": (3,)}, {"p_widths": (-1.0,)}):
        with pytest.raises(ValueError):
            FeatureConfig(**bad)


def test_neighbours_match_all_pairs(spark):
    xyz = np.random.default_rng(0).normal(size=(40, 3))
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    got = {(r["id"], r["other"]) for r in neighbors.radius_pairs(cloud(spark, xyz), 0.8).collect()}
    assert got == set(zip(*map(list, np.nonzero(d <= 0.8)), strict=True))
    near = {}
    for r in neighbors.nearest(cloud(spark, xyz), 5, 0.7).collect():
        near.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert all([j for _, j in sorted(v)] == np.argsort(d[i])[1:6].tolist() for i, v in near.items())
    with pytest.raises(ValueError):
        neighbors.check_radii([])


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1, i) for i in range(1, 5)] + [("b", 1.0, float(i), i) for i in range(4)] + [("c", float("nan"), 1.0, 0), ("d", 1.0, 1.0, 0), ("d", 2.0, 4.0, 1), ("d", float("nan"), 9.0, 2)], "g string, x double, y double, i int")
    pick = lambda out: {r["g"]: r[1] for r in out.collect()}
    r = pick(metrics.pearson(df, ["g"], "x", "y", ["i"]))
    assert math.isclose(r["a"], 1) and r["b"] is None and r["c"] is None and r["d"] is None
    assert math.isclose(pick(metrics.spearman(df, ["g"], "x", "y", ["i"]))["a"], 1)
    e = pick(metrics.rmse(df, ["g"], "x", "y"))
    assert math.isclose(e["d"], math.sqrt(2)) and e["c"] is None
    flags = df.withColumn("l", F.col("i") > 1)
    assert pick(metrics.auc(flags.where("g = 'a'"), ["g"], "l", "y"))["a"] == 1.0
    assert pick(metrics.jaccard(flags.withColumn("m", F.lit(False)).withColumn("l", F.lit(False)), ["g"], "l", "m"))["a"] is None


def test_windows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    z = [r[0] for r in df.where("g = 'a'").select(windows.zscore("v", ["g"])).collect()]
    assert math.isclose(sum(z), 0, abs_tol=1e-12) and math.isclose(np.std(z), 1)
    assert [r[0] for r in df.where("g = 'b'").select(windows.zscore("v", ["g"])).collect()] == [0, 0]
    assert [r[0] for r in df.where("g = 'b'").select(windows.zscore("v", ["g"], "null")).collect()] == [None, None]
    assert [r[0] for r in df.where("g = 'b'").select(windows.average_rank("v", ["g"])).collect()] == [1.5, 1.5]
    assert float_list("1, ,2") == [1, 2] and short_number(None) == "NA" and short_number(0.0001) == "1.00e-04"
    with pytest.raises(ValueError):
        float_list(" ,")


FIXED = "{:<6}{:>5}  CA  {:>3} {}{:>4}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}"


def structure(folder, name, n, shift=0.0):
    lines = ["HEADER x"] + [FIXED.format("ATOM", i, "ALA", "A", i, 3.8 * i + shift, math.sin(i), math.cos(i), 1.0, 10 + (i * 7) % 5 + shift) for i in range(1, n + 1)]
    lines += ["ATOM      9  CB  ALA A   9       1.000   1.000   1.000  1.00  1.00"]
    (folder / f"{name}.pdb").write_text("\r\n".join(lines))


def test_structures(spark, tmp_path):
    structure(tmp_path, "one", 8)
    structure(tmp_path, "two", 5, 0.5)
    rows = pdb.read_structures(spark, str(tmp_path)).orderBy("protein_id", "residue_index").collect()
    assert len(rows) == 13 and (rows[0]["protein_id"], rows[0]["residue_name"], rows[0]["chain_id"], rows[0]["residue_index"]) == ("one", "ALA", "A", 1)
    assert rows[1]["x"] == 7.6
    with pytest.raises(FileNotFoundError):
        pdb.structure_files(spark, str(tmp_path), "*.none")
    (tmp_path / "three.pdb").write_text("HEADER only\n")
    with pytest.raises(ValueError):
        pdb.read_structures(spark, str(tmp_path))


def test_malformed_lines(spark):
    text = ["ATOM      1  CA  ALA A 1 1.5 2.5 3.5 1.0 9.5", "ATOM      2  CA  GLY 17 1.5 2.5 3.5 1.0 9.5 x", "ATOM      3  CA  ALA A   3      x"]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(text)], "protein_id string, line_number int, line string")
    good = pdb.parse_atoms(df.where("line_number < 2")).orderBy("residue_index").collect()
    assert [(r["chain_id"], r["residue_number"], r["x"], r["b_factor"]) for r in good] == [("A", 1, 1.5, 9.5), ("_", 17, 1.5, 9.5)]
    assert pdb.parse_atoms(df, "skip").count() == 0
    for mode in ("fallback", "strict"):
        with pytest.raises(Exception, match="malformed"):
            pdb.parse_atoms(df, mode).collect()


def test_demo_sinks_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        structure(folder, f"s{k}", 8, k / 10)
    out = run_demo(spark, str(folder), str(tmp_path / "out"))
    assert (out["n_proteins"], out["n_residues"], out["n_features"]) == (3, 24, 18)
    assert "r4_p0_d0_mean" in (tmp_path / "out" / "feature_names.json").read_text()
    write_features(spark, str(folder), str(tmp_path / "stream"), str(tmp_path / "ck"), FeatureConfig((4.0,), stats="std")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 24
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "g int, v double")
    status = lambda m: {r["g"]: r["status"] for r in m.collect()}
    assert status(sinks.write_missing(df.where("g = 1"), str(tmp_path / "cache"), "g")) == {1: "generated"}
    assert status(sinks.write_missing(df, str(tmp_path / "cache"), "g")) == {1: "cached", 2: "generated"}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3
    assert "| 1 | 2.000 |" in sinks.report("t", df)


def test_tables(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a.pdb \n\nb\n")
    assert {r["id"] for r in tables.id_list(spark, str(tmp_path / "ids.txt"), "small").collect()} == {"a", "b"}
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "p1.csv").write_text("sec_type,area,packing_density1,packing_density2,packing_density3,B-factor\n1,2.5,1,1,1,9\n2,inf,1,1,1,8\n")
    (tmp_path / "ann" / "p1-onehot.csv").write_text("0,1\n1,0\n")
    rows = tables.annotations(spark, str(tmp_path / "ann")).orderBy("position").collect()
    assert [(r["pdbid"], r["position"], r["n_residues"], r["area"]) for r in rows] == [("p1", 0, 2, 2.5), ("p1", 1, 2, None)]
    assert [r["features"] for r in tables.one_hot_rows(spark, str(tmp_path / "ann")).orderBy("position").collect()] == [[0, 1], [1, 0]]
    rec = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n long")
    got = {r["id"]: r["status"] for r in tables.matched(rec, ("psl", rec.where("id <> 'a'").withColumn("n", F.lit(2)))).collect()}
    assert got == {"a": "missing_psl", "b": "ok", "c": "psl_mismatch"}


def test_greedy_alignment(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        long = rng.integers(0, 6, rng.integers(1, 12)).astype(float)
        short = rng.integers(0, 6, rng.integers(1, 5)).astype(float) if rng.random() < 0.5 else long[np.sort(rng.choice(len(long), max(1, len(long) // 2), replace=False))]
        rows.append((short.tolist(), long.tolist()))
    for r in spark.createDataFrame(rows, "s array<double>, l array<double>").select("*", alignment.subsequence(F.col("s"), F.col("l"), 0.05).alias("p")).collect():
        at, want = 0, []
        for v in r["s"]:
            while at < len(r["l"]) and abs(r["l"][at] - v) > 0.05:
                at += 1
            if at == len(r["l"]):
                want = None
                break
            want.append(at)
            at += 1
        assert r["p"] == want


def test_folds_and_bootstrap(spark):
    folds = resampling.fold_numbers(11, 3, 42)
    assert sorted(np.bincount(folds)) == [3, 4, 4]
    df = spark.createDataFrame([(g, float(i)) for g in "abcdef" for i in range(3)], "g string, v double")
    assert resampling.group_folds(df, "g", 3, 1).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0
    with pytest.raises(ValueError):
        resampling.group_folds(df, "g", 7, 1)
    ci = resampling.bootstrap_mean(df.withColumn("k", F.lit(1)), "v", ["k"], 200).first()
    assert ci["low"] < ci["mean"] == 1.0 < ci["high"] and ci["n"] == 18


def test_linear_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2, -1] + rng.normal(size=60) / 10
    df = spark.createDataFrame([(int(i % 3), float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "g int, a double, b double, y double")
    want = np.linalg.lstsq(np.column_stack((np.ones(60), x)), y, rcond=None)[0]
    assert np.allclose(models.linear_fit(df, ["a", "b"], "y"), want)
    for r in models.fit_each_group(df, "g", ["a", "b"], "y").groupBy("g").agg(F.avg(F.col("prediction") - F.col("y")).alias("e")).collect():
        assert abs(r["e"]) < 1e-9
    assert models.max_features("sqrt") == "sqrt" and models.max_features(None) == "all" and models.max_features("0.5") == "0.5" and models.max_features("3") == "3"
    with pytest.raises(ValueError, match="not installed"):
        models.tree_model("xgb")


def test_tree_shap_sums_to_the_prediction(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, r), float(r[0] * 2 + r[1] ** 2)) for i, r in enumerate(rng.normal(size=(80, 3)))], "i int, a double, b double, c double, target double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = models.tree_model("rf", trees=3, depth=4, leaf=1).fit(rows)
    out = models.shapley(df, model, ["a", "b", "c"], ["i"]).join(model.transform(rows).select("i", "prediction"), "i").collect()
    base = [r["prediction"] - r["shap_sum"] for r in out]
    assert np.ptp(base) < 1e-6
    # brute force over subsets for one row of one tree
    from itertools import combinations

    trees, _ = models.tree_tables(model)
    t, x = trees[0], np.array([out[0]["i"]] and df.where("i = 0").select("a", "b", "c").first(), float)

    def value(known, node=0):
        if t["left"][node] < 0:
            return t["value"][node]
        left, right, f = t["left"][node], t["right"][node], t["feature"][node]
        if f in known:
            return value(known, left if x[f] <= t["threshold"][node] else right)
        return sum(t["cover"][c] * value(known, c) for c in (left, right)) / t["cover"][node]

    phi = models.tree_shap(t, x)
    for f in range(3):
        others = [g for g in range(3) if g != f]
        want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, f}) - value(set(s))) for n in range(3) for s in combinations(others, n))
        assert math.isclose(phi[f], want, abs_tol=1e-9)


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0)], "m string, v double")
    got = {r["m"]: (r["n"], r["mean_v"]) for r in summary.every_label(summary.with_total(df, "m", ["v"]), "m", ["a", "b", "c", "all"]).collect()}
    assert got == {"a": (2, 1.5), "b": (1, 3.0), "c": (None, None), "all": (3, 2.0)}
    assert [r["rank"] for r in summary.top_rows(df, "v", 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        summary.select_features(df, "^zz", ["m"])
    with pytest.raises(ValueError):
        summary.feature_source(df, "other", [], [])


def test_cloud_laplacians(spark):
    xyz, labels = np.array([(0, 0), (3, 0), (0, 4)], float), [2.0, 4.0, 2.0]
    plain = laplacian.Cloud(xyz, radii=[2.0, 3.0, 9.0])
    assert [np.diag(m).tolist() for m in plain.matrices()] == [[0, 0, 0], [1, 1, 0], [2, 2, 2]]
    assert [m.shape for m in plain.matrices(1)] == [(0, 0), (1, 1), (3, 3)] and [m.tolist() for m in plain.matrices(2)][2] == [[3.0]]
    assert np.allclose(laplacian.Cloud(xyz, labels, kind="RIPS", p=0.5, constant=False).matrices()[0], [[3 / 2.5 + 1 / 3, -3 / 2.5, -1 / 3], [-3 / 2.5, 3 / 2.5 + 3 / 3.5, -3 / 3.5], [-1 / 3, -3 / 3.5, 1 / 3 + 3 / 3.5]])
    assert np.allclose(laplacian.Cloud(xyz, labels, constant=False, scale=True).matrices()[0], [[3, -2, -1], [-2, 4, -2], [-1, -2, 3]])
    assert laplacian.Cloud(np.zeros((0, 3))).matrices()[0].shape == (0, 0) and laplacian.scaled_labels(np.array([5.0, 5.0])).tolist() == [0, 0]
    for wrong in ({"kind": "cech"}, {"radii": []}, {"radii": [-1.0]}, {"p": -1.0}, {"labels": [1.0]}, {"labels": [1.0, 2.0, np.inf]}):
        with pytest.raises(ValueError):
            laplacian.Cloud(xyz, **wrong)
    with pytest.raises(ValueError):
        laplacian.Cloud([1.0, 2.0])
    rng = np.random.default_rng(3)
    cloud, own = rng.random((9, 3)), rng.random(9)
    for degree in (0, 1, 2):
        for values in laplacian.Cloud(cloud, own, radii=[0.6, 1.0], constant=False).eigenvalues(degree):
            assert (values > -1e-9).all()
    df = spark.createDataFrame([("g", i, *x, float(v)) for i, (x, v) in enumerate(zip(cloud.tolist(), own, strict=True))], "g string, i long, x double, y double, z double, l double")
    got = {(r["degree"], r["stat"]): r["value"] for r in laplacian.cloud_statistics(df, "g", "i", ["x", "y", "z"], "l", [0.6], degrees=(0, 1), constant=False).collect()}
    want = spectral.spectrum_statistics(np.linalg.eigvalsh(laplacian.Cloud(cloud, own, radii=[0.6], constant=False).matrices(1)[0]))
    assert all(math.isclose(got[1, k], v, abs_tol=1e-9) for k, v in want.items()) and len(got) == 12


def test_dense_complexes_are_refused(monkeypatch):
    monkeypatch.setattr(spectral, "MAX_CELLS", 100)
    with pytest.raises(ValueError, match="more than 100"):
        spectral.local_spectra(np.zeros((8, 3)), None, 1.0, 0.0, (1,))


def test_cones_with_twins_have_the_spectra_of_whole_matrices():
    rng = np.random.default_rng(1)
    for trial in range(20):
        xyz = rng.normal(size=(int(rng.integers(1, 12)), 3)) * 0.5
        xyz = np.vstack((xyz, xyz[rng.integers(0, len(xyz), 6)] + 1e-9)) if trial % 2 else xyz
        xyz = xyz[(xyz**2).sum(axis=1) <= 0.64]
        if len(xyz):
            near = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)) <= 0.8
            for w, labels in ((1.0, None), (2.0, np.array([0.0] + [1.0] * len(xyz)))):
                want = spectral.local_spectra(np.vstack((np.zeros((1, 3)), xyz)), labels, 0.8, 0.0, (0, 1, 2))
                for k, made in cones.spectra(near, w, (0, 1, 2)).items():
                    assert np.allclose(np.sort(np.repeat(made.values, made.times)), want[k], atol=1e-8)
                    assert made.statistics(1e-8) == pytest.approx(spectral.spectrum_statistics(want[k]), abs=1e-8)


def test_kernel_of_a_large_clump(spark):
    # 45 near copies: 14,190 triangles, whose own matrix would hold more than MAX_CELLS numbers
    points = cloud(spark, np.random.default_rng(0).normal(size=(45, 3)) * 1e-3)
    rows = spectral.kernel_statistics(points, FeatureConfig((1.0,), "constant", "both", (1, 2))).collect()
    assert len(rows) == 45 * 2 * 6
    want = {"max": 45, "min": 45, "mean": 45, "median": 45, "std": 0}
    for r in rows:
        zeros = 0 if r["degree"] == 1 else 14190 - (990 - 45 + 1)
        assert r["value"] == pytest.approx((want | {"zeros": zeros})[r["stat"]], abs=1e-6)


def test_least_and_median_without_all_eigenvalues(monkeypatch):
    rng = np.random.default_rng(2)
    whole, sides = np.linalg.eigvalsh, []
    monkeypatch.setattr(np.linalg, "eigvalsh", lambda m: (sides.append(len(m)), whole(m))[1])
    for n, twins in ((701, 0), (702, 60)):
        xyz = rng.normal(size=(n, 3)) * 0.5
        xyz = np.vstack((xyz, xyz[rng.integers(0, n, twins)]))
        near = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)) <= 0.8
        for w in (1.0, 2.0):
            sides.clear()
            got = cones.least_and_median(near, w, 1e-8)
            assert max(sides) <= places.PIVOT  # none of the whole
            edges = np.where(near, -1.0, 0.0)
            np.fill_diagonal(edges, near.sum(axis=1) - 1)
            want = np.concatenate(([0.0, w * (len(near) + 1)], w + whole(edges)[1:]))
            want = spectral.spectrum_statistics(want)
            assert got == pytest.approx({s: want[s] for s in ("min", "median")}, abs=1e-7)


def test_eigenvalues_at_places_that_are_equal():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(500, 500)))[0]
    for values in (np.repeat(np.arange(100.0), 5), np.r_[np.arange(250), np.full(250, 250.3)], rng.normal(size=500) * 100):
        matrix = (turn * values) @ turn.T
        matrix = (matrix + matrix.T) / 2
        every = np.sort(np.concatenate([values, [3.0, 3.0, 260.0]]))
        for at in ([0], [1], [251, 252], [502]):
            assert places.eigenvalues_at(matrix, np.array([260.0, 3.0, 3.0]), at) == pytest.approx(every[at], abs=1e-7)


def test_kernel_of_small_and_cut_links():
    for near in (np.ones((1, 1), bool), np.eye(5, dtype=bool), np.kron(np.eye(2, dtype=bool), np.ones((150, 150), bool))):
        want = cones.spectra(near, 2.0, (0,))[0].statistics(1e-8)
        got = cones.least_and_median(near, 2.0, 1e-8)
        assert (got["min"], got["median"]) == pytest.approx((want["min"], want["median"]), abs=1e-7)
    far = np.abs(np.subtract.outer(*[np.r_[np.linspace(0, 1, 300), np.linspace(9, 10, 300)]] * 2)) <= 0.2  # two parts: least is w
    assert cones.least_and_median(far, 2.0, 1e-8)["min"] == pytest.approx(2.0, abs=1e-7)


def test_bootstrap_tests(spark):
    rng = np.random.default_rng(0)
    rows = [(m, g, float(v)) for m in ("auc_a", "odds_b", "spearman_c") for g, v in enumerate(rng.normal(0.8, 0.5, 12))] + [("auc_a", 12, float("nan")), ("auc_a", 13, None), ("smd_d", 0, None)]
    values = spark.createDataFrame(rows, "metric string, g long, v double")
    got = {r["metric"]: r for r in protocols.validation_table(values, "g", {"spearman_c": "less", "odds_b": "two-sided"}, reps=50).collect()}
    for name, null, beyond in (("auc_a", 0.5, lambda m, o, z: m <= z), ("odds_b", 1.0, lambda m, o, z: np.abs(m - o) <= z), ("spearman_c", 0.0, lambda m, o, z: m >= z)):
        x = np.array([v for m, _, v in rows if m == name and v is not None and np.isfinite(v)])
        draw = np.random.default_rng(resampling.CI_SEED)
        means = np.array([draw.choice(x, len(x)).mean() for _ in range(50)])
        want = [x.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975), (1 + beyond(means, x.mean(), null).sum()) / 51]
        assert np.allclose([got[name][k] for k in ("estimate", "low", "high", "p")], want)
    assert got["smd_d"]["estimate"] is None and got["smd_d"]["p"] is None
    means = spark.createDataFrame([(0.1,), (0.4,), (0.9,)], "mean double")
    assert resampling.bootstrap_p_value(means, 0.2, "two-sided", 0.3).first()["p"] == 0.75
    with pytest.raises(ValueError):
        resampling.bootstrap_p_value(means, 0.2, "two-sided")


def test_ridge_with_chosen_penalty(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(15, 3))
    y = x @ [1.0, 0.0, -2.0] + rng.normal(size=15)
    df = spark.createDataFrame([("g", i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("g", 99, None, 0.0, 0.0, 1.0)], "g string, i long, a double, b double, c double, y double")
    got = models.ridge_cv_each_group(df, "g", ["i"], ["a", "b", "c"], "y").orderBy("i").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def ridge(rows, alpha):
        mean, centre = z[rows].mean(axis=0), y[rows].mean()
        w = np.linalg.solve((z[rows] - mean).T @ (z[rows] - mean) + alpha * np.eye(3), (z[rows] - mean).T @ (y[rows] - centre))
        return lambda q: centre + (q - mean) @ w

    every = np.arange(15)
    errors = [np.mean([(y[i] - ridge(every[every != i], a)(z[i])) ** 2 for i in every]) for a in models.CV_ALPHAS]
    best = models.CV_ALPHAS[int(np.argmin(errors))]
    assert len(got) == 15 and {r["alpha"] for r in got} == {best}
    assert np.allclose([r["prediction"] for r in got], ridge(every, best)(z))


def test_paired_sources(spark, tmp_path):
    head = "sec_type,area,packing_density1,packing_density2,packing_density3,B-factor\n"
    for name, values, hot in (("p1", (9, 11), 2), ("p2", (9, 11), 3), ("p3", (5, 5), 2), ("p4", (), 2)):
        if values:
            (tmp_path / f"{name}.csv").write_text(head + "".join(f"1,1,1,1,1,{v}\n" for v in values))
            np.save(tmp_path / f"{name}_bfactors.npy", np.array(values, float))
        (tmp_path / f"{name}-onehot.csv").write_text("0,1\n" * hot)
        np.save(tmp_path / f"{name}_psl_features.npy", np.tile([0.0, 1.0], (hot, 1)))
    for made in (tables.one_hot_targets(spark, str(tmp_path)), tables.cached_matrices(spark, str(tmp_path))):
        assert [(r["pdbid"], r["position"], r["features"], r["raw"], r["target"]) for r in made.orderBy("position").collect()] == [("p1", 0, [0, 1], 9, -1), ("p1", 1, [0, 1], 11, 1)]
    assert tables.first_existing(str(tmp_path / "none"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.first_existing(str(tmp_path / "none"))


def test_evaluation_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "g string, pearson double")
    got = sinks.write_evaluation(df, df.agg(F.count("*").alias("n_groups")), str(tmp_path), "rf")
    assert got == {"n_groups": 2} and (tmp_path / "cv_summary_rf.json").read_text() == '{\n  "n_groups": 2\n}\n'
    assert spark.read.csv(str(tmp_path / "cv_metrics_rf.csv"), header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.write_evaluation(df, df, str(tmp_path), "rf")


def shuffled_rows(spark, df):
    """Rows that the stages of df's jobs write to shuffles."""
    spark.sparkContext.setJobGroup(group := f"rows-{id(df)}", "")
    rows = df.collect()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return rows, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))


@pytest.mark.parametrize("name", ["degree0", "degree0_damped", "degree1", "degree2", "clustering", "edges", "degrees", "faces", "cloud"])
def test_edges_and_triangles_of_dense_balls_are_not_shuffled(spark, name):
    n = 60
    points = cloud(spark, np.random.default_rng(0).random((n, 3)))
    labelled = points.withColumn("label", F.col("id").cast("double"))
    made = {
        "degree0": lambda: spectral.degree0(points, [2.0]).where(f"n = {n} AND abs(mean - {n}) < 1e-9 AND std < 1e-4"),
        "degree0_damped": lambda: spectral.degree0(points, [2.0], "center_labeled", 0.5).where(f"n = {n} AND max IS NULL"),
        "degree1": lambda: spectral.degree1(points, [2.0]).where(f"abs(mean - {n}) < 1e-9"),
        "degree2": lambda: spectral.degree2(points, [2.0]).where(f"abs(mean - {n}) < 1e-9"),
        "clustering": lambda: neighbors.clustering(points, 2.0).where("clustering = 1"),
        "edges": lambda: balls.edge_sums(points, [2.0], "center_labeled", 0.5, lengths=True).where(f"e = {n * (n - 1) // 2}"),
        "degrees": lambda: balls.degrees(points, [2.0]).where(f"degree = {n - 1}"),
        "faces": lambda: balls.signed_faces(points, [2.0]).where(f"n = {n - 2} AND sum_sign = n - 2 * (v - u - 1)"),
        "cloud": lambda: laplacian.cloud_matrices(labelled, "grp", "id", ["x", "y", "z"], "label", [2.0], constant=False, scale=True),
    }
    rows, moved = shuffled_rows(spark, made[name]())
    assert len(rows) == {"degrees": n * n, "faces": n * n * (n - 1) // 2, "cloud": n * n}.get(name, n)
    assert moved < 40 * n < n * (n - 1) / 2 * 27  # points, for up to 27 cells, and not the edges of n balls


def test_tiles_of_balls_do_not_change_them(spark):
    points = cloud(spark, np.random.default_rng(4).normal(size=(50, 3)))
    made = lambda: (balls.triangle_sums(points, [1.5]).collect(), balls.edge_sums(points, [1.5], "center_labeled", 0.5, True).collect(), balls.signed_faces(points, [1.5]).collect())
    tidy = lambda parts: [sorted(tuple(round(x, 6) for x in r) for r in part) for part in parts]
    whole, kept = tidy(made()), (balls.TILE, balls.CENTRES)
    try:
        balls.TILE, balls.CENTRES = 8, 3
        assert tidy(made()) == whole
    finally:
        balls.TILE, balls.CENTRES = kept


def test_triangles_are_counted_in_the_order_of_x(spark):
    rng = np.random.default_rng(8)
    xyz = np.vstack((rng.normal(size=(60, 3)), rng.normal(size=(30, 3)) * 0.1, rng.integers(-1, 2, size=(40, 3))))  # equal x and points too
    near = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)) <= 1.0 + 1e-12
    want = {}
    for c in range(len(xyz)):
        at = np.flatnonzero(near[c])
        own = (near[np.ix_(at, at)] & ~np.eye(len(at), dtype=bool)).astype(int)
        if (t := int(np.trace(own @ own @ own)) // 6) > 0:
            want[c] = t
    points = cloud(spark, xyz).withColumn("id", F.lit(1000) - F.col("id"))
    got = {1000 - r["center"]: r["t"] for r in balls.triangle_counts(points, [1.0]).where("t > 0").collect()}
    assert got == want


def test_triangles_of_one_task(monkeypatch):
    # all 40 points are neighbours, with ids against the order of x: products are of the later points alone
    made, n = {}, 40
    monkeypatch.setattr(balls, "TILE", 16)
    monkeypatch.setattr(balls, "each_ball", lambda points, radii, schema, run, order: made.update(run=run, order=order) or points)
    with pytest.raises(AttributeError):
        balls.triangle_counts(None, [1.0])
    x = np.linspace(0, 0.5, n)
    batch = pa.RecordBatch.from_pydict({"grp": [0] * n, "id": list(range(n, 0, -1)), "x": x, "y": x, "z": x, "own": [k % 3 > 0 for k in range(n)]})
    ball = balls.Ball([batch], [], made["order"])
    ((_, (_, places), _, t),) = made["run"](ball, 1.0, 1.0)
    first = np.flatnonzero(np.arange(n) % 3 > 0)  # triangles and fours are those of which the first is a centre
    later = n - 1 - first
    assert t.sum() == 3 * (later * (later - 1) // 2).sum() + 4 * (later * (later - 1) * (later - 2) // 6).sum()
    assert ball.ids.to_pylist() == list(range(n, 0, -1)) and places.min() == 1


def test_numbers_wider_than_their_columns(spark):
    n = [0, 7, 9999, 10000, 99999, 100000, 1223055, 1223056, 2436111]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(n)], "line_number int, k int")
    text = F.format_string("ATOM  %5s  CA  ALA A%4s    %8.3f%8.3f%8.3f%6.2f%6.2f", pdb.hybrid36(F.col("k") + 90000, 5), pdb.hybrid36(F.col("k"), 4), *[F.lit(float(i)) for i in range(5)])
    got = pdb.parse_atoms(df.select(F.lit("s").alias("protein_id"), "line_number", text.alias("line"))).orderBy("residue_index").collect()
    assert [(r["atom_serial"], r["residue_number"], r["x"], r["b_factor"]) for r in got] == [(k + 90000, k, 0.0, 4.0) for k in n]
    assert df.limit(1).select(pdb.hybrid36(F.lit(100000), 5)).first()[0] == "A0000"
    with pytest.raises(Exception, match="too large"):
        df.select(pdb.hybrid36(F.col("k"), 3)).collect()


def test_draws_are_not_broadcast(spark):
    values = spark.range(9001).select(F.col("id").alias("pos"), (F.col("id") % 7).cast("double").alias("m"))
    samples = resampling.bootstrap_samples(values, "m", "pos", 3, 9001)
    assert "BroadcastHashJoin" not in samples._jdf.queryExecution().toString()
    want = {r: np.mean([((r * 1103515245 + k * 12345 + 12345) % 2147483648 % 9001) % 7 for k in range(9001)]) for r in range(3)}
    assert {r["rep"]: round(r["mean"], 9) for r in samples.collect()} == {r: round(v, 9) for r, v in want.items()}
    assert resampling.bootstrap_samples(values.limit(0), "m", "pos", 3, 0).count() == 0


def test_shapley_values_of_many_rows_at_once():
    tree = {"left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]), "feature": np.array([0, -1, 1, -1, -1]), "threshold": np.array([0.5, 0, 0.2, 0, 0]), "value": np.array([0, 1.0, 0, 5.0, 9.0]), "cover": np.array([10.0, 4, 6, 2, 4])}
    rows = np.random.default_rng(0).random((50, 2))
    values = models.tree_shap(tree, rows)
    assert np.allclose(values, [models.tree_shap(tree, r) for r in rows])
    told = np.where(rows[:, 0] <= 0.5, 1.0, np.where(rows[:, 1] <= 0.2, 5.0, 9.0))
    assert np.allclose(values.sum(axis=1), told - (0.4 * 1 + 0.2 * 5 + 0.4 * 9))

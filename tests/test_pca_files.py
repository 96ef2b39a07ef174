import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import pca
from lodestat.sources import files, schema


def table(spark, x):
    rows = [(f"r{i:02d}", f"c{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if not np.isnan(v)]
    df = spark.createDataFrame(rows, "row string, col string, value double")
    return pca.packed_rows(df, "row", "col", "value", [f"c{j}" for j in range(x.shape[1])])


def sample(missing):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 2)) @ np.array([[3.0, 2, -1, 0.5, 1], [0.2, -1, 1, 2, 0.1]]) + 0.05 * rng.normal(size=(40, 5))
    if missing:
        x[rng.random(x.shape) < 0.08] = np.nan
    return x


NAMES = [f"c{j}" for j in range(5)]


def scaled(x):
    return (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0, ddof=1)


def observed_scores(x, loadings):
    return np.array([np.linalg.lstsq(loadings[:, ~np.isnan(r)].T, r[~np.isnan(r)], rcond=1e-8)[0] for r in x])


def plain(x, k, method, steps=3000):
    """The methods on whole rows, with a fixed large number of steps."""
    seen, size = ~np.isnan(x), x.shape[1]
    if method == "nipals":
        out = []
        for _ in range(k):
            p = np.ones(size) / np.sqrt(size)
            for _ in range(steps):
                t = np.nansum(x * p, axis=1) / (seen @ p**2)
                p = np.nansum(x * t[:, None], axis=0) / (t**2 @ seen)
                p /= np.linalg.norm(p)
            x = x - (np.nansum(x * p, axis=1) / (seen @ p**2))[:, None] * p
            out.append(p)
        return np.array(out)
    if method == "svdImpute":
        full = np.where(seen, x, 0.0)
        for _ in range(steps):
            p = np.linalg.svd(full, full_matrices=False)[2][:k]
            full = np.where(seen, x, full @ p.T @ p)
        return p
    w, noise, filled = np.eye(size)[:, :k] + 0.1, 1.0, np.where(seen, x, 0.0)
    for _ in range(steps):
        a, b, left = np.zeros((size, k)), np.zeros((size, k, k)), 0.0
        for row, there in zip(filled, seen):
            inverse = np.linalg.inv(w[there].T @ w[there] + noise * np.eye(k))
            z = inverse @ w[there].T @ row[there]
            zz = noise * inverse + np.outer(z, z)
            a += np.outer(row, z)
            b[there] += zz
            left += row @ row - 2 * row[there] @ w[there] @ z + np.trace(w[there] @ zz @ w[there].T)
        noise, w = left / seen.sum(), np.array([np.linalg.solve(b[j], a[j]) for j in range(size)])
    return np.linalg.qr(w)[0].T


def same_axes(got, want, ordered):
    if ordered:
        assert np.allclose(np.abs(np.sum(got * want, axis=1)), 1, atol=1e-7)
    assert np.allclose(got.T @ np.linalg.pinv(got.T), want.T @ np.linalg.pinv(want.T), atol=1e-5)


@pytest.mark.parametrize("method", list(pca.METHODS))
def test_complete_data_gives_the_principal_axes(spark, method):
    x = sample(False)
    z = scaled(x)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    fitted = pca.pca_missing(table(spark, x), NAMES, 2, method)
    same_axes(fitted.loadings, axes, True)
    assert fitted.r2[1] > 0.98
    scores = {r["row"]: r["scores"] for r in fitted.scores.collect()}
    assert np.allclose(scores["r00"], z[0] @ fitted.loadings.T, atol=1e-6)


@pytest.mark.parametrize("method", list(pca.METHODS))
def test_missing_cells_against_the_methods_on_whole_rows(spark, monkeypatch, method):
    """Condensed on the driver, or passed over on the executors: the same as every row by itself."""
    x = np.vstack([sample(True), sample(False)[::-1] * 0.7])
    want = plain(scaled(x), 2, method, 400 if method == "ppca" else 3000)
    near = pca.pca_missing(table(spark, x), NAMES, 2, method)
    same_axes(near.loadings, want, method != "ppca")
    z = scaled(x)
    miss = np.nansum((z - observed_scores(z, near.loadings) @ near.loadings) ** 2)
    assert near.r2[1] == pytest.approx(1 - miss / np.nansum(z**2), abs=1e-9)
    monkeypatch.setattr(pca, "DRIVER_CELLS", 0)
    far = pca.pca_missing(table(spark, x), NAMES, 2, method, tolerance=1e-3)
    assert np.linalg.norm(far.loadings @ near.loadings.T) ** 2 == pytest.approx(np.linalg.norm(near.loadings @ near.loadings.T) ** 2, abs=0.02)


def test_condensed_rows_keep_sums_of_products():
    x = np.vstack([sample(True)] * 5)
    out = pca._condense(3, x, np.ones(len(x)))
    cells = np.vstack(out["cells"])
    assert len(out) < len(x) and out["weight"].sum() == pytest.approx(len(x)) and set(out["fold"]) == {3}
    patterns = np.unique(~np.isnan(x), axis=0)
    for there in patterns:
        a = x[(~np.isnan(x) == there).all(axis=1)][:, there]
        b = cells[(~np.isnan(cells) == there).all(axis=1)][:, there]
        assert np.allclose(a.T @ a, b.T @ b)


def test_components_that_still_move_are_an_error(spark):
    with pytest.raises(pca.NotConverged):
        pca.pca_missing(table(spark, sample(True)), NAMES, 2, "svdImpute", rounds=2)


def test_fewer_components_than_asked_for(spark):
    x = np.outer(np.arange(1.0, 9), [1.0, -2, 3])
    fitted = pca.pca_missing(table(spark, np.column_stack([x, np.full(8, 4.0)])), ["c0", "c1", "c2", "c3"], 3)
    assert np.allclose(np.abs(fitted.loadings[0]), [3**-0.5] * 3 + [0]) and np.allclose(fitted.loadings[1:], 0)
    assert np.allclose(fitted.r2, 1)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "row string, cells array<double>")
    for method in ("nipals", "svdImpute"):
        assert pca.pca_missing(empty, ["a", "b"], 2, method).r2 == [0.0, 0.0]
    assert pca.pca_q2(empty, ["a", "b"], 1) == [0.0]


@pytest.mark.parametrize("method", ["nipals"])
def test_cross_validation_against_a_fit_per_fold(spark, method):
    x = sample(True)
    rows = table(spark, x)
    got = pca.pca_q2(rows, NAMES, 2, method, folds=3)
    folds = {r["row"]: r["f"] for r in rows.select("row", F.array(*[pca.fold_of(F.col("row"), j, 3) for j in range(5)]).alias("f")).collect()}
    of, z, press = np.array([folds[f"r{i:02d}"] for i in range(len(x))]), scaled(x), np.zeros(2)
    assert set(of.ravel()) == {0, 1, 2}
    for f in range(3):
        train = np.where(of == f, np.nan, z)
        there = ~np.isnan(train).all(axis=1)
        loadings = plain(train[there], 2, method, 300 if method == "ppca" else 3000)
        if method == "ppca":
            t = observed_scores(train[there], loadings)
            loadings = np.linalg.eigh(t.T @ t)[1][:, ::-1].T @ loadings
        for c in (1, 2):
            guess = np.zeros_like(z)
            guess[there] = observed_scores(train[there], loadings[:c]) @ loadings[:c]
            press[c - 1] += np.nansum(np.where(of == f, z - guess, 0.0) ** 2)
    assert np.allclose(got, 1 - press / np.nansum(z**2), atol=1e-4)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("X1,sample,value,qual\n1, L1 ,2.5,<MDL\n2,NA,NaN,\n3,\"\",,\" x \"\n")
    layout = schema.layout(X1=schema.INT, sample=schema.TEXT, value=schema.DOUBLE, qual=schema.TEXT)
    df = files.drop_index(files.read_measurements(spark, path, layout))
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [
        ("L1", 2.5, "<MDL"), (None, None, None), (None, None, "x")]))
    out = str(tmp_path / "out")
    files.write_csv(df.coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text.startswith("sample,value,qual\n") and "NA,NA,NA" in text
    lookup = str(tmp_path / "lookup.csv")
    with open(lookup, "w") as f:
        f.write("Zn,Metal,\"Zinc, Total\"\nQ,NA,\n")
    got = sorted(map(str, (tuple(r) for r in files.read_lookup(spark, lookup, ["a", "b", "c"]).collect())))
    assert got == sorted(map(str, [("Zn", "Metal", "Zinc, Total"), ("Q", None, None)]))


def test_raw_layout_types_known_columns(spark):
    names = ["ROWID", "SITE", "NUMVALUE"]
    assert [f.dataType.simpleString() for f in schema.raw_layout(names).fields] == ["int", "string", "double"]


def test_stored_keeps_rows_and_schema(spark):
    df = spark.range(5).select("id", F.lit(None).cast("double").alias("x"))
    kept = files.stored(df)
    assert kept.schema.names == ["id", "x"] and kept.count() == 5

"""Kernels, extraction, store, learning and the command line."""

from dataclasses import replace
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.config import Config, Features, Modeling, Synthetic
from ocellus.kernels import families, filters, frame, morphology, render
from ocellus.ml import models
from ocellus.operators import extract
from ocellus.sources import tables
from ocellus.sources.adapters import ADAPTERS, Adapter

SMALL = Features(work_size=128)


def picture(grade, k=0, size=192):
    return render.render(grade, render.Look.sample(np.random.default_rng([k, 5])), True, size, np.random.default_rng([grade, k, 5]))


def test_columns():
    names = families.columns()
    assert len(names) == 144 == len(set(names)) and list(names) == sorted(names)
    n = {f: sum(c.split("_")[0].rstrip("0123456789") == f for c in names) for f in ("lesion", "texture", "colour", "vessel", "exposure", "zone", "disc", "macula")}
    assert n == {"lesion": 50, "texture": 26, "colour": 21, "vessel": 15, "exposure": 16, "zone": 10, "disc": 4, "macula": 2}


def test_all_finite_and_repeatable():
    a, b = (families.describe(frame.prepare(picture(2), SMALL)) for _ in range(2))
    assert a == b and all(np.isfinite(v) for v in a.values())
    black = families.describe(frame.prepare(np.zeros((128, 128, 3)), SMALL))
    assert all(np.isfinite(v) for v in black.values()) and set(black) == set(a)


def test_padding_changes_little():
    img = picture(2)
    a = families.describe(frame.prepare(img, SMALL))
    b = families.describe(frame.prepare(np.pad(img, [(40, 40), (40, 40), (0, 0)]), SMALL))
    for c in ("colour_r_mean", "exposure_green_p50", "zone0_gray_mean", "vessel_area_fraction"):
        assert abs(a[c] - b[c]) <= 0.06 * abs(a[c]) + 1e-6, c


def test_lesions_grow_with_the_grade():
    burden = [np.mean([families.describe(frame.prepare(picture(g, k), SMALL))["lesion_total_count_density"] for k in range(3)]) for g in (0, 4)]
    assert burden[1] > burden[0]


def test_field_of_view_and_zones():
    yy, xx = np.indices((128, 128))
    img = np.where(((yy - 64) ** 2 + (xx - 64) ** 2 <= 40**2)[..., None], 0.6, 0.0) * np.ones(3)
    assert abs(frame.field_of_view(img).sum() / (np.pi * 40**2) - 1) < 0.05
    f = frame.prepare(img, SMALL)
    assert (sum(z.astype(int) for z in f.zones()) == f.mask).all()


def test_components():
    m = np.zeros((20, 20), bool)
    m[1, 1] = m[5:10, 5:10] = True
    assert morphology.remove_small(m, 5).sum() == 25
    d = np.eye(4, dtype=bool)
    assert morphology.label(d, 4)[1] == 4 and morphology.label(d, 8)[1] == 1
    ring = np.ones((9, 9), bool)
    ring[3:6, 3:6] = False
    assert morphology.fill_holes(ring).all()
    spiral = np.random.default_rng(0).random((60, 60)) > 0.4
    numbers, n = morphology.label(spiral, 4)
    assert all((numbers[1:][spiral[1:] & spiral[:-1]] == numbers[:-1][spiral[1:] & spiral[:-1]])) and n == len(np.unique(numbers)) - 1


def test_morphology_against_brute_force():
    rng = np.random.default_rng(0)
    img = rng.random((15, 17))
    for r in (1, 2, 4):
        p = np.pad(img, r, constant_values=np.inf)
        want = np.min([p[r + dy : r + dy + 15, r + dx : r + dx + 17] for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r], axis=0)
        assert np.array_equal(morphology._extreme(img, r, np.inf, np.minimum), want)
    line = np.zeros((20, 20), bool)
    line[8:13, 2:18] = True
    assert morphology.thin(line).sum() <= 18


def test_filters():
    flat = np.full((20, 20), 0.4)
    assert np.allclose(filters.gaussian(flat, 2), 0.4) and np.allclose(filters.laplace(flat), 0) and np.allclose(filters.sobel(flat), 0)
    assert np.allclose(filters.resize(flat, 7, True), 0.4)
    assert filters.hsv(np.array([[[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0], [0.5, 0.5, 0.5]]]))[0, :, 0] == pytest.approx([0, 1 / 3, 2 / 3, 0])
    two = np.r_[np.full(50, 0.2), np.full(50, 0.8)]
    assert 0.2 < filters.otsu(two) < 0.8
    p = families.cooccurrence(np.zeros((8, 8), int), 4, 1, 0)
    assert families.cooccurrence_stats(p)["asm"] == 1.0


def test_files():
    img = picture(1, size=64)
    assert np.abs(render.unpng(render.png(img)) - img).max() < 0.003
    assert render.ppm(b"P6\n# note\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 255])).tolist() == [[[1.0, 0, 0], [0, 0, 1.0]]]


def test_adapters():
    assert Adapter.find([" ID_Code ", "x"], ADAPTERS["aptos"].id_columns) == " ID_Code "
    assert Adapter.find(["a"], ("b",)) is None


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nfeatures: {work_size: 99}\nodd: 1\n")
    cfg = Config.load(tmp_path / "c.yaml", {"features": {"n_zones": 3}})
    assert (cfg.seed, cfg.features.work_size, cfg.features.n_zones, cfg.features.lbp_points) == (7, 99, 3, 8)
    assert Config.load(tmp_path / "none.yaml") == Config()


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort")
    cfg = Config(root=str(root), synthetic=Synthetic(n_patients=12, image_size=128), features=Features(work_size=96), modeling=Modeling(cv_folds=2, n_search_iter=1, nested_cv=False, n_bootstrap=50, models=("logreg",), permutation_repeats=1))
    raw = root / "data/raw"
    assert tables.write_synthetic(spark, cfg.synthetic, str(raw), 7) == 24
    (raw / "images" / "broken_left.png").write_bytes(b"this is not an image")
    with (raw / "labels.csv").open("a") as f:
        f.write("broken_left,B,left,2\n")
    return cfg


def test_end_to_end(spark, cohort):
    from ocellus import cli

    rows = cli.make_manifest(spark, cohort)
    assert rows.count() == 25 and rows.agg(F.count_distinct("group")).first()[0] == 13
    got = cli.make_features(spark, cohort)
    assert got.count() == 24 and len(extract.feature_columns(got)) == 144
    store = spark.read.parquet(str(cohort.place("cache").resolve()))
    first = store.count()
    assert first == 24 and cli.make_features(spark, cohort).count() == 24
    assert spark.read.parquet(str(cohort.place("cache").resolve())).count() == first  # nothing computed again
    failed = extract.extract(extract.pixels(rows.where("image_id = 'broken_left'").select("image_id", "image_path")), cohort.features).first()
    assert failed.extraction_ok == 0 and failed.qc_reasons == "extraction_failed" and not failed.gradable


def test_only_missing_files_are_read(spark, tmp_path, monkeypatch):
    """Of a stored folder with one new file only that one is decoded; lots don't change the result."""
    read = []

    def counted(images):
        got = pixels(images)
        read.append(sorted(unquote(p.rsplit("/", 1)[-1]) for p in got.inputFiles()))
        return got

    pixels = extract.pixels
    monkeypatch.setattr(extract, "pixels", counted)
    monkeypatch.setattr(extract, "LOT", 2)
    folder, store, small = tmp_path / "in", str(tmp_path / "store"), Features(work_size=64)
    folder.mkdir()
    for k in range(3):
        (folder / f"eye +[{k}] {{x}}%.png").write_bytes(render.png(picture(k, size=64)))
    (folder / "old.ppm").write_bytes(b"P6 64 64 255\n" + bytes(3 * 64 * 64))
    images = lambda: tables.scan_images(spark, str(folder)).withColumn("grade", F.lit(1))
    assert extract.extract_with_store(images(), store, small).count() == 4
    assert sorted(x for y in read for x in y) == ["eye +[0] {x}%.png", "eye +[1] {x}%.png", "eye +[2] {x}%.png", "old.ppm"]
    read.clear()
    (folder / "new.png").write_bytes(render.png(picture(4, size=64)))
    assert extract.extract_with_store(images(), store, small).count() == 5 and read == [["new.png"]]
    read.clear()
    assert extract.extract_with_store(images(), store, small).count() == 5 and read == []
    gone = spark.createDataFrame([("x", str(folder / "none.png")), ("y", str(folder / "new.png"))], "image_id string, image_path string")
    got = {r.image_id: r.extraction_ok for r in extract.extract(pixels(gone), small).collect()}
    assert got == {"x": 0, "y": 1}


@pytest.mark.parametrize("name", ["dummy_frequent", "dummy_stratified", "logreg", "ordinal_gbm"])
def test_models(spark, name, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 4))
    latent = 1.6 * x[:, 0] + 0.9 * x[:, 1] + rng.normal(0, 0.5, 160)
    y = np.digitize(latent, np.quantile(latent, [0.45, 0.65, 0.85, 0.95]))
    df = spark.createDataFrame([(str(k), int(g), *map(float, r)) for k, (g, r) in enumerate(zip(y, x, strict=True))], "image_id string, grade int, a double, b double, c double, d double")
    params = {"iterations": 8, "depth": 3} if "gbm" in name else {}
    model = models.fit(name, df, ["a", "b", "c", "d"], params, cv=2)
    out = model.transform(df)
    q = models.QwkEvaluator().evaluate(out)
    assert q > 0.6 if name in ("logreg", "ordinal_gbm") else q < 0.3
    assert out.where("prediction not between 0 and 4 or score is null").count() == 0
    if name == "logreg":
        model.save(str(tmp_path / "m"))
        again = models.Fitted.load(str(tmp_path / "m")).transform(df.drop("d"))
        assert again.count() == 160
        with pytest.raises(ValueError):
            models.fit(name, df.where("grade = 0"), ["a"])


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        models.fit("other", None, [])


def test_signature_follows_settings():
    from ocellus.cli import manifest_signature

    cfg = Config()
    assert manifest_signature(cfg) != manifest_signature(replace(cfg, data=replace(cfg.data, max_images=5)))
    assert manifest_signature(cfg) == manifest_signature(Config())


def test_train_and_report(spark, cohort, monkeypatch, capsys):
    """A report comes from what a training has stored, without another training."""
    from ocellus import cli

    got = cli.train(spark, cohort)
    assert set(got.summary["models"]) == {"dummy_frequent", "dummy_stratified", "logreg"} and got.summary["selected"] == "logreg"
    told = capsys.readouterr().out
    assert "* logreg" in told and "referral at a score" in told and "against baseline" in told
    monkeypatch.setattr(cli, "train", None)
    path = cli.report(spark, cohort)
    text = path.read_text()
    assert "chosen by cross-validation: **logreg**" in text and "## Leakage audit" in text
    names = {p.name for p in (path.parent / "tables").iterdir()}
    assert names >= {"class_distribution", "confusion", "score_quartiles", "roc", "pr", "point", "examples", "model_comparison.csv", "family_ablation.csv", "leakage.csv", "permutation_importance.csv"}
    shown = list((path.parent / "overlays").iterdir())
    grades = got.predictions.sparkSession.read.parquet(str(cohort.place("features").resolve())).select("grade").distinct().count()
    assert len(shown) == grades and render.unpng(shown[0].read_bytes()).shape == (96, 96, 3)
    stored = cli.stored(spark, cohort)
    pairs = lambda d: sorted((r.image_id, r.model, r.grade, r.prediction) for r in d.select("image_id", "model", "grade", "prediction").collect())
    assert pairs(stored.predictions) == pairs(got.predictions)
    assert [p.name for p in sorted(cohort.place("features").resolve().glob("*.parquet"))]


def test_helpers_of_the_driver(capsys):
    from ocellus import utils

    assert utils.get_logger("ocellus.cli").name == utils.get_logger("cli").name == "ocellus.cli" and utils.get_logger().name == "ocellus"
    utils.configure_console()
    assert utils.rng(3, "a", 1).random() == utils.rng(3, "a", 1).random() != utils.rng(3, "b", 1).random()

import json

import pytest
from pyspark.sql import functions as F

from kinmatch import config
from kinmatch.errors import ConfigurationError, ContractError, DataValidationError, FixtureError, OutputConflictError
from kinmatch.sources import files, sinks
from tests.conftest import rows

HEADER = "posting_id,image,image_phash,title,label_group\n"


def test_metadata_scan_splits_good_and_rejected(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(HEADER + "a, x.jpg ,ABCDEF0123456789, Áo đỏ ,g1\nb,dir/x.jpg,0000000000000000,t,g1\nc,C:\\x.jpg,0000000000000000,t,g1\nd,x.jpg,12,t,g1\ne,x.jpg,0000000000000000,,g1\nf,/etc/x,zz,t,g\n")
    good, bad = files.scan_metadata(spark, str(p))
    assert rows(good) == [("a", "x.jpg", "abcdef0123456789", "Áo đỏ", "g1")]
    assert {r["posting_id"]: r["reject_reason"] for r in bad.collect()} == {"b": "unsafe_image_path", "c": "unsafe_image_path", "d": "invalid_phash", "e": "missing_value", "f": "unsafe_image_path"}
    (tmp_path / "n.csv").write_text("posting_id,image\na,b\n")
    with pytest.raises(ContractError):
        files.scan_metadata(spark, str(tmp_path / "n.csv"))


def test_splits_must_match_metadata(spark):
    meta = spark.createDataFrame([("a", "i", "h", "t", "g1"), ("b", "i", "h", "t", "g1")], "posting_id string, image string, image_phash string, title string, label_group string")
    ok = spark.createDataFrame([("a", "train"), ("b", "train")], "posting_id string, split string")
    assert files.joined_splits(meta, ok).count() == 2 and files.one_split(meta, ok, "test").count() == 0
    with pytest.raises(DataValidationError):
        files.joined_splits(meta, ok.limit(1))
    with pytest.raises(DataValidationError):
        files.joined_splits(meta, spark.createDataFrame([("a", "train"), ("b", "test")], "posting_id string, split string"))
    assert "label_group" not in files.label_blind(meta).columns


def test_images_are_hashed_and_measured(spark, tmp_path):
    (tmp_path / "a.ppm").write_text("P3\n4 3\n255\n" + "0 " * 36)
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4) + (480).to_bytes(4))
    (tmp_path / "c.jpg").write_bytes(b"broken")
    images = files.scan_images(spark, str(tmp_path))
    assert {r["image"]: (r["width"], r["height"]) for r in images.collect()} == {"a.ppm": (4, 3), "b.png": (640, 480), "c.jpg": (None, None)}
    listed = spark.createDataFrame([("a.ppm",), ("z.ppm",)], "image string")
    assert dict(rows(files.image_findings(listed, images))) == {"missing_image": 1, "unreferenced_image": 2, "undecodable_image": 1}


def test_embedding_contract(spark):
    good = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [1.0, 0.0])], "id string, e array<float>")
    assert files.checked_embeddings(good, "id", "e", width=2).count() == 2
    for bad in ([("a", [0.0, 0.0])], [("a", [float("nan"), 1.0])], [("a", [1.0])], [("a", [1.0, 0.0]), ("a", [1.0, 0.0])], [("a", None)]):
        with pytest.raises(ContractError):
            files.checked_embeddings(spark.createDataFrame(bad, "id string, e array<float>"), "id", "e", width=2)
    with pytest.raises(ContractError):
        a = good.withColumnRenamed("e", "embedding")
        files.aligned_modalities(a, a.limit(1), "id")


def test_sinks_never_overwrite(spark, tmp_path):
    f = str(tmp_path / "r.md")
    assert sinks.write_once(f, "x") and not sinks.write_once(f, "x")
    with pytest.raises(OutputConflictError):
        sinks.write_once(f, "y")
    df = spark.createDataFrame([("p", "e", 2, 0.5, False)], files.ASSIGNMENTS)
    t = str(tmp_path / "a")
    assert sinks.write_assignments(df, t) and not sinks.write_assignments(df, t)
    assert rows(files.scan_assignments(spark, t)) == rows(df)
    with pytest.raises(OutputConflictError):
        sinks.write_assignments(df.withColumn("cluster_size", F.lit(3)), t)
    m = spark.createDataFrame([("b", "i", "g", "c", "train"), ("a", "i", "g", "c", "test")], files.MANIFEST)
    assert sinks.write_manifest(m, str(tmp_path / "m")) and rows(files.scan_manifest(spark, str(tmp_path / "m"))) == rows(m)


def test_negative_manifest_must_be_canonical(spark, tmp_path):
    row = {"left_posting_id": "a", "right_posting_id": "b", "left_label_group": "x", "right_label_group": "y", "cosine_similarity": 0.1, "pair_probability": 0.5, "variant_conflict": True, "left_identity_tokens": [], "right_identity_tokens": ["1"]}
    (tmp_path / "n.jsonl").write_text(json.dumps(row))
    assert files.scan_negatives(spark, str(tmp_path / "n.jsonl")).count() == 1
    (tmp_path / "w.jsonl").write_text(json.dumps(row | {"left_posting_id": "c"}))
    with pytest.raises(ContractError):
        files.scan_negatives(spark, str(tmp_path / "w.jsonl"))


def test_evidence_must_share_a_manifest(spark, tmp_path):
    for n, h in (("a", "1"), ("b", "1"), ("c", "2")):
        (tmp_path / f"{n}.json").write_text(json.dumps({"manifest_sha256": h, "map": 0.5}))
    p = [str(tmp_path / f"{n}.json") for n in "abc"]
    assert files.scan_evidence(spark, p[:2], ("manifest_sha256", "map")).count() == 2
    with pytest.raises(ContractError):
        files.scan_evidence(spark, p, ("manifest_sha256", "map"))


def test_configs_are_strict(tmp_path):
    ok = {"thresholds": [0.1, 0.5], "reciprocal_ranks": [5], "coverages": [0.5, 1.0], "override": 0.9, "maximum_size": 64, "margin": 0.05}
    assert len(config.build(config.ClusterConfig, ok).settings()) == 4
    for wrong in ({"extra": 1}, {"thresholds": [0.5, 0.1]}, {"override": 0.05}, {"maximum_size": "many"}):
        with pytest.raises(ConfigurationError):
            config.build(config.ClusterConfig, ok | wrong)
    with pytest.raises(ConfigurationError):
        config.build(config.RetrievalConfig, {"metric_ks": [1, 50], "candidate_k": 20, "target_recall": 0.9})
    with pytest.raises(ConfigurationError):
        config.build(config.RetrievalConfig, {"metric_ks": [1], "candidate_k": 20, "target_recall": 0.9, "split": "test"})
    for bad in ("../x", "/x", "C:\\x"):
        with pytest.raises(ConfigurationError):
            config.safe_relative(bad)
    f = tmp_path / "c.json"
    f.write_text('{"a": 1}')
    assert config.read_mapping(str(f)) == {"a": 1}
    with pytest.raises(ConfigurationError):
        config.verified(str(f), "0" * 64)


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5)], "name string, value double")
    text = sinks.markdown_report("R", {"T": df})
    assert "| a | 0.5 |" in text and "<svg" in sinks.bar_svg("b", [("x", 1.0)]) and "polyline" in sinks.curve_svg("c", {"p": [(0, 0), (1, 1)]})
    with pytest.raises(ValueError):
        sinks.markdown_report("R", {"T": spark.range(60)})


def test_fixture_sizes(spark):
    df = spark.createDataFrame([(f"p{i}", f"g{i // 2}") for i in range(6)], "posting_id string, label_group string")
    files.check_fixture(df, 6, {2: 3})
    with pytest.raises(FixtureError):
        files.check_fixture(df, 6, {3: 2})

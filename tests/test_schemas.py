import pytest

from packetlens.sources import schemas as S


def test_names():
    assert S.field_column("frame.time_epoch") == "frame_time_epoch"
    headers = ["  Flow Bytes/s ", "a  b", "a\u00a0c\t", "\u3000Ä/ö"]
    assert S.flow_columns(headers) == ["flow_bytes_s", "a__b", "a_c", "ä_ö"]
    with pytest.raises(ValueError, match="a_b"):
        S.flow_columns(["A b", "a/b"])


def test_feature_schema_round_trip(spark, tmp_path):
    path = str(tmp_path / "features")
    assert S.read_feature_schema(spark, path) is None
    S.write_feature_schema(spark, ["a", "b.1", "ü"], path)
    assert S.read_feature_schema(spark, path) == ["a", "b.1", "ü"]


@pytest.mark.parametrize("text", ['{"feature_columns": ["a", "b"]}', '[\n  "a",\n  "b"\n]'])
def test_feature_schema_forms(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    assert S.read_feature_schema(spark, str(tmp_path / "f.json")) == ["a", "b"]


@pytest.mark.parametrize(
    "text,fault",
    [
        ('{"other": []}', "no list"),
        ('{"feature_columns": "a"}', "no list"),
        ("[1, 2]", "no texts"),
        ('["a", null]', "no texts"),
        ('"a"', "no list"),
        ("[broken", "no JSON"),
    ],
)
def test_bad_feature_schema(spark, tmp_path, text, fault):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(ValueError, match=fault):
        S.read_feature_schema(spark, str(tmp_path / "f.json"))


def test_several_schema_files_are_an_error(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text('["x"]')
    with pytest.raises(ValueError, match="One schema file"):
        S.read_feature_schema(spark, str(tmp_path))


def test_model_columns_precedence(spark):
    table = spark.createDataFrame(
        [("s", 1.0, True, 0, "x")],
        "name string, a double, b boolean, is_anomaly int, attack_type string",
    )
    assert S.model_columns(table, ["e"], ["s"], ["t"]) == ["e"]
    assert S.model_columns(table, [], ["s"], ["t"]) == ["s"]
    assert S.model_columns(table, None, None, ["t"]) == ["t"]
    assert S.model_columns(table) == ["a", "b"]
    with pytest.raises(ValueError):
        S.model_columns(table.select("name"))


def test_require(spark):
    with pytest.raises(ValueError, match="'x'"):
        S.require_columns(spark.range(1), ["id", "x"])
    with pytest.raises(ValueError, match="empty"):
        S.require_rows(spark.range(0), "go on")

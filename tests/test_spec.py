import json

import pytest

from zonewright import CastRule, JobSpec, Zone
from zonewright.plans.spec import load_config

CONFIG = {
    "ingest-people": {
        "source": {"file-format": "csv", "data-location": "/landing"},
        "destination": {"data-location": "/raw"},
    },
    "mask-people": {
        "source": {"file-format": "csv", "data-location": "/raw"},
        "destination": {"file-format": "parquet", "data-location": "/staging"},
        "masking-cols": ["_c0", "_c1"],
        "datatype-update-cols": ["_c2:DecimalType:StringType:3"],
        "partition-cols": ["_c1"],
    },
    "people-pii-cols": ["_c0"],
    "people-lookup_dataset": "/lookup/people",
}


def test_rules_are_read():
    assert CastRule.parse("c:DecimalType:x:3") == CastRule("c", "decimal", 3)
    assert CastRule.parse("c:StringType:ArrayType") == CastRule("c", "array")
    assert CastRule.parse("c:StringType:x") == CastRule("c", "string")


@pytest.mark.parametrize(
    "text",
    [
        "c",
        "c:StringType",
        "c:IntegerType:x",
        "c:DecimalType:x",
        "c:DecimalType:x:a",
        "c:DecimalType:x:11",
        "c:DecimalType:x:-1",
    ],
)
def test_bad_rules_raise(text):
    with pytest.raises(ValueError):
        CastRule.parse(text)


def test_unknown_kind_and_format_raise():
    with pytest.raises(ValueError):
        CastRule("c", "integer")
    with pytest.raises(ValueError):
        Zone("/x", "orc")


def test_config_file_to_spec(spark, tmp_path):
    path = tmp_path / "app.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    spec = JobSpec.from_config(load_config(spark, str(path)), "people", lookup_distinct=True)
    assert spec.landing == Zone("/landing", "csv")
    assert spec.raw == Zone("/raw", "csv")  # the source format, unless the zone names one
    assert spec.staging_source == Zone("/raw", "csv")
    assert spec.staging == Zone("/staging", "parquet")
    assert spec.cast_rules == (CastRule("_c2", "decimal", 3),)
    assert spec.partition_cols == ("_c1",)
    assert spec.pii_cols == ("_c0",)
    assert spec.lookup_path == "/lookup/people"
    assert spec.lookup_distinct


def test_a_destination_format_is_honoured():
    config = json.loads(json.dumps(CONFIG))
    config["ingest-people"]["destination"]["file-format"] = "parquet"
    assert JobSpec.from_config(config, "people").raw == Zone("/raw", "parquet")


def test_missing_keys_raise():
    with pytest.raises(KeyError):
        JobSpec.from_config(CONFIG, "other")


def test_unmasked_pii_and_missing_lookup_raise():
    config = json.loads(json.dumps(CONFIG))
    config["people-pii-cols"] = ["_c9"]
    with pytest.raises(ValueError, match="not in masking-cols"):
        JobSpec.from_config(config, "people")
    with pytest.raises(ValueError, match="lookup path"):
        JobSpec("d", Zone("/a"), Zone("/b"), Zone("/c"), ("x",), pii_cols=("x",))
    with pytest.raises(ValueError, match="to follow"):
        JobSpec("d", Zone("/a"), Zone("/b"), Zone("/c"), ("x",), lookup_keys=("k",))


def test_further_fields_of_a_rule_mean_nothing():
    assert CastRule.parse("c:StringType:ArrayType:0").kind == "array"
    assert CastRule.parse("c:StringType:IntegerType:0").kind == "string"
    assert CastRule.parse("c:DecimalType:DoubleType:2:x") == CastRule("c", "decimal", 2)

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark import Converters, Rules, SyncSpec
from tidemark.operators import RuleError, check_rules, map_paths, rule_errors, rules, with_converter
from tidemark.plans import SpecError
from tests.helpers import manifest

GOOD = {
    "sync": {"copy_unmatched": False, "source_exclude": ["*.log"], "target_exclude": ["*.m3u"]},
    "converters": {"thumb": {"command": ["shrink", "--to={output}", "{input}"]}},
    "mappings": {".tiff": {"converter": "thumb", "output_ext": ".webp"}},
}


def config(tmp_path, **changes):
    (tmp_path / "in").mkdir(exist_ok=True)
    general = {"source": str(tmp_path / "in"), "target": str(tmp_path / "out"), **GOOD["sync"]}
    return {**GOOD, "sync": general, **changes}


def codes(found):
    return sorted((row.rule, row.subject, row.code) for row in rule_errors(found).collect())


def test_full_config(spark, tmp_path):
    spec = SyncSpec.from_config(spark, config(tmp_path))
    assert (spec.copy_unmatched, spec.source_exclude, spec.target_exclude) == (False, ("*.log",), ("*.m3u",))
    assert spec.converters.commands == {"thumb": ["shrink", "--to={output}", "{input}"]}
    check_rules(spec.rules)


def test_defaults_and_unknown_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = f'[sync]\nsource = "{tmp_path}/in"\ntarget = "{tmp_path}/out"\ncolour = "red"\n'
    spec = SyncSpec.from_toml(spark, text.encode())
    assert (spec.copy_unmatched, spec.source_exclude, spec.modify_window) == (True, (), 0)
    assert spec.rules.mappings.count() == spec.rules.converters.count() == 0
    check_rules(spec.rules)


def test_config_arguments_are_checked(spark, tmp_path):
    good = config(tmp_path)
    file = tmp_path / "file"
    file.write_text("x")
    for changes, message in [
        ({"sync": {"target": "/t"}}, "missing field sync.source"),
        ({"sync": {"source": str(tmp_path)}}, "missing field sync.target"),
        ({"sync": {**good["sync"], "source": str(tmp_path / "nowhere")}}, "not an existing directory"),
        ({"sync": {**good["sync"], "source": str(file)}}, "not an existing directory"),
        ({"sync": {**good["sync"], "target": str(file)}}, "not a directory"),
        ({"sync": {**good["sync"], "target": str(tmp_path / "in" / "sub")}}, "overlap"),
    ]:
        with pytest.raises(SpecError, match=message):
            SyncSpec.from_config(spark, {**good, **changes})
    with pytest.raises(SpecError, match="not TOML"):
        SyncSpec.from_toml(spark, "[sync")
    with pytest.raises(SpecError, match="not UTF-8"):
        SyncSpec.from_toml(spark, b"\xff")
    with pytest.raises(SpecError, match="on_conflict"):
        SyncSpec.from_config(spark, good, on_conflict="last")
    with pytest.raises(ValueError, match="unclosed"):
        SyncSpec.from_config(spark, {**good, "sync": {**good["sync"], "source_exclude": ["[a"]}})


def test_key_normalization(spark):
    mapped = [("csv", "c", "json"), (".Xml", "c", None), (".TIFF", "c", ".WebP"), ("", "c", "")]
    found = rules.normalized_mappings(Rules.of(spark, mapped).mappings).collect()
    assert [(row.ext, row.output_ext) for row in found] == [
        (".csv", ".json"), (".xml", ".xml"), (".tiff", ".webp"), (".", "."),
    ]


def test_every_violation_is_found(spark):
    found = Rules.of(
        spark,
        [("csv", "thumb", None), (".CSV", "thumb", "x"), ("a", None, None), ("b", "nowhere", None)],
        [
            ("thumb", "command", ["x", "{input}"]),
            ("none", "command", None),
            ("empty", "command", []),
            ("open", "command", ["ok", "{input", "}"]),
            ("close", None, ["a}"]),
            ("name", "command", ["{nom}"]),
            ("twice", "udf", None),
            ("twice", "expression", None),
        ],
    )
    assert codes(found) == [
        ("converter", "close", "invalid_template"),
        ("converter", "empty", "empty_command"),
        ("converter", "name", "invalid_template"),
        ("converter", "none", "missing_command"),
        ("converter", "open", "invalid_template"),
        ("converter", "twice", "duplicate_converter"),
        ("mapping", ".a", "missing_converter"),
        ("mapping", ".b", "undefined_converter"),
        ("mapping", ".csv", "duplicate_mapping"),
    ]
    messages = {row.subject: row.message for row in rule_errors(found).collect()}
    assert messages["open"] == "unmatched_open at byte 0 of {input"
    assert messages["name"] == "unknown_variable at byte 0 of {nom}"
    for bounded in (True, None):
        with pytest.raises(RuleError, match="undefined converter nowhere"):
            check_rules(replace(found, bounded=bounded))


def test_expression_converters_need_no_command(spark):
    converters = Converters().register("up", F.upper).register_udf("same", lambda content: content)
    assert codes(converters.rules(spark, [("txt", "up", None), ("bin", "same", None)])) == []


@pytest.mark.parametrize("limit", [10_000, 0])
def test_rule_joins_agree_whether_broadcast_or_salted(spark, monkeypatch, limit):
    monkeypatch.setattr(rules, "MAX_BROADCAST_RULES", limit)
    found = Rules.of(spark, [("a", "one", "b"), ("c", "two", None)], [("one", "command", ["x"]), ("two", "command", ["y"])])
    source = manifest(spark, {f"d/{n}.{'aAcz'[n % 4]}": n for n in range(40)})
    mapped = map_paths(source, found.mappings)
    rows = {row.rel_path: (row.converter, row.target_path) for row in mapped.collect()}
    assert len(rows) == mapped.count() == 40
    assert rows["d/0.a"] == ("one", "d/0.b")
    assert rows["d/1.A"] == ("one", "d/1.b")
    assert rows["d/2.c"] == ("two", "d/2.c")
    assert rows["d/3.z"] == (None, "d/3.z")
    assert with_converter(mapped, found.converters).count() == 30
    plan = mapped._jdf.queryExecution().toString()
    assert ("_salt" in plan) == (limit == 0)

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import payload
from tidemark import Converters
from tidemark.operators import ledger, transform, transform_in_workers
from tidemark.sources import load_payload


def items(spark, contents, converter, target_ext=".out"):
    work = spark.createDataFrame([(path, converter) for path in contents], "rel_path string, converter string").select(
        "rel_path",
        F.concat("rel_path", F.lit(target_ext)).alias("target_path"),
        F.when(F.col("converter").isNull(), "copy").otherwise("convert").alias("action"),
        "converter",
        F.lit("x").alias("kind"),
        F.timestamp_seconds(F.lit(1)).alias("mtime"),
        F.lit(0o640).alias("mode"),
    )
    return load_payload(payload(spark, contents), work)


def in_workers(spark, contents, converters, name, **options):
    table = converters.rules(spark, ()).converters
    done = transform_in_workers(items(spark, contents, name), table, converters, **options).collect()
    return {row.rel_path: (row.status, row.exit_code, row.message, row.content and bytes(row.content)) for row in done}


def test_expressions_and_copies(spark):
    converters = Converters().register("hex", lambda content: F.hex(content).cast("binary")).register("none", lambda _: F.lit(None))
    rows = {}
    for name in ("hex", "none", None):
        rows[name] = transform(items(spark, {"a": "\x01"}, name), converters).first()
    assert (rows["hex"].status, bytes(rows["hex"].content), rows["hex"].size) == ("ok", b"01", 2)
    assert (rows["none"].status, rows["none"].message, rows["none"].content) == ("failed", "no output", None)
    assert (rows[None].status, bytes(rows[None].content), rows[None].mode) == ("ok", b"\x01", 0o640)


def test_empty_output_is_a_failure_unless_allowed(spark):
    converters = Converters().register("empty", lambda _: F.lit("").cast("binary"))
    row = transform(items(spark, {"a": "x"}, "empty"), converters).first()
    assert (row.status, row.message) == ("failed", "empty output")
    assert transform(items(spark, {"a": "x"}, "empty"), converters, allow_empty=True).first().status == "ok"
    # copying an empty file is fine
    assert transform(items(spark, {"a": ""}, None), converters).first().status == "ok"


def test_a_udf_failure_stays_with_its_row(spark):
    def picky(content: pd.Series) -> pd.Series:
        if (content == b"bad").any():
            raise ValueError("cannot read")
        return content.map(lambda data: data[::-1])

    contents = {f"f{n}": "bad" if n == 3 else f"{n}x" for n in range(8)}
    found = in_workers(spark, contents, Converters().register_udf("rev", picky), "rev")
    assert found["f3"] == ("failed", None, "cannot read", None)
    assert all(found[f"f{n}"] == ("ok", None, None, f"x{n}".encode()) for n in range(8) if n != 3)


@pytest.mark.parametrize(
    ("command", "expected"),
    [
        (["cp", "{input}", "{output}"], ("ok", 0, None, b"data")),
        (["false"], ("failed", 1, "command failed", None)),
        (["sh", "-c", "echo ' {stem}|{ext} ' >&2; exit 7"], ("failed", 7, "a.b|.Ext", None)),
        (["sh", "-c", "printf '{{{stem}}}' > {output}"], ("ok", 0, None, b"{a.b}")),
        (["sh", "-c", "ls {output} 2>/dev/null; echo {output} > {output}"], ("ok", 0, None, b"out/data.out\n")),
        (["true"], ("failed", 0, "empty output", None)),
        (["sh", "-c", "kill -9 $$"], ("failed", -1, "command failed", None)),
        (["sh", "-c", r"printf 'caf\351' >&2; exit 1"], ("failed", 1, "caf�", None)),
        (["sleep", "30"], ("failed", -1, "timed out after 1 s", None)),
        (["{nothing}"], ("failed", None, "malformed command template", None)),
    ],
)
def test_commands(spark, command, expected):
    converters = Converters().register_command("cmd", command)
    found = in_workers(spark, {"d/a.b.Ext": "data"}, converters, "cmd", timeout=1.0)
    assert found == {"d/a.b.Ext": expected}


def test_missing_program(spark):
    found = in_workers(spark, {"a": "x"}, Converters().register_command("cmd", ["/no/such/program"]), "cmd")
    status, code, message, content = found["a"]
    assert (status, code, content) == ("failed", None, None)
    assert message.startswith("not started")


def test_names_with_spaces_and_non_ascii(spark):
    copy = Converters().register_command("cmd", ["cp", "{input}", "{output}"])
    found = in_workers(spark, {"d/ä b;$(x).flac": "data", "-rf": "y"}, copy, "cmd")
    assert {status for status, *_ in found.values()} == {"ok"}


def test_udfs_and_commands_share_one_pass(spark):
    converters = Converters().register_udf("up", lambda content: content.map(bytes.upper)).register_command("cp", ["cp", "{input}", "{output}"])
    table = converters.rules(spark, ()).converters
    both = items(spark, {"a": "x"}, "up").unionByName(items(spark, {"b": "y"}, "cp"))
    done = transform_in_workers(both, table, converters)
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {row.rel_path: bytes(row.content) for row in done.collect()} == {"a": b"X", "b": b"y"}


def test_a_ledger_holds_finished_outputs(tmp_path, monkeypatch):
    first = ledger.Ledger(str(tmp_path), 3, 1e9)
    monkeypatch.setattr(ledger, "SEGMENT_BYTES", 4)
    keys = [ledger.digest(["x", "y"], "in", "out", content) for content in (b"a", b"b", b"", b"c")]
    assert ledger.digest(["xy"], "in", "out", b"a") not in keys and len(set(keys)) == 4
    for key, output in zip(keys, (b"12345", b"1", b"", b"123"), strict=False):
        first.add(key, "path", output)
    assert len(list((tmp_path / "part-000003").iterdir())) == 2 and not first.pending
    first.add(b"more", "path", b"1")
    first.flush()
    (tmp_path / "part-000003" / "cut.part").write_bytes(b"PAR1")
    for root in (str(tmp_path), tmp_path.as_uri()):
        second = ledger.Ledger(root, 3, 0)
        assert [second.get(key) for key in (*keys, b"more", b"none")] == [b"12345", b"1", b"", b"123", b"1", None]
        assert ledger.Ledger(root, 4, 0).get(keys[0]) is None

import random

from pyspark.sql import functions as F
import pytest

from tidemark.functions import (
    file_ext,
    file_stem,
    is_fresh,
    join_base,
    normalize_ext,
    parent_dir,
    raw_ext,
    rel_path,
    target_path,
    version_gap,
    with_extension,
)
from tidemark.functions.paths import path_order


def evaluate(spark, column, values, schema):
    rows = [(number, *value) if isinstance(value, tuple) else (number, value) for number, value in enumerate(values)]
    found = spark.createDataFrame(rows, "n int, " + schema).select("n", column.alias("v")).collect()
    return [row.v for row in sorted(found, key=lambda row: row.n)]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: raw_ext("p"), ["", ".", ".gz", ".GZ", "", ".foo", "", ".x", "", ""]),
        (lambda: file_ext("p"), ["", ".", ".gz", ".gz", "", ".foo", "", ".x", "", ""]),
        (lambda: file_stem("p"), [".bashrc", "foo", "a.tar", "A.TAR", "plain", ".", "c", ".h", "é", ""]),
        (
            lambda: with_extension("p", F.lit(".opus")),
            [".bashrc.opus", "d/foo.opus", "a.tar.opus", "x.y/A.TAR.opus", "plain.opus", "..opus", "b.d/c.opus", ".h.opus",
             "é.opus", ".opus"],
        ),
        (
            lambda: with_extension("p", F.lit(".")),
            [".bashrc", "d/foo", "a.tar", "x.y/A.TAR", "plain", ".", "b.d/c", ".h", "é", ""],
        ),
        (lambda: parent_dir("p"), [None, "d", None, "x.y", None, None, "b.d", None, None, None]),
    ],
)
def test_path_parts(spark, column, expected):
    paths = [".bashrc", "d/foo.", "a.tar.gz", "x.y/A.TAR.GZ", "plain", "..foo", "b.d/c", ".h.x", "é", ""]
    assert evaluate(spark, column(), paths, "p string") == expected


def test_normalize_ext(spark):
    assert evaluate(spark, normalize_ext("e"), ["csv", ".Xml", ".TIFF", "", "."], "e string") == [
        ".csv", ".xml", ".tiff", ".", ".",
    ]


def test_target_path_changes_only_mapped_extensions(spark):
    cases = [
        ("a/song.FLAC", ".flac", ".opus"),
        ("PHOTO.JPG", ".jpg", ".jpg"),
        ("notes.TXT", ".txt", None),
        ("x.flac", ".flac", "."),
    ]
    column = target_path("p", "e", "o")
    assert evaluate(spark, column, cases, "p string, e string, o string") == ["a/song.opus", "PHOTO.JPG", "notes.TXT", "x"]


def test_rel_path_inverts_join_base(spark):
    joined = join_base(F.lit("/data/in"), "p")
    assert evaluate(spark, rel_path(joined, "/data/in"), ["a/b", "c"], "p string") == ["a/b", "c"]
    assert evaluate(spark, rel_path(joined, "/data/in/"), ["a/b"], "p string") == ["a/b"]
    with pytest.raises(Exception, match="not below"):
        evaluate(spark, rel_path("p", "/data/in"), ["/data/input/a"], "p string")


def test_path_order_is_component_wise(spark):
    generator = random.Random(7)
    paths = {"a", "a/b", "a-b", "a/b/c", "a/b-c", "A", "a.b", "a b", "é/x", "é", "z!"}
    paths |= {"".join(generator.choice("a/b-. !é") for _ in range(generator.randint(1, 8))) for _ in range(400)}
    frame = spark.createDataFrame([(path,) for path in paths], "p string")
    ordered = [row.p for row in frame.orderBy(path_order("p"), "p").collect()]
    assert ordered == sorted(paths, key=lambda path: [part.encode() for part in path.split("/")])


@pytest.mark.parametrize(
    ("window", "fresh"),
    [
        # target minus source: 0, +0.4 s, +1 s, -1 s, +2.6 s over a second boundary, -0.5 s before the epoch
        (-1, [True, False, False, False, False, False]),
        (0, [True, True, False, False, False, False]),
        (1, [True, True, True, True, False, True]),
        (3, [True, True, True, True, True, True]),
    ],
)
def test_freshness_windows(spark, window, fresh):
    pairs = [
        (10_000_000, 10_000_000),
        (10_400_000, 10_000_000),
        (11_000_000, 10_000_000),
        (9_000_000, 10_000_000),
        (13_000_000, 10_400_000),
        (-500_000, 0),
    ]
    t, s = F.timestamp_micros("t"), F.timestamp_micros("s")
    assert evaluate(spark, is_fresh(t, s, window), pairs, "t long, s long") == fresh
    assert evaluate(spark, version_gap(t, s), pairs, "t long, s long") == [0, 0, 1, 1, 3, 1]



import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import render_template, template_error


VARIABLES = {"a": "{x}", "": "empty", "aé": "Ü"}
#: parts with what each one becomes, and endings with the code and name of their error
PARTS = [("{a}", "{x}"), ("{}", "empty"), ("{aé}", "Ü"), ("{{", "{"), ("}}", "}"), ("plain", "plain"), ("é", "é"), ("\n", "\n")]
BREAKS = [("{nope}", "unknown_variable", "nope"), ("{open", "unmatched_open", None), ("}shut", "unmatched_close", None)]


@st.composite
def built(draw):
    """A template put together from known parts, and its text or its error as (code, byte offset, name)."""
    parts = draw(st.lists(st.sampled_from(PARTS), max_size=8))
    template = "".join(part for part, _ in parts)
    broken = draw(st.none() | st.sampled_from(BREAKS))
    if broken is None:
        return template, "".join(text for _, text in parts)
    ending, code, name = broken
    after = "" if code == "unmatched_open" else draw(st.text("{}aé\n", max_size=5))  # only the first error counts
    return template + ending + after, (code, len(template.encode()), name)


def by_spark(spark, templates, variables):
    # the variables travel in a column, so that nothing is folded away
    frame = spark.createDataFrame([(n, t, variables) for n, t in enumerate(templates)], "n int, t string, v map<string,string>")
    rows = frame.select(
        "n",
        render_template(F.array("t"), F.col("v"))[0].alias("text"),
        template_error("t", list(variables)).alias("error"),
    ).collect()
    out = []
    for row in sorted(rows, key=lambda row: row.n):
        assert (row.text is None) == (row.error is not None)
        out.append(row.text if row.error is None else tuple(row.error))
    return out


@pytest.mark.parametrize(
    ("template", "expected"),
    [
        ("{input}", "in/new report.md"),
        ("{ext}-{stem}", "md-report"),
        ("{{braced}}", "{braced}"),
        ("<{{{{{stem}}}}}>", "<{{report}}>"),
        ("{stem}{stem} {ext}", "reportreport md"),
        ("--quiet", "--quiet"),
        ("", ""),
        ("{volume}", ("unknown_variable", 0, "volume")),
        ("x {stem", ("unmatched_open", 2, None)),
        ("tail}x", ("unmatched_close", 4, None)),
        ("{{{ext}}}", "{md}"),
        ("{ }", ("unknown_variable", 0, " ")),
        ("ß{ext}{stem}", "ßmdreport"),
        ("q}}z{ext}", "q}zmd"),
        ("ü{codec}", ("unknown_variable", 2, "codec")),
        ("öö}", ("unmatched_close", 4, None)),
        ("{b{ext}", ("unknown_variable", 0, "b{ext")),
        ("two\n{ext}\n", "two\nmd\n"),
    ],
)
def test_known_cases(spark, template, expected):
    variables = {"input": "in/new report.md", "stem": "report", "ext": "md"}
    assert by_spark(spark, [template], variables) == [expected]


@settings(max_examples=8, deadline=None)
@given(st.lists(built(), min_size=20, max_size=60))
def test_templates_of_known_parts(spark, cases):
    assert by_spark(spark, [template for template, _ in cases], VARIABLES) == [expected for _, expected in cases]


def test_array_template(spark):
    variables = F.create_map(F.lit("input"), F.lit("in"), F.lit("output"), F.lit("out"))
    frame = spark.createDataFrame([(["-i", "{input}", "{output}"],), ([],), (["ok", "{volume}"],)], "t array<string>")
    assert [row[0] for row in frame.select(render_template("t", variables)).collect()] == [["-i", "in", "out"], [], None]

import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import GlobError, glob_to_regex, matches_glob
from tidemark.functions.globs import glob_regex


def matches(pattern: str, path: str) -> bool:
    return re.fullmatch(glob_regex(pattern), path, re.DOTALL) is not None


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.log", ["a.log", "d/e.log", ".log"], ["a.log.txt", "alog"]),
        ("tmp", ["tmp"], ["tmp/a.txt", "a/tmp"]),
        ("tmp*", ["tmp", "tmp/a.txt"], ["a/tmp"]),
        ("a?c", ["abc", "a/c"], ["ac", "abbc"]),
        ("**/x", ["x", "a/x", "a/b/x"], ["ax", "x/a"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "ab"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("**", ["", "a", "a/b"], []),
        ("[a-c]x", ["ax", "cx"], ["dx", "x"]),
        ("[!a-c]x", ["dx", "/x"], ["ax"]),
        ("[]x]", ["]", "x"], ["a"]),
        ("[a-]", ["a", "-"], ["b"]),
        ("{a,b*}.z", ["a.z", "bcd.z"], ["c.z"]),
        ("{a,{b,c}}d", ["ad", "bd", "cd"], ["d"]),
        ("{,a}b", ["ab"], ["b"]),
        (r"\*.z", ["*.z"], ["a.z"]),
        ("a.b+c", ["a.b+c"], ["axb+c", "a.bbc"]),
        ("a,b", ["a,b"], ["a", "b"]),
        ("É*", ["Éa"], ["éa"]),
        ("*.txt", ["a\n.txt"], ["a.txt\n"]),
    ],
)
def test_dialect(pattern, yes, no):
    for path in yes:
        assert matches(pattern, path), path
    for path in no:
        assert not matches(pattern, path), path


@pytest.mark.parametrize("pattern", ["[abc", "{a,b", "a}", "[z-a]", "a\\", "[]"])
def test_invalid_patterns(pattern):
    with pytest.raises(GlobError):
        glob_to_regex([pattern])
    assert glob_to_regex([pattern], strict=False) is None


def brute_force(pattern: str, path: str) -> bool:
    """Stars and question marks only."""
    if not pattern:
        return not path
    if pattern[0] == "*":
        return any(brute_force(pattern[1:], path[n:]) for n in range(len(path) + 1))
    return bool(path) and pattern[0] in ("?", path[0]) and brute_force(pattern[1:], path[1:])


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?", max_size=6), st.text("ab/", max_size=6))
def test_wildcards_against_brute_force(pattern, path):
    assert matches(pattern, path) == brute_force(pattern, path)


def test_column_predicate_agrees_with_regex(spark):
    paths = ["".join(chars) for size in range(1, 5) for chars in product("a./\n", repeat=size)]
    frame = spark.createDataFrame([(path,) for path in paths], "p string")
    for patterns in (["*.a"], ["a*"], ["*a*"], ["a"], ["*"], ["a**"], ["**/a"], ["a/**"], ["*.a", "?", "a/[.a]"], []):
        found = {row.p for row in frame.filter(matches_glob("p", patterns)).collect()}
        assert found == {path for path in paths if any(matches(pattern, path) for pattern in patterns)}, patterns
        regex = glob_to_regex(patterns)
        if regex:
            assert found == {row.p for row in frame.filter(frame.p.rlike(regex)).collect()}, patterns


def test_simple_patterns_need_no_regex(spark):
    frame = spark.createDataFrame([("a",)], "p string")
    text = frame.filter(matches_glob("p", ["*.log", "tmp*", "*x*", "a/b"]))._jdf.queryExecution().toString()
    assert "RLIKE" not in text.upper()
    assert all(test in text for test in ("EndsWith", "StartsWith", "Contains"))


def test_many_globs_agree_with_each_of_them(spark):
    import random

    from tidemark.functions.globs import MANY, GlobIndex, compile_globs, glob_regex, required_literal

    rng = random.Random(9)

    def word():
        return "".join(rng.choice("abcé.") for _ in range(rng.randrange(1, 5)))

    shapes = ["{0}", "*{0}", "{0}*", "*{0}*", "{0}/?{1}", "*/{0}[a-c]{1}", "{{{0},{1}}}*x", "**/{0}", "{0}/**/{1}*", "\\*{0}", "?"]
    globs = [rng.choice(shapes).format(word(), word()) for _ in range(400)]
    paths = ["/".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(600)] + ["", "*ab", "x", "line\n", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert len(globs) > MANY
    for some in (globs, [g for g in globs if g != "?"][:90]):
        regexes = [re.compile(rf"(?s)\A(?:{glob_regex(g)})\Z") for g in some]
        want = [None if p is None else any(r.match(p) for r in regexes) for p in paths]
        found = [row.m for row in df.select(matches_glob("p", some).alias("m")).collect()]
        assert [bool(m) for m in found] == [bool(m) for m in want]
    for g in globs:
        literal = required_literal(g)
        assert all(literal in p for p in paths if p and re.match(rf"(?s)\A(?:{glob_regex(g)})\Z", p))
    index = GlobIndex(compile_globs([f"*dir{n}/*.part?" for n in range(5000)]))
    assert index.matches("a/dir4999/x.part1") and not index.matches("a/dir5000/x.part1") and index.always is None
    assert max(map(len, index.by_gram.values())) < 1200


def test_plain_globs_need_no_python(spark):
    df = spark.range(10).selectExpr("cast(id as string) p")
    plan = df.where(matches_glob("p", [f"*.e{n}" for n in range(300)] + [f"d{n}/*" for n in range(300)] + ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "RLIKE" not in plan.upper() and "INSET" in plan

"""Sources, targets and rule tables derived from the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import file_stem
from tidemark.operators import Converters, Rules, map_paths
from tidemark.sources import latest_versions, manifest_from

EPOCH_US = 1_704_067_200_000_000
DOC_SUFFIXES = (".flac", ".FLAC", ".png", ".txt", ".tar.gz", "")
DOC_MAPPINGS = [(".flac", "opus", ".opus"), (".png", "jpg", ".jpg"), (".gz", "gz", ".gz")]
PROTECTED = ("*.m3u",)
MANIFEST = ("rel_path", "mtime", "size", "mode")

#: templates from well-formed to malformed; rows pick one by number
TEMPLATES = [
    "--from={input}",
    "{ext}-{stem}",
    "{{braced}}",
    "<{{{{{input}}}}}>",
    "{volume}",
    "x {stem",
    "tail}x",
    "{{{ext}}}",
    "{ }",
    "ß{ext}{stem}",
    "q}}z{ext}",
    "ü{codec}",
    "öö}",
    "--quiet",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(column: Column) -> Column:
    return F.unix_micros(column)


# --- documents: files under source/lang ---------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: manifest columns, ``doc_id`` and the text as ``content``."""
    doc_id = F.col("doc_id")
    suffix = F.lit(DOC_SUFFIXES[-1])
    for number, text in reversed(list(enumerate(DOC_SUFFIXES[:-1]))):
        suffix = F.when(doc_id % 6 == number, text).otherwise(suffix)
    return read(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), doc_id.cast("string"), suffix).alias("rel_path"),
        F.timestamp_micros(F.lit(EPOCH_US) + doc_id * 1_000_000 + (doc_id % 1000) * 1000).alias("mtime"),
        F.col("n_chars").alias("size"),
        (doc_id % 512).cast("int").alias("mode"),
        doc_id,
        F.col("text").alias("content"),
    )


def doc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(*MANIFEST)


def doc_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("rel_path", "content")


def doc_mappings(spark: SparkSession) -> DataFrame:
    return Rules.of(spark, DOC_MAPPINGS).mappings


def doc_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_paths(documents(spark, sf_dir).drop("content"), doc_mappings(spark))


def doc_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the target: partly missing, partly off in its versions, with extra files."""
    doc_id, mtime = F.col("doc_id"), F.col("mtime")
    shifted = (
        F.when(doc_id % 11 == 0, F.timestamp_micros(micros(mtime) + 1_400_000))
        .when(doc_id % 13 == 0, F.timestamp_micros(micros(mtime) - 3_600_000_000))
        .when(doc_id % 5 == 0, F.timestamp_seconds(F.unix_seconds(mtime)))
        .otherwise(mtime)
    )
    present = (
        doc_work(spark, sf_dir)
        .filter((doc_id % 7 != 0) & ~F.col("target_path").startswith("src3/"))
        .select(F.col("target_path").alias("rel_path"), shifted.alias("mtime"), "size", "mode")
    )
    extra = documents(spark, sf_dir).filter(doc_id % 17 == 0)
    suffix = F.when(doc_id % 2 == 0, ".m3u").otherwise(".opus")
    path = F.concat(F.lit("orphans/"), (doc_id % 4).cast("string"), F.lit("/"), doc_id.cast("string"), suffix)
    return present.unionByName(extra.select(path.alias("rel_path"), "mtime", "size", "mode"))


# --- events: newest event per user and type -----------------------------------------------------------


def event_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State now, and an earlier state of most users."""
    events = read(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    state = partial(manifest_from, key=key, version="ts")
    earlier = events.filter((F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")) & (F.col("user_id") % 10 != 3))
    return latest_versions(state(events)), latest_versions(state(earlier))


# --- pages: URL paths and HTML ------------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages keyed by URL path, as ``content``; several pages may share a key."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return read(spark, sf_dir, "pages").select(
        F.rtrim(bare, F.lit("/")).alias("rel_path"),
        F.timestamp_micros(F.lit(EPOCH_US) + F.col("page_id") * 1_000_000).alias("mtime"),
        "page_id",
        F.col("html").alias("content"),
    )


def newest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of every key. Only ids are aggregated; the HTML is joined on them."""
    keyed = pages(spark, sf_dir)
    newest = keyed.groupBy("rel_path").agg(F.max("page_id").alias("page_id")).select("page_id")
    return keyed.join(newest, "page_id", "left_semi")


# --- lineitem: many rows, keys that really collide ----------------------------------------------------


def line_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as work rows; order and line number do not identify a line, so targets collide."""
    key = F.concat_ws("/", "l_returnflag", "l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", key, F.concat_ws("-", "l_partkey", "l_suppkey")).alias("rel_path"),
        key.alias("target_path"),
        F.col("l_shipdate").cast("timestamp").alias("mtime"),
        F.col("l_extendedprice").cast("bigint").alias("size"),
        F.lit(None).cast("int").alias("mode"),
        F.lit("").alias("ext"),
        F.lit(None).cast("string").alias("converter"),
        F.lit(None).cast("string").alias("kind"),
    )


def line_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the lines, some of them a day old, and lines of orders that are gone."""
    order = F.col("l_orderkey")
    key = F.concat_ws("/", "l_returnflag", "l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    path = F.when(order % 11 == 0, F.concat(F.lit("gone/"), key)).otherwise(key)
    day = F.expr("interval 1 day")
    mtime = F.col("l_shipdate").cast("timestamp")
    return (
        read(spark, sf_dir, "lineitem")
        .filter(order % 5 != 0)
        .select(
            path.alias("rel_path"),
            F.when(order % 7 == 0, mtime - day).otherwise(mtime).alias("mtime"),
            F.col("l_extendedprice").cast("bigint").alias("size"),
            F.lit(None).cast("int").alias("mode"),
        )
    )


# --- rules and templates at the scale of the data -----------------------------------------------------


def pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(option) for option in options]), number.cast("int") + 1)


CLAIM_EXTENSIONS = ("htm", "md", "rst")


def doc_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under names that differ in the extension only, three at a time, with their content."""
    doc_id = F.col("doc_id")
    stem = F.floor(doc_id / 3).cast("bigint").cast("string")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("notes/"), stem, F.lit("."), pick(CLAIM_EXTENSIONS, doc_id % 3)).alias("rel_path"),
        F.timestamp_seconds(doc_id).alias("mtime"),
        F.col("n_chars").alias("size"),
        F.lit(None).cast("int").alias("mode"),
        F.col("text").alias("content"),
    )


def doc_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template per document: a fixed one behind the document's stem."""
    template = pick(TEMPLATES, F.col("doc_id") % len(TEMPLATES))
    return documents(spark, sf_dir).select(
        F.col("rel_path").alias("subject"), F.concat(file_stem("rel_path"), F.lit(":"), template).alias("template")
    )


def event_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties read as templates; their braces make them malformed."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("subject"), F.col("props").alias("template")
    )


def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole HTML pages read as templates."""
    return read(spark, sf_dir, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("subject"), F.col("html").alias("template")
    )


def doc_rules(spark: SparkSession, sf_dir: str) -> Rules:
    """Rule tables with one mapping and one converter per document, faulty in every way."""
    doc_id = F.col("doc_id")
    name = F.concat(F.lit("c"), doc_id.cast("string"))
    docs = read(spark, sf_dir, "documents")
    command = (
        F.when(doc_id % 10 == 0, F.lit(None))
        .when(doc_id % 10 == 1, F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.lit("tool"),
                F.concat(F.lit("--title="), name),
                pick(TEMPLATES, doc_id % len(TEMPLATES)),
            )
        )
    )
    converters = docs.filter(doc_id % 9 != 0).select(
        F.when(doc_id % 23 == 0, F.lit("c_shared")).otherwise(name).alias("name"),
        F.lit("command").alias("kind"),
        command.alias("command"),
    )
    # from FLAC1, .flac1, ... on; one in eight keys comes twice
    ext = F.concat(
        F.when(doc_id % 2 == 0, F.lit(".FLAC")).otherwise(F.lit("flac")),
        (doc_id - F.when(doc_id % 8 == 1, F.lit(1)).otherwise(F.lit(0))).cast("string"),
    )
    mappings = docs.select(
        ext.alias("ext"),
        F.when(doc_id % 15 != 0, name).alias("converter"),
        F.lit("opus").alias("output_ext"),
    )
    return Rules(mappings, converters)


# --- converters ---------------------------------------------------------------------------------------


def text_converters() -> Converters:
    """Expressions over text: spaces to underscores, digits masked, content digest."""
    return (
        Converters()
        .register("opus", lambda text: F.replace(text, F.lit(" "), F.lit("_")))
        .register("jpg", lambda text: F.regexp_replace(text, "[0-9]", "#"))
        .register("gz", lambda text: F.md5(text.cast("binary")))
    )


def page_globs() -> list[str]:
    """Many patterns over URLs: endings, whole paths, beginnings, and literals between wildcards."""
    endings = [f"*/fr/{n}" for n in range(0, 1000, 7)]
    inside = [f"*.th*/{lang}/{n}?" for lang in ("en", "de") for n in range(10, 100, 3)]
    return [*endings, *inside, "blog.*", "www.*.example.net/*", "*.example.org/es/[1-4]*", "*/en/"]

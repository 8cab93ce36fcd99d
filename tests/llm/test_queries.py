"""Queries of the first ten operators and the pipeline, on odd tables, against plain Python and SQL."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import langid, oracles, pii, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """The contract's patterns, read literally."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(6)
    personal = ["a.b@c.org", "x@y", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (475) 555-0100", "+1 2", "DE89 3704 0044 0532 0130 00"]
    words = ["sun", "Moon", "it's", "日本", "😀", "▁x", "<|endoftext|>", "\r\n", "  ", "été"]
    texts = [" ".join(rng.choices(words + personal, k=rng.randrange(1, 40))) for _ in range(40)]
    texts += [None, "", " ", "q" * 3000, texts[0], "".join(rng.choices("0123456789 -+.@ab", k=4000))]
    rows = [(n, t, "aa", "s", len(t or "")) for n, t in enumerate(texts)] + [(3, "again three", None, None, None), (None, "no id", "aa", "s", 1)]
    folder = tmp_path_factory.mktemp("queries")
    df = spark.createDataFrame(rows, COLUMNS)
    # columns whose names the operators use themselves
    df.withColumns({c: F.lit(1) for c in ("id", "ids", "spans", "bits", "row", "tie", "part", "length", "lang_pred")}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def compare(found, rows, want):
    """Rows may repeat an id, so both sides are compared as sorted lists."""
    key = lambda row: tuple("" if v is None else str(v) for v in row)
    assert sorted((tuple(r) for r in found), key=key) == sorted((want(doc, text or "") for doc, text, *_ in rows), key=key)


def test_op1(spark, docs):
    folder, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(doc, text):
        ids = library.encode_ordinary(text)
        return doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    compare(queries.op1_byte_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), rows, want)


def test_op2(spark, docs):
    folder, rows = docs

    def want(doc, text):
        spans = base_spans(text)
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        return doc, *(sum(s[0] == kind for s in spans) for kind in KINDS), hashlib.sha256(spelled.encode()).hexdigest()

    found = queries.op2_pii(spark, folder)
    compare(found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256").collect(), rows, want)
    spans = {(r.doc_id, r.spans) for r in found.select("doc_id", "spans").collect()}
    for doc, text, *_ in rows:
        own = next(set(s.split(",")) for d, s in spans if d == doc and {f"{k}:{a}:{b}" for k, a, b in base_spans(text or "")} <= set(s.split(",")) | {""})
        assert {f"{k}:{a}:{b}" for k, a, b in base_spans(text or "")} <= own


def test_op5(spark, docs):
    folder, rows = docs
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = queries.op5_token_counts(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    compare(found, rows, lambda doc, text: (doc, len(text.encode()), len(n := library.encode(text)), len(n) > 4096))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_and_op6(spark, docs):
    folder, rows = docs
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(doc, library.encode(text or "", add_special_tokens=False).ids) for doc, text, *_ in rows]
    pieces = sorted((str(doc), crc((i + [0])[at : at + 2048])) for doc, i in ids for at in range(0, len(i) + 1, 2048))
    packed = queries.op3_best_two_fit(spark, folder).collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in packed) == pieces
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    found = queries.op6_token_files(spark, folder).orderBy("start").collect()
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:n]) for n in range(len(found))]
    assert [r.doc_id for r in found] == sorted((doc for doc, _ in ids), key=lambda d: -1 if d is None else d)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(doc), len(i) + 1, crc(i + [2])) for doc, i in ids)


def test_op10_by_sql(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "u", big), (2, None, big), (3, "u\n v", None), (4, "u", "s"), (5, "u", "s"), (6, "u", "é\r\n\r\n" * 400), (7, "u", "y" * 1000), (8, "u", "y" * 1000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    by_sql = con.sql(oracles.OP10)
    found = queries.op10_warc(spark, str(tmp_path)).select(by_sql.columns).collect()
    assert sorted(map(tuple, found)) == sorted(by_sql.fetchall()) and len(found) == 8


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[n : n + 3]) for n in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_are_judged_row_by_row(spark):
    rng = random.Random(1)
    text = [" ".join(rng.choices("sun moon tree house river stone cloud field".split(), k=30)) for _ in range(8)]
    rows = [(3, text[0]), (7, text[1]), (7, text[0]), (None, text[2]), (None, text[3]), (None, text[4]), (None, text[0]), (9, text[4]), (None, text[3]), (5, text[5]), (5, text[5])]
    docs = spark.createDataFrame([(*row, "aa", f"s{n}", 0) for n, row in enumerate(rows)], COLUMNS)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == sorted([("3", text[0]), ("7", text[1]), ("None", text[2]), ("None", text[3]), ("9", text[4]), ("5", text[5])])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").isEmpty()


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = {"aa": "sun moon tree house river stone cloud field".split(), "bb": "żółw ćma gęś łoś źrebię ósmy".split()}
    rows = [(n, " ".join(rng.choices(vocabulary[lang], k=40)), lang, "s", 240) for n, lang in enumerate(["aa", "bb"] * 120)]
    rows += [(300, rows[5][1], "bb", "s", 0), (301, None, None, None, None), (302, "call me@home.org or +1 (475) 555-0100 " + rows[6][1], "aa", "s", 0)]
    rows += [(None, rows[8][1] + " river tree", "aa", "s", 0), (4, " ".join(rng.choices(vocabulary["aa"], k=40)), "aa", "s", 0), (303, "12 34 !", "aa", "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # the language stage: what the models, tested by themselves, do not reject
    judged = langid.predict(df, langid.train(df)).where("not rejected").select("doc_id", "text").collect()
    rest = [(r.doc_id, r.text) for r in judged]
    assert {n for n, *_ in rows} - {d for d, _ in rest} == {301, 303}
    prints = [fingerprint(t) for _, t in rest]
    root = list(range(len(rest)))
    for _ in rest:
        root = [min(root[b] for b in range(len(rest)) if (prints[a] ^ prints[b]).bit_count() <= 3) for a in range(len(rest))]
    groups = defaultdict(list)
    for n, r in enumerate(root):
        groups[r].append(n)
    kept = [rest[min(own, key=lambda n: (rest[n][0] is None, rest[n][0] or 0))] for own in groups.values()]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(d), crc(library.encode(pii.redacted(t), add_special_tokens=False).ids + [0])) for d, t in kept)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 2048 and len(set(own)) == len(own) for own in places.values())

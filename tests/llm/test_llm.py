"""Operators of the llm folder against libraries, brute force and odd tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import byte_bpe, langid, near_vectors, nearest, packing, pii, simhash, token_counts, token_files, warc
from tidemark.sources.scratch import scratch_dir

WORDS, PIECES, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
PARTS = ["it's", "we'll", "'", "''s", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "12", "!?", "▁", "　", "<|endoftext|>", "X", "\r\n", ".", "a@b.c", "\x85"]


def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(150)]
    return [None, "", " ", "a", *odd, "".join(rng.choices("abcdef", k=3000)), "word " * 9000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, text, "x", 1.0, "clash") for n, text in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id", "y", 0.0, "clash")], "doc_id long, text string, lang string, score double, spans string").repartition(3)


def of(docs):
    return {(r.doc_id, r.text or ""): r for r in docs.collect()}


def test_byte_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    coded = byte_bpe.encode(docs, RANKS, outputs=("n_tokens", "ids", "ends", "decoded_sha256"))
    found = coded.collect()
    assert len(found) == docs.count()
    for row in found:
        text = by_id[row.doc_id]
        assert row.ids == library.encode_ordinary(text) and row.n_tokens == len(row.ids)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.ends or [0])[-1] == len(text.encode())
    assert {r.doc_id: r.text for r in byte_bpe.decode(coded, RANKS).collect()} == by_id


def test_token_counts(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in token_counts.count_tokens(docs, PIECES).collect():
        assert (row.n_tokens, row.n_bytes) == (len(library.encode(by_id[row.doc_id])), len(by_id[row.doc_id].encode()))
        assert row.over_limit == (row.n_tokens > 4096)


def counted(transducer, texts):
    coded = [t.encode() for t in texts]
    return transducer.counts(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])).tolist()


@pytest.mark.parametrize("states", [token_counts.MAX_STATES, 2000])
def test_token_counts_of_unbroken_text(monkeypatch, states):
    """Maps of chunks that no space ends are composed; the cap on states forgets only those out of use."""
    monkeypatch.setattr(token_counts, "MAX_STATES", states)
    library, transducer, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Transducer(PIECES), random.Random(8)
    chunk = token_counts.CHUNK
    texts = [base64.b64encode(rng.randbytes(30_000)).decode(), "".join(rng.choices("etaoinshr", k=20_000)), "".join(rng.choices("ACGT", k=20_000))]
    texts += [unit * n for unit in ("=", "-", "a", " ", "ab", "the", "=-", "é", "#" * 17 + "a") for n in (chunk - 2, chunk - 1, chunk, 7 * chunk + 5, 12_000)]
    texts += ["".join(rng.choices("ab =é▁the", [9, 9, 1, 9, 1, 1, 9, 9, 9], k=rng.randrange(4 * chunk))) for _ in range(200)] + [""]
    want = [len(library.encode(t)) for t in texts]
    assert counted(transducer, texts) == want
    assert [counted(transducer, [t])[0] for t in texts[:60]] == want[:60]
    if states == 2000:
        assert transducer.known < 20_000


def test_token_counts_in_turn(monkeypatch):
    """What rounds and guesses leave open follows the text's own path."""
    monkeypatch.setattr(token_counts, "ROUNDS", 0)
    monkeypatch.setattr(token_counts, "WARM", 1)
    library, transducer = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Transducer(PIECES)
    texts = ["=" * 3000, "x" + "-" * 2999, "ab" * 1500, "some words " + "q" * 2000 + " and words"]
    assert counted(transducer, texts) == [len(library.encode(t)) for t in texts]


def ids_of(docs):
    library = Tokenizer.from_file(WORDS)
    return {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs):
    ids, bins = ids_of(docs), {}
    found = packing.pack_documents(docs, WORDS).collect()
    for row in found:
        own = (ids[row.doc_id] + [0])[row.start : row.start + row.length]
        assert len(own) == row.length and crc(own) == row.ids_crc32
        bins.setdefault(row.sequence_id, []).append((row.offset, row.length))
    assert sum(r.length for r in found) == sum(len(ids[r.doc_id]) + 1 for r in docs.collect())
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6 + 3 leaves 1; the 3 gives way to 2 + 2
    assert packing.best_two_fit(counts, 10)[0] == ([(6, 1), (2, 2)], 1)


def test_token_files(spark, docs):
    path = scratch_dir(spark, "t")
    token_files.write_tokens(docs, WORDS, path)
    found = token_files.read_tokens(spark, path, ("ids", "ids_crc32")).collect()
    ids, at = ids_of(docs), 0
    for row in sorted(found, key=lambda r: r.start):
        assert row.start == at and row.ids == ids[row.doc_id] + [2] and crc(row.ids) == row.ids_crc32
        at += row.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == [None, *sorted(x for x in order if x is not None)] and len(order) == docs.count()


def test_codes_of_any_size():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 700, np.uint32)
    places = np.random.default_rng(0).integers(0, len(ids), 1000)
    codes = token_files.Codes.build(ids)
    assert (codes.get(places) == ids[places]).all()
    for start, stop in [(0, len(ids)), (0, 0), (len(ids), len(ids)), (3, 4), *np.sort(places[:40].reshape(-1, 2), axis=1).tolist()]:
        assert (codes.run(start, stop) == ids[start:stop]).all()


def test_simhash(docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        runs = [" ".join(words[n : n + 3]) for n in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = docs.where("doc_id is not null").select("doc_id", "text").distinct()
    by_id = {r.doc_id: fingerprint(r.text or "") for r in rows.collect()}
    root = {n: n for n in by_id}
    for _ in by_id:
        new = {a: min(root[b] for b in by_id if (by_id[a] ^ by_id[b]).bit_count() <= 3) for a in by_id}
        if new == root:
            break
        root = new
    found = simhash.near_duplicates(rows).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {n: (f"{v:016x}", root[n]) for n, v in by_id.items()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    values = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(14)])
    for a, b in (links := simhash.links_of(values, np.array([0]), radius)):
        assert (int(values[a]) ^ int(values[b])).bit_count() <= radius
    root = np.arange(len(values))
    near_vectors._join(root, *np.array(links, int).reshape(-1, 2).T)
    near = np.bitwise_count(values[:, None] ^ values) <= radius
    assert all(root[a] == root[b] for a, b in zip(*np.nonzero(near)))


def test_pii():
    card = "4111 1111 1111 1111"
    text = f"mail a.b@c.org, ip 10.0.0.1 or 300.1.1.1, card {card}, 4111 1111 1111 1112, call +1 (475) 555-0100; DE89 3704 0044 0532 0130 00"
    found = [(kind, text[a:b]) for kind, a, b, _ in pii.spans_of(text)]
    assert ("email", "a.b@c.org") in found and ("ip", "10.0.0.1") in found and ("card", card) in found
    assert ("phone", "+1 (475) 555-0100") in found and ("iban", "DE89 3704 0044 0532 0130 00") in found
    assert not any("300.1" in s or s.endswith("1112") for _, s in found)
    assert "a.b@c.org" not in pii.redacted(text) and "[CARD]" in pii.redacted(text)
    assert pii.spans_of("a" * 300_000) == [] and pii.spans_of("1" * 300_000) == []


def test_pii_tables(docs):
    assert pii.find(docs).count() == docs.count()
    assert pii.redact(docs).where("text is null").count() == docs.where("text is null").count()


def test_language(spark):
    rng = random.Random(3)
    vocabulary = {"aa": "sun moon tree house river stone".split(), "bb": "żółw ćma gęś łoś źrebię ósmy".split()}
    rows = [(n, " ".join(rng.choices(vocabulary[lang], k=30)), lang) for n, lang in enumerate(["aa", "bb"] * 150)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", None), (902, "sun river", None)], "doc_id long, text string, lang string")
    models = langid.train(df)
    found = {r.doc_id: r for r in langid.predict(df.drop("lang"), models).collect()}
    assert all(found[n].lang_pred == lang and not found[n].rejected and 0 <= found[n].score <= 1 for n, _, lang in rows)
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].rejected and found[902].lang_pred == "aa"
    assert langid.predict(df.limit(1), langid.train(df.limit(0))).first().lang_pred == "und"
    clashing = df.withColumns({"lang_pred": F.lit(1), "SCORE": F.lit("x"), "rejected": F.lit(None).cast("date"), "size": F.lit(2)})
    told = langid.predict(clashing, models)
    assert sorted(told.columns) == sorted([*df.columns, "size", "lang_pred", "score", "rejected"])
    assert {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in told.collect()} == {d: (r.lang_pred, r.score, r.rejected) for d, r in found.items()}
    with pytest.raises(ValueError, match="added"):
        langid.predict(df.withColumnRenamed("text", "Score"), models, text_col="Score")
    # the probabilities that follow a context add up to at most one
    odds = 2.0 ** models.bits(np.array([ord(a) << 16 | ord(b) for a in "s" for b in "abcdefghijklmnopqrstuvwxyz"], np.uint64), 2)
    assert (odds.sum(0) <= 1.001).all()


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = base[:40] + 0.05 * rng.normal(size=(40, 16))
    rows = [(n, v.astype("float32").tolist(), n % 3) for n, v in enumerate([*base, *near, *base[:20], base[0], base[0]])]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None, 1.0], 0), (504, rows[0][1], None), (505, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def usable(rows):
    return {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}


def cosine(a, b):
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else -2


def test_near_vectors(spark):
    df = vectors(spark)
    rows = df.collect()
    good, label = usable(rows), {r.vec_id: r.label for r in rows}
    links = {r.vec_id: {b for b in good if r.vec_id in good and b != r.vec_id and label[b] == label[r.vec_id] is not None and cosine(good[r.vec_id], good[b]) >= 0.93} for r in rows}
    root = {n: n for n in links}
    for _ in links:
        root = {n: min([root[n], *(root[b] for b in links[n])]) for n in links}
    found = near_vectors.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {n: (len(links[n]), root[n], root[n] == n) for n in links}


def test_nearest(spark):
    df = vectors(spark)
    good = usable(df.collect())
    found = nearest.search(df, F.col("vec_id") % 10 == 0).collect()
    hits = total = 0
    for query in (n for n in good if n % 10 == 0):
        own = sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])
        best = sorted(((-round(cosine(good[query], v), 12), n) for n, v in good.items() if n != query and len(v) == len(good[query])))[:5]
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert all(abs(r.score - cosine(good[query], good[r.vec_id])) < 1e-12 for r in own)
        hits, total = hits + len({n for _, n in best} & {r.vec_id for r in own}), total + len(best)
    assert hits >= 0.9 * total


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "u", big), (2, None, big), (3, "u\n v", None), (4, "u", "s"), (5, "u", "s"), (6, "u", "é\r\n\r\n" * 400), (None, "u", big)]
    path = scratch_dir(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = {r.page_id: r for r in warc.read_warc(spark, path, with_payload=True).collect()}
    assert len(found) == 7 and {n for n, r in found.items() if r.record_type == "revisit"} == {1, None}
    for page, _, html in rows:
        raw, row = (html or "").encode(), found[page]
        assert (row.payload_bytes, row.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (row.refers_to == 2 and row.payload is None) if row.record_type == "revisit" else bytes(row.payload) == raw
    for name in (r.name for r in spark.read.parquet(f"{path}/manifest").collect()):
        store, inner = fs.FileSystem.from_uri(f"{path}/{name}")
        with store.open_input_file(inner) as file:
            reader = warc.BundleReader(file)
            assert all(reader.record(n)[0]["WARC-Record-ID"] == f"<urn:page:{n}>" for n, *_ in reader.index if n)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert byte_bpe.encode(none, RANKS).isEmpty() and token_counts.count_tokens(none, PIECES).isEmpty() and pii.find(none).isEmpty()
    assert packing.pack_documents(none, WORDS).isEmpty() and simhash.near_duplicates(none).isEmpty()
    assert near_vectors.near_duplicates(vectors(spark).limit(0)).isEmpty() and nearest.search(vectors(spark).limit(0), F.lit(True)).isEmpty()
    for label, write, read, df in (("a", lambda d, p: token_files.write_tokens(d, WORDS, p), token_files.read_tokens, none), ("b", warc.write_warc, warc.read_warc, spark.createDataFrame([], "page_id long, url string, html string"))):
        path = scratch_dir(spark, label)
        write(df, path)
        assert read(spark, path).isEmpty()


def test_pipeline_stages(spark):
    rng = random.Random(4)
    words = "sun moon tree house river stone cloud field".split()
    rows = [(n, " ".join(rng.choices(words, k=40)), "aa", "s", 0) for n in range(200)]
    rows += [(300, rows[5][1], "aa", "s", 0), (301, None, None, None, None), (302, "write to me@home.org " + rows[7][1], "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    found = {r.doc_id: r for r in docs.collect()}
    assert 301 not in found and 300 not in found and 5 in found
    assert all("me@home.org" not in r.text and r.n_chars == len(r.text) for r in found.values())
    packed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == set(found)

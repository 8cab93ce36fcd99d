"""The queries of operators 11 to 13 against plain Python, on odd tables and on several ranges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import filter_audit, lattice, oracles, prefix_trie, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["sun", "Moon", "STAR", "żółw", "日本", "a b", "it's", "#tag", "x" * 70, "y" * 700]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 250, 400]))) for _ in range(60)]
    texts += [None, "", " \t\n", "w" * 20_000, *(f"u{n} v{n}\x0bw" for n in range(40)), *texts[:25], "a b " * 150, "a|b"]
    rows = [(n * 7 % 1000, text, ["s1", None, "s3", ""][n % 4], "clash", 1.0) for n, text in enumerate(texts)]
    rows += [rows[3], (rows[3][0], "other text", "s1", "clash", 0.0), (None, texts[0], "s3", None, None), (None, None, None, None, None)]
    labels = [(row[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for row in rows[::2]] + [(rows[0][0], 1, 1), (None, 1, 1)]
    folder = tmp_path_factory.mktemp("docs")
    return write(
        spark, folder,
        documents=(rows, "doc_id long, text string, source string, word string, A double"),
        labels=(labels, "doc_id long, quality int, toxic int"),
    ), rows, labels


def test_audit(spark, docs):
    folder, rows, labels = docs
    good, toxic = ({row[0] for row in labels if row[n] == 1 and row[0] is not None} for n in (1, 2))
    smallest = {}
    for doc, text, *_ in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    failing = defaultdict(list)
    for doc, text, source, *_ in rows:
        text, found = text or "", words_of(text)
        fails = {
            "A": len(found) < 200,
            "B": 100 * len(set(found)) < 50 * len(found),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": doc is not None and smallest[text] < doc,
        }
        failing[source or ""].append(({name for name, bad in fails.items() if bad}, doc in good, doc in toxic))
    want, shapley = {}, Counter()
    for part, marked in failing.items():
        for order in permutations("ABCDE"):
            left = list(marked)
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[0]]
                left = [m for m in left if name not in m[0]]
                shapley[part, name] += len(gone)
                want[part, "".join(order), step] = (
                    len(left), len(gone), sum(name in m[0] for m in marked) - len(gone), sum(m[0] == {name} for m in marked),
                    sum(m[1] for m in gone), sum(m[2] for m in gone),
                )
    found = queries.op12_filter_audit(spark, folder).collect()
    assert len(found) == len(want)
    for r in found:
        key = r.part, r.filter_order, r.step
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[key]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_gray_walk():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 9, (4, 16, 2))
    left = filter_audit.survivors_of(cells)
    for subset in range(16):
        assert (left[:, subset] == cells[:, [m for m in range(16) if m & subset == 0]].sum(1)).all()
    with pytest.raises(ValueError):
        filter_audit.audit(None, {str(n): str(n) for n in range(9)}, "part")


def seqs_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out.append((c, tuple(own.get(c - c % 100, [])[:h] + turns[h:])))
    return out


def nodes_of(seqs, length):
    members, ends, kids = defaultdict(list), defaultdict(list), Counter()
    for c, s in seqs:
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids.update(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * length(p[-1]) if p else 0
    sha = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha[p]) for p, m in members.items())


def found_nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_of_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = [(100, 0, "user", "head"), (100, 1, None, "one"), (100, 2, "user", None), (100, 3, "", "é日")]
    rows += [(c, t, "user", rng.choice(["head", "x", "y"])) for c in rng.sample(range(101, 400), 90) for t in range(rng.randrange(1, 7))]
    rows += [(7, None, "user", "first"), (7, 0, "user", "second"), (7, 0, "zz", "third"), (8, 1, "user", "x"), (8, 2, "user", "x"), (None, 1, "a", "b")]
    rows = [(*row, "clash", 1) for row in rows]
    schema = "conv_id long, turn long, role string, text string, seq string, depth int"
    folder = write(spark, tmp_path, conversations=(rows, schema))
    want = nodes_of(seqs_of(rows), lambda turn: len(turn[1]))
    assert found_nodes(queries.op13_prefix_trie(spark, folder)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    by_sql = con.sql(f"SELECT conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({oracles.OP13})")
    assert sorted(by_sql.fetchall()) == want
    empty = spark.createDataFrame([], schema)
    assert prefix_trie.conversation_trie(empty).isEmpty()


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_trie_across_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", rows)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 20)
    rng = random.Random(rows)
    seqs = [(c, tuple(rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.choice([0, 1, 3, 5, 8])))) for c in rng.sample(range(10_000), 50)]
    seqs += [(20_000 + n, (0, 0) + (1,) * (n // 2)) for n in range(40)] + [(30_000 + n, (5, 5)) for n in range(30)]
    if rows == 7:
        seqs = [(c, (9, *s)) for c, s in seqs]

    def turn(n):
        return hashlib.md5(bytes([n])).digest() + (n + 1).to_bytes(4, "big")

    df = spark.createDataFrame([(c, b"".join(map(turn, s))) for c, s in seqs], "conv_id long, seq binary")
    assert found_nodes(prefix_trie.trie(df)) == nodes_of(seqs, lambda n: n + 1)


def pieces_of(model):
    after = defaultdict(list)
    for key, node in zip(model.keys.tolist(), model.next.tolist()):
        after[key >> 21].append((chr(key & 0x1FFFFF), node))
    out, todo = {}, [(0, "")]
    while todo:
        node, piece = todo.pop()
        if model.value[node] > -math.inf:
            out[piece] = model.value[node]
        todo += [(n, piece + c) for c, n in after[node]]
    return out


def test_lattice_sums_all_segmentations(monkeypatch):
    model = lattice.Lattice(PIECES)
    weights = pieces_of(model)
    assert abs(sum(map(math.exp, weights.values())) + 256 * math.exp(model.byte) + math.exp(model.end) - 1) < 1e-9

    def total(text):
        if not text:
            return 1.0
        spelled = 0.0 if text[0] in weights else math.exp(len(text[0].encode()) * model.byte) * total(text[1:])
        return spelled + sum(math.exp(weights[text[:n]]) * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in weights)

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeéstinrøжfoo日😀▁", k=rng.randrange(1, 9))) for _ in range(200)]
    for word, found in zip(words, model.words(words)):
        assert math.isclose(found, math.log(total("▁" + word)), rel_tol=1e-9)
    lengthy = "".join(rng.choices("abcdefgh日", k=1500))
    plain = model._short([lengthy], np.array([1501]))[0]
    for span in (1 << 17, 700, 300):
        monkeypatch.setattr(lattice, "SPAN", span)
        assert math.isclose(model._long(lengthy), plain, rel_tol=1e-9)


@pytest.mark.parametrize("heavy", [4, 1 << 16])
def test_scores(spark, docs, monkeypatch, heavy):
    monkeypatch.setattr(lattice, "HEAVY", heavy)
    folder, rows, _ = docs
    model = lattice.lattice_of(PIECES)

    def held_out(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0

    tokens = [words_of((text or "").translate(CAPITALS)) for _, text, *_ in rows]
    counts = Counter()
    for (doc, *_), words in zip(rows, tokens):
        if not held_out(doc):
            counts.update([*words, None])
    total, distinct = sum(counts.values()), len(counts)
    known = sorted({w for words in tokens for w in words})
    log10 = dict(zip(known, model.words(known) / math.log(10)))
    want = []
    for (doc, *_), words in zip(rows, tokens):
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words, None])
        score = sum(log10[w] for w in words) + model.end / math.log(10)
        want.append((doc or -1, held_out(doc), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total, base, score))
    found = queries.op11_lattice_likelihood(spark, folder).collect()
    found = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in found]
    want = [(-1 if row[0] is None else row[0], *w[1:]) for row, w in zip(rows, want)]
    for a, b in zip(sorted(found), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lattice.score(none, PIECES).isEmpty() and filter_audit.audit_documents(none, labels).isEmpty()
    held = next(n for n in range(1000) if zlib.crc32(str(n).encode()) % 10 == 0)
    row = lattice.score(spark.createDataFrame([(held, "two words")], "doc_id long, text string"), PIECES).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_expected_pieces():
    model = lattice.Lattice(PIECES)
    weights = pieces_of(model)
    place = {}
    for key, node in zip(model.keys.tolist(), model.next.tolist()):
        place.setdefault(key >> 21, []).append((chr(key & 0x1FFFFF), node))

    def node_of(piece):
        node = 0
        for char in piece:
            node = dict(place[node])[char]
        return node

    def ways(text):
        if not text:
            yield 1.0, []
        for n in range(1, len(text) + 1):
            if text[:n] in weights:
                yield from ((math.exp(weights[text[:n]]) * p, [node_of(text[:n]), *nodes]) for p, nodes in ways(text[n:]))
            elif n == 1:
                size = len(text[0].encode())
                yield from ((math.exp(size * model.byte) * p, [0] * size + nodes) for p, nodes in ways(text[1:]))

    words, want = ["there", "日😀a", "in", "x▁e", "istin"], np.zeros(len(model.value))
    for word in words:
        found = list(ways("▁" + word))
        for p, nodes in found:
            np.add.at(want, nodes, p / sum(q for q, _ in found))
    assert np.allclose(model.expected(words), want, rtol=1e-9, atol=1e-12)
    learned = model.weighted(want)
    assert math.isclose(np.exp(learned.value).sum() + 256 * math.exp(learned.byte), 1, rel_tol=1e-9)
    assert (learned.value > -math.inf).tolist() == (model.value > -math.inf).tolist()


@pytest.mark.parametrize("heavy", [4, 1 << 16])
def test_learned_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(lattice, "HEAVY", heavy)
    monkeypatch.setattr(lattice, "SAMPLE", 300)
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ti"]
    known = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(3000)]
    odd = ["z" * 300, "😀" * 15, "日" * 21]
    texts = [" ".join(known[int(len(known) * rng.random() ** 3)] for _ in range(300)) for _ in range(200)]
    rows = [(n, text) for n, text in enumerate(texts)]
    held = [n for n in range(200, 400) if zlib.crc32(str(n).encode()) % 10 == 0]
    rows += [(held[0], " ".join(odd * 3 + known[:50])), (held[1], None), (201, "q" * 90 + " qq"), *((n, " ".join(odd)) for n in held[2:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(lattice.score(df, PIECES).collect(), key=lambda row: (row.doc_id, row.n_tokens))
    assert len(found) == len(rows) and all(math.isfinite(row.score) for row in found)
    usual = [row for row in found if row.held_out and row.doc_id < 200]
    assert len(usual) > 10 and sum(row.score for row in usual) > 1.05 * sum(row.base_score for row in usual)

    tokens = {n: words_of(text) for n, text in rows}
    counts, out = Counter(), {n: zlib.crc32(str(n).encode()) % 10 == 0 for n in tokens}
    for n, words in tokens.items():
        if not out[n]:
            counts.update(words)
    n, learned = sum(counts.values()), sum(not held for held in out.values())
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    table = lattice.vocabulary(df, "text", ~lattice.held_out("doc_id")).where("c > 0").cache()
    assert table.where("spelled is not null").first().spelled == "q" * 90 and table.count() == len(counts)
    model = lattice.lattice_of(PIECES).weighted(lattice.learn_pieces(table, PIECES, len(counts)))
    met = sorted({word for words in tokens.values() for word in words})
    pieces = dict(zip(met, model.words(met) / math.log(10)))
    for row in found:
        want = math.log10(learned / (n + learned))
        for at, word in enumerate(words := tokens[row.doc_id]):
            spelled = math.log10(discount * len(counts) / n) + pieces[word]
            p = max(counts[word] - discount, 0) / n + 10**spelled
            drawn, before = lattice.URN * p, words[:at].count(word)
            want += math.log10(n / (n + learned)) - math.log10(lattice.URN + at)
            want += math.log10(drawn + before) if drawn + before else math.log10(lattice.URN) + spelled
        assert math.isclose(row.score, want, rel_tol=1e-9)


def counted_plainly(model, words):
    """How often each node is expected, position by position in plain Python; bytes at the root."""
    after, counts = {}, np.zeros(len(model.value))
    for key, node in zip(model.keys.tolist(), model.next.tolist()):
        after[key >> 21, chr(key & 0x1FFFFF)] = node

    def log_sum(values):
        return max(values) + math.log(sum(math.exp(v - max(values)) for v in values))

    for word in words:
        text, arcs = "▁" + word, []
        for start, char in enumerate(text):
            node, found = 0, []
            for end in range(start + 1, len(text) + 1):
                node = after.get((node, text[end - 1]), 0)
                if not node:
                    break
                if model.value[node] > -math.inf:
                    found.append((start, end, model.value[node], node, 1))
            if not any(end == start + 1 for _, end, *_ in found):
                size = len(char.encode())
                found.append((start, start + 1, size * model.byte, 0, size))
            arcs += found
        into, onward = defaultdict(list), defaultdict(list)
        into[0], onward[len(text)] = [0.0], [0.0]
        for start, end, weight, *_ in arcs:
            into[end].append(log_sum(into[start]) + weight)
        for start, end, weight, *_ in reversed(arcs):
            onward[start].append(weight + log_sum(onward[end]))
        before, beyond = ({k: log_sum(v) for k, v in some.items()} for some in (into, onward))
        for start, end, weight, node, times in arcs:
            counts[node] += times * math.exp(before[start] + weight + beyond[end] - before[len(text)])
    return counts


@pytest.mark.parametrize("span", [1 << 17, 700, 256, 10])
def test_expected_pieces_of_long_words(monkeypatch, span):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeinrstéß日", k=k)) for k in (300, 511, 512, 1023, 1400)] + ["z" * 900, "in" * 400, "there"]
    model = lattice.Lattice(PIECES)
    want = counted_plainly(model, words)
    monkeypatch.setattr(lattice, "SPAN", span)
    assert np.allclose(model.expected(words), want, rtol=1e-9, atol=1e-12)
    learned = model.weighted(want)
    assert np.allclose(learned.expected(words), counted_plainly(learned, words), rtol=1e-9, atol=1e-12)


def test_every_round_is_over_all_learned_words(spark, monkeypatch):
    monkeypatch.setattr(lattice, "SAMPLE", 50)
    rng = random.Random(6)
    words = sorted({"".join(rng.choices(["th", "er", "on", "é", "re", "日", "qu"], k=rng.randrange(1, 6))) for _ in range(900)} | {"ab" * 400, "x" * 70, "日" * 600})
    texts = [" ".join(words[n::30] + words[:3]) for n in range(30)]
    held = next(n for n in range(100, 1000) if zlib.crc32(str(n).encode()) % 10 == 0)
    ids = [n for n in range(1000) if zlib.crc32(str(n).encode()) % 10][:30]
    df = spark.createDataFrame([*zip(ids, texts), (held, "unlearned " * 5), (None, None)], "doc_id long, text string").repartition(3)
    table = lattice.vocabulary(df, "text", ~lattice.held_out("doc_id")).cache()
    first = model = lattice.lattice_of(PIECES)
    for _ in range(3):
        counts = counted_plainly(model, words)
        model = first.weighted(counts)
    assert np.allclose(lattice.learn_pieces(table, PIECES, len(words)), counts, rtol=1e-9, atol=1e-12)
    with pytest.raises(RuntimeError):
        lattice.learn_pieces(table, PIECES, len(words) + 1)

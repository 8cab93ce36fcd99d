"""The trie of conversations that begin alike, from neighbours in sorted order (operator 13).

Sorted by their turns, the conversations that pass a node of the trie stand together, and how many turns two
neighbours share is the depth down to which they do. These lengths (LCP) are edges. Joined by union-find in
descending depth, every merge of components creates the node at which they branch; between two merges a
component is a chain of nodes with one child each.

Sequences are dealt by range, so a component may reach beyond its partition. Those are the ones at the two
ends, no deeper than the edge across the border. Each partition contracts them to one fragment a depth; the
fragments of a node, found by its depth and the hash of its prefix, are added up, and the merged nodes go back
to the partitions, which write every node once, where it begins.

What a node reports adds up over members and edges. A node's subtree has as many leaves as members that the
next one does not continue. Its saved tokens are the sum over its edges of what the neighbours share, less
what lies above the node once for each edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import gather_ragged, parts_for, scratch_table

#: A turn in a sequence: 16 bytes of hash, 4 bytes of length (of the last text, in code points).
TURN = np.dtype([("a", ">u8"), ("b", ">u8"), ("n", ">u4")])
#: Bytes of sequences and rows in one partition, about; a range has to fit into a task.
RANGE_BYTES, RANGE_ROWS = 16 << 20, 200_000
#: Bytes of ids that are joined before they are hashed.
PIECE_BYTES = 1 << 18
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


class Forest:
    """The components of sorted, distinct sequences, merged along LCP edges in descending depth.

    One entry per node of the compressed trie: ``deep`` is its depth and ``top`` its parent's, and it stands for
    the whole chain between them; ``first`` and ``last`` are the positions of its members. ``shared`` adds up what
    the neighbours inside share, in code points, ``leaves`` the members that the next does not continue (``open_end``
    says whether something beyond the last one does), ``kids`` the children and ``ends`` the member that ends here.
    """

    def __init__(self, keys: list[bytes], copies: np.ndarray, smallest: np.ndarray, open_end: bool = False):
        sizes = np.array([len(k) // TURN.itemsize for k in keys], np.int64)
        self.turns = np.frombuffer(b"".join(keys), TURN)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.sizes = sizes
        before = np.concatenate([[0], np.cumsum(self.turns["n"].astype(np.int64))])
        self.before = before  # code points before a turn of the whole block
        self.edges = self._edges()
        own = before[self.at[1:]] - before[self.at[:-1]]
        many = len(keys)
        leaf = np.ones(many, np.int64)
        if open_end:
            leaf[-1] = 0
        nodes = {
            "first": np.arange(many), "last": np.arange(many), "deep": sizes, "n": copies, "id": smallest,
            "leaves": leaf, "shared": (copies - 1) * own, "kids": np.zeros(many, np.int64), "ends": np.arange(many),
        }
        self._merge(nodes)

    def prefix(self, member: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points of the first ``depth`` turns of members."""
        return self.before[self.at[member] + depth] - self.before[self.at[member]]

    def digest(self, member: int, depth: int) -> bytes:
        start = int(self.at[member])
        return hashlib.md5(self.turns[start : start + depth].tobytes()).digest()

    def _edges(self) -> np.ndarray:
        """How many turns each sequence shares with the next."""
        least = np.minimum(self.sizes[:-1], self.sizes[1:])
        left = gather_ragged(np.arange(len(self.turns)), self.at[:-2], least)
        right = gather_ragged(np.arange(len(self.turns)), self.at[1:-1], least)
        apart = self.turns["a"][left] != self.turns["a"][right]
        apart |= self.turns["b"][left] != self.turns["b"][right]
        apart |= self.turns["n"][left] != self.turns["n"][right]
        begin = np.cumsum(least) - least
        out, some = least.copy(), np.flatnonzero(least)
        place = np.arange(len(left)) - np.repeat(begin, least)
        if len(some):
            out[some] = np.minimum.reduceat(np.where(apart, place, np.repeat(least, least)), begin[some])
        return out

    def _merge(self, live: dict[str, np.ndarray]) -> None:
        many = len(self.sizes)
        done: list[dict[str, np.ndarray]] = []
        # of each component its entry: found at the position of its first member, and of its last
        head, tail = np.arange(many), np.arange(many)
        size = many
        room = {k: np.concatenate([v, np.zeros(max(0, many - 1), np.int64)]) for k, v in live.items()}
        top = np.full(len(room["deep"]), -1, np.int64)
        up = np.full(len(room["deep"]), -1, np.int64)
        by_depth = np.argsort(-self.edges, kind="stable")
        cuts = np.flatnonzero(np.diff(self.edges[by_depth])) + 1
        for same in np.split(by_depth, cuts) if len(by_depth) else ():
            depth = int(self.edges[same[0]])
            left, right = tail[same], head[same + 1]
            # edges follow each other where one's right component is the next one's left
            begins = np.append(True, right[:-1] != left[1:])
            group = np.cumsum(begins) - 1
            new = size + np.arange(group[-1] + 1)
            size += len(new)
            parts = np.concatenate([left[begins], right])
            of = np.concatenate([np.arange(len(new)), group])
            here = room["deep"][parts] == depth  # a sequence that ends at this depth is the node itself
            for name in ("n", "shared"):
                np.add.at(room[name], new[of], room[name][parts])
            np.add.at(room["shared"], new[group], self.prefix(same, np.full(len(same), depth)))
            np.add.at(room["leaves"], new[of[~here]], room["leaves"][parts[~here]])
            np.add.at(room["kids"], new[of], (~here).astype(np.int64))
            room["id"][new] = np.iinfo(np.int64).max
            np.minimum.at(room["id"], new[of], room["id"][parts])
            room["ends"][new] = -1
            room["ends"][new[of[here]]] = room["ends"][parts[here]]
            room["deep"][new] = depth
            room["first"][new] = room["first"][left[begins]]
            lasts = np.append(np.flatnonzero(begins)[1:], len(begins)) - 1
            room["last"][new] = room["last"][right[lasts]]
            top[parts], up[parts] = depth, new[of]
            head[room["first"][new]], tail[room["last"][new]] = new, new
        if size and room["deep"][size - 1] != 0:
            # everything shares a turn: the textless root is above the last component
            room = {k: np.append(v[:size], v[size - 1]) for k, v in room.items()}
            room["deep"][size], room["kids"][size], room["ends"][size] = 0, 1, -1
            top, up = np.append(top[:size], -1), np.append(up[:size], -1)
            top[size - 1], up[size - 1] = 0, size
            size += 1
        real = (top[:size] < room["deep"][:size]) | (np.arange(size) == size - 1)
        number = np.cumsum(real) - 1
        for name, column in room.items():
            setattr(self, name, column[:size][real])
        self.top = top[:size][real]
        self.up = np.where(up[:size][real] >= 0, number[up[:size][real]], -1)

    def rows(self) -> dict[str, np.ndarray]:
        """Every node of the trie: the chains written out, with ``entry`` (the component) and ``parent`` (its id)."""
        chain = self.deep - self.top
        entry = np.repeat(np.arange(len(chain)), chain)
        depth = self.top[entry] + 1 + np.arange(len(entry)) - np.repeat(np.cumsum(chain) - chain, chain)
        bottom = depth == self.deep[entry]
        highest = depth == self.top[entry] + 1
        parent = np.where(highest & (self.up[entry] >= 0), self.id[self.up[entry]], self.id[entry])
        above = self.prefix(self.first[entry], np.maximum(depth - 1, 0))
        return {
            "entry": entry,
            "conv_id": self.id[entry],
            "depth": depth,
            "parent_conv_id": parent,
            "n_convs": self.n[entry],
            "n_children": np.where(bottom, self.kids[entry], 1),
            "n_leaves": self.leaves[entry],
            "shared": self.shared[entry],
            "above": above,
            "ends": np.where(bottom, self.ends[entry], -1),
        }


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """The turns that two sequences share from the start; -1 where there is no other."""
    if a is None or b is None:
        return -1
    many = min(len(a), len(b)) // TURN.itemsize
    x, y = np.frombuffer(a, TURN, many), np.frombuffer(b, TURN, many)
    apart = np.flatnonzero(x != y)
    return int(apart[0]) if len(apart) else many


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, seq) of every conversation: its first turns replaced by those of its block's first conversation.

    ``turns``: conv_id, turn, role, text. Turns are in the order of ``turn``, NULL first, ties by role and then by
    their hash; repeated rows are turns of their own. NULL role or text is empty. A NULL conv_id names no
    conversation. Conversation c begins with the first h turns of c - c % block (all if fewer, none if absent),
    h = crc32(c) % most, and goes on with its own after the first h. A turn becomes 20 bytes, a conversation a row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.concat(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary")), F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), token.alias("token")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]).alias("own"))
    whole = scratch_table(whole, "conversations")
    start = F.col("conv_id") - F.col("conv_id") % block
    bases = whole.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    # at most `block` conversations share a first one
    met = whole.withColumn("base", start).join(bases, "base", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), h), F.array().cast("array<string>"))
    rest = F.slice("own", h + 1, F.size("own") + 1)
    return met.select("conv_id", F.unhex(F.concat(F.array_join(lead, ""), F.array_join(rest, ""))).alias("seq"))


def ends_of(sequences: DataFrame) -> DataFrame:
    """(digest, ends): for the conversations of each sequence, the SHA-256 of their ids in ascending order.

    Ids are sorted by range and joined into pieces of bounded size, however many share a sequence; the hash of a
    sequence then runs over its few pieces.
    """
    dealt = sequences.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, held, first = None, [], 0, 0
        out: list[tuple] = []
        for batch in batches:
            digests, convs = batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()
            for digest, conv in zip(digests, convs):
                if digest != own or held >= PIECE_BYTES:
                    if ids:
                        out.append((own, first, ",".join(ids)))
                    own, ids, held, first = digest, [], 0, conv
                ids.append(str(conv))
                held += len(ids[-1]) + 1
            if len(out) >= 1000 or sum(len(o[2]) for o in out) >= 4 * PIECE_BYTES:
                yield pieces(out)
                out.clear()
        if ids:
            out.append((own, first, ",".join(ids)))
        if out:
            yield pieces(out)

    def pieces(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["digest", "first", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest != own:
                    if own is not None:
                        out.append((own, state.hexdigest()))
                    own, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield result(out)
        if own is not None:
            yield result([(own, state.hexdigest())])

    def result(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["digest", "ends"])

    joined = scratch_table(dealt.mapInArrow(join, "digest binary, first long, ids string"), "pieces")
    ordered = joined.repartition("digest").sortWithinPartitions("digest", "first")
    return ordered.mapInArrow(finish, "digest binary, ends string")


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of ``sequences`` (conv_id, seq), one row each.

    Columns: conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Equal sequences are one with a number of copies before anything is sorted. No
    conversations, no nodes.
    """
    spark = sequences.sparkSession
    marked = sequences.withColumn("digest", F.unhex(F.md5("seq")))
    ends = ends_of(marked)
    distinct = marked.groupBy("digest", "seq").agg(F.count("*").alias("copies"), F.min("conv_id").alias("smallest"))
    distinct = scratch_table(distinct.join(ends, "digest").drop("digest"), "distinct")
    size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()
    ranges = max(parts_for(size[0], RANGE_ROWS, 1), parts_for(size[1], RANGE_BYTES, 1))
    # seq twice equal can't be: rows of a partition are told apart and ordered by it alone
    blocks = scratch_table(distinct.repartitionByRange(ranges, "seq").withColumn("part", F.spark_partition_id()), "blocks")

    ends_at = blocks.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    order = Window.orderBy("part")  # one row for each range
    borders = ends_at.select("part", F.lag("high").over(order).alias("previous"), F.lead("low").over(order).alias("next"))
    borders = scratch_table(borders, "borders")

    def fragments(key: tuple, rows: pa.Table, border: pa.Table) -> pa.Table:
        _, forest, left, right = _block(rows, border)
        part = key[0].as_py()
        table = forest.rows()
        entry, depth = table["entry"], table["depth"]
        at_left, at_right = _spines(forest, entry, depth, left, right)
        chosen = np.flatnonzero(at_left | at_right)
        from_left = at_left[chosen]
        lead = forest.prefix(np.zeros(1, np.int64), np.full(1, max(left, 0)))[0]
        out = {
            "part": np.full(len(chosen), part),
            "depth": depth[chosen],
            # the edge across the border belongs to the right of it: what it shares, and the child it joins
            "n": table["n_convs"][chosen],
            "id": table["conv_id"][chosen],
            "leaves": table["n_leaves"][chosen],
            "shared": table["shared"][chosen] + np.where(from_left, lead, 0),
            "kids": table["n_children"][chosen] - (from_left & (left > depth[chosen])),
        }
        hashes = [forest.digest(int(forest.first[e]), int(d)) for e, d in zip(entry[chosen], depth[chosen])]
        fix = [rows_ends(table["ends"][n]) for n in chosen]
        columns = [pa.array(v, pa.int64()) for v in out.values()]
        return pa.Table.from_arrays([pa.array(hashes, pa.binary()), *columns, pa.array(fix, pa.int64())], names=["hash", *out, "ending"])

    def rows_ends(position: int) -> int:
        return int(position >= 0)

    def nodes(key: tuple, rows: pa.Table, border: pa.Table) -> pa.Table:
        raw, forest, left, right = _block(rows, border)
        table = forest.rows()
        entry, depth = table["entry"], table["depth"]
        at_left, at_right = _spines(forest, entry, depth, left, right)
        ends = raw.column("ends").to_numpy()
        final = {name: table[name].copy() for name in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "shared")}
        spine = {}
        if "merged" in border.column_names and border.num_rows and border.column("merged")[0].as_py():
            spine = {(m["depth"], m["hash"]): m for m in border.column("merged")[0].as_py()}
        # the merged nodes of both ends, by depth
        merged: dict[tuple[int, int], dict] = {}
        for n in np.flatnonzero(at_left | at_right):
            found = spine[(int(depth[n]), forest.digest(int(forest.first[entry[n]]), int(depth[n])))]
            merged[(int(entry[n]), int(depth[n]))] = found
            final["conv_id"][n], final["n_convs"][n], final["n_leaves"][n] = found["id"], found["n"], found["leaves"]
            final["shared"][n], final["n_children"][n] = found["shared"], found["kids"]
        # parents: one step up the same chain, or the component above
        if merged:
            highest = depth == forest.top[entry] + 1
            above = np.where(highest, forest.up[entry], entry)
            suspects = np.zeros(len(forest.deep) + 1, bool)
            suspects[[e for e, _ in merged]] = True
            for n in np.flatnonzero(suspects[above] & (depth > 0)):
                found = merged.get((int(above[n]), int(depth[n]) - 1))
                if found:
                    final["parent_conv_id"][n] = found["id"]
        saved = final["shared"] - (final["n_convs"] - 1) * table["above"]
        ends_at = np.where(table["ends"] >= 0, ends[table["ends"]], NO_ENDS) if len(ends) else np.array([])
        mine = ~at_left  # a node is written where it begins
        # a member that ends at an open node is that node's first, so it stands in the same range as its beginning
        columns = {
            "conv_id": pa.array(final["conv_id"][mine]),
            "depth": pa.array(depth[mine]),
            "parent_conv_id": pa.array(final["parent_conv_id"][mine], mask=(depth == 0)[mine]),
            "n_convs": pa.array(final["n_convs"][mine]),
            "n_children": pa.array(final["n_children"][mine]),
            "n_leaves": pa.array(final["n_leaves"][mine]),
            "saved_tokens": pa.array(saved[mine]),
            "ends_sha256": pa.array(ends_at[mine].tolist(), pa.string()),
        }
        return pa.Table.from_pydict(columns)

    counts = "n long, id long, leaves long, shared long, kids long"
    found = blocks.groupBy("part").cogroup(borders.groupBy("part")).applyInArrow(fragments, f"hash binary, part long, depth long, {counts}, ending long")
    found = scratch_table(found, "fragments")
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "shared", "kids")]
    whole = found.groupBy("depth", "hash").agg(F.min("id").alias("id"), *sums)
    back = found.select("part", "depth", "hash").join(whole, ["depth", "hash"])
    spines = back.groupBy("part").agg(F.collect_list(F.struct("depth", "hash", "n", "id", "leaves", "shared", "kids")).alias("merged"))
    told = scratch_table(borders.join(spines, "part", "left"), "told")
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", ends_sha256 string"
    return blocks.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(nodes, schema)


def _block(rows: pa.Table, border: pa.Table) -> tuple[pa.Table, Forest, int, int]:
    """A range in order, its forest, and the edges across its borders (-1: there is no other range)."""
    rows = rows.sort_by("seq")
    keys = rows.column("seq").to_pylist()
    left = shared_turns(border.column("previous")[0].as_py(), keys[0])
    right = shared_turns(keys[-1], border.column("next")[0].as_py())
    open_end = right >= len(keys[-1]) // TURN.itemsize
    forest = Forest(keys, rows.column("copies").to_numpy(), rows.column("smallest").to_numpy(), open_end)
    return rows, forest, left, right


def _spines(forest: Forest, entry: np.ndarray, depth: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes go on beyond the left border, and which beyond the right one."""
    at_left = (forest.first[entry] == 0) & (depth <= left)
    at_right = (forest.last[entry] == len(forest.sizes) - 1) & (depth <= right)
    return at_left, at_right


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``rebuilt`` and ``trie``."""
    return trie(scratch_table(rebuilt(conversations), "sequences"))

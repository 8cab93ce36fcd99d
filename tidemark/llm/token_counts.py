"""Token counts by a compiled finite-state transducer for sentencepiece BPE models (operator 5).

BPE has a local property: for every prefix of a text exactly one vocabulary piece can end it such that it and
the last piece before it stay apart when merged together. So a prefix's tokens follow from those of shorter
prefixes, and what has to be remembered is finite: the longest suffix that begins some piece, with the last
piece and the relative count at each place in it where a later piece may begin. Those are the states. They are
compiled when a text first needs them, all that one step needs together; a transition emits the change of the
token count, so the sum along a text is its count.

A text is cut into chunks of equal length. Some characters (the space mark after another character, characters
outside the vocabulary) lead to one state from every state. So a chunk's state map is constant from its first
such character on: all chunks run from there in lockstep. A chunk without one has a map from entering to leaving
states, annotated with the tokens emitted on the way. It is computed for the states that can be reached: first
one guessed from the end of the chunk before, then whatever the maps before lead to, all chunks in lockstep. The
maps are composed by a scan that doubles its stride, which gives each chunk its entering state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tidemark.llm.common import text_slices

MARK = "▁"
CHUNK = 192
#: Characters before a chunk that its entering state is guessed from.
WARM = 48
#: Rounds in which maps grow in all chunks; what is still open then follows the text's own path only.
ROUNDS = 24
#: Rounds after which a state that the text's path leads to is tried in all later chunks of its run.
SPREAD = 3
#: Compiled states; those out of use are forgotten beyond that.
MAX_STATES = 600_000
ODD = -1  # a character that no piece holds: its bytes are tokens and nothing merges with it
BEGIN = -2  # the start, or any piece that can't merge with a following space mark
NONE = -3  # no place
NEVER = np.int64(1) << 40


class Table:
    """A hash table from whole numbers >= 0 to whole numbers >= 0, many at a time."""

    def __init__(self, size: int = 1 << 12):
        self.keys, self.values, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        mask = len(self.keys) - 1
        slot = self._slot(keys)
        found = self.keys[slot]
        wrong = np.flatnonzero((found != keys) & (found != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            now = found[wrong] = self.keys[slot[wrong]]
            wrong = wrong[(now != keys[wrong]) & (now != -1)]
        return np.where(found == -1, -1, self.values[slot])

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        if 2 * (self.filled + len(keys)) >= len(self.keys):
            used = self.keys >= 0
            old = self.keys[used], self.values[used]
            size = 1 << (4 * max(len(self.keys), len(keys)) - 1).bit_length()
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            self._place(*old)
        self._place(keys, values)
        self.filled += len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(-7046029254386353131) >> 32) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Each round those that find a free slot of their own are put there, then the others move on."""
        mask, slot, rest = len(self.keys) - 1, self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[slot[rest]] == -1
            taken, one = np.unique(slot[rest[free]], return_index=True)
            put = rest[free][one]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & mask


class Transducer:
    """The states of one model, compiled as needed, with a hash table of transitions.

    A state is a node of the trie of pieces, which stands for the longest suffix that begins one, and its places:
    for each of the suffix's own suffixes that begins a piece, longest first and the empty one last, the last
    piece before it and the count there less the count at the end.
    """

    def __init__(self, path: str):
        model = model_pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model_pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models that leave the text as it is and put a space before it")
        usable = [p for p in model.pieces if p.type == model_pb.ModelProto.SentencePiece.NORMAL]
        if any(MARK in p.piece.lstrip(MARK) for p in usable) or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("pieces may hold the space mark only at their start")
        by_score = sorted({p.score for p in usable}, reverse=True)
        place = {score: n for n, score in enumerate(by_score)}
        self.rank = {p.piece: place[p.score] for p in usable}
        self.pieces = list(self.rank)
        number = {piece: n for n, piece in enumerate(self.pieces)}
        if any(char not in number for piece in self.pieces for char in piece):
            raise ValueError("every character of a piece has to be a piece")
        whole, uneven = [], set()
        self.size = np.array([len(piece) for piece in self.pieces])
        self.rank_of = np.array([self.rank[piece] for piece in self.pieces], np.int64)
        self.split = np.zeros((len(self.pieces), 2), np.int64)
        for n, piece in enumerate(self.pieces):
            parts, last = self._merge(piece)
            if parts == [piece]:
                whole.append(n)
                self.split[n] = [number[part] for part in last] if last else -1
                if last and any(len(part) > 1 and (self.rank[part] >= self.rank[piece] or part in uneven) for part in last):
                    uneven.add(piece)
        self.uneven = np.array([piece in uneven for piece in self.pieces])
        self.ends_in_mark = np.array([piece.endswith(MARK) for piece in self.pieces])
        self.pairs = Table()
        joined = {number[p[:n]] << 24 | number[p[n:]]: self.rank[p] for p in self.pieces for n in range(1, len(p)) if p[:n] in number and p[n:] in number}
        self.pairs.put(np.array([*joined], np.int64), np.array([*joined.values()], np.int64))
        self._plant(number, whole)
        self.letters = np.zeros(0x110000, bool)
        self.letters[[ord(p) for p in self.pieces if len(p) == 1]] = True
        self.judged: dict[tuple[int, int], bool] = {}
        self.live: list[np.ndarray] = []
        self._reset()

    def _plant(self, number: dict[str, int], whole: list[int]) -> None:
        """The trie of the pieces, and for each node the nodes of its suffixes, the longest first and the root last."""
        nodes = {"": 0}
        for piece in self.pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.width = 2 + max(map(len, self.pieces))
        self.chain = np.full((len(nodes), self.width), -1, np.int64)
        for text, node in nodes.items():
            chain = [nodes[text[n:]] for n in range(len(text) + 1) if text[n:] in nodes]
            self.chain[node, : len(chain)] = chain
        self.chain_size = (self.chain >= 0).sum(1)
        self.piece_at = np.full(len(nodes), -1, np.int64)
        self.piece_at[[nodes[self.pieces[n]] for n in whole]] = whole
        self.children = Table()
        edges = [(nodes[text[:-1]] << 21 | ord(text[-1]), node) for text, node in nodes.items() if text]
        self.children.put(*np.array(edges, np.int64).T)

    def _reset(self) -> None:
        """Forgets all states but the two that every text meets, which are 0 and 1."""
        self._clear(1 << 12)
        root = np.full((2, self.width), NONE, np.int32)
        root[:, 0] = ODD, BEGIN
        self._states(np.zeros(2, np.int64), root, np.zeros((2, self.width), np.int8))
        after, emit = self._moves(np.array([1]), np.array([ord(MARK)]))
        self.mark_emit = int(emit[0])
        node, last, behind = self.node[after].copy(), self.last[after].copy(), self.behind[after].copy()
        self._clear(1 << 12)
        self._states(np.zeros(1, np.int64), root[:1], np.zeros((1, self.width), np.int8))
        self._states(node, last, behind)
        self.at_odd, self.at_mark = 0, 1

    def _clear(self, room: int) -> None:
        self.known, self.node = 0, np.zeros(room, np.int64)
        self.last, self.behind = np.full((room, self.width), NONE, np.int32), np.zeros((room, self.width), np.int8)
        self.found, self.moves = Table(1 << 16), Table(1 << 16)

    def _forget(self, states: np.ndarray) -> np.ndarray:
        """Keeps the states that are in use, numbers them anew and returns ``states`` with the new numbers."""
        used = np.unique(np.concatenate([[0, 1], states, *(held[held >= 0].ravel() for held in self.live)]).astype(np.int64))
        node, last, behind = self.node[used], self.last[used], self.behind[used]
        self._clear(1 << 12)
        self._states(node, last, behind)
        for held in self.live:
            held[held >= 0] = np.searchsorted(used, held[held >= 0])
        return np.searchsorted(used, states)

    def _states(self, node: np.ndarray, last: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The numbers of states; new ones are added in the order they come."""
        mixed = node.astype(np.uint64)
        for column in (*last.T, *behind.T):
            mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed >> np.uint64(2)).astype(np.int64)
        out = np.full(len(node), -1, np.int64)
        rest = np.arange(len(node))
        while len(rest):
            out[rest] = self.found.get(mixed[rest])
            new = rest[out[rest] < 0]
            if len(new):
                _, one = np.unique(mixed[new], return_index=True)
                new = new[np.sort(one)]
                numbers = self.known + np.arange(len(new))
                self._room(self.known + len(new))
                self.node[numbers], self.last[numbers], self.behind[numbers] = node[new], last[new], behind[new]
                self.found.put(mixed[new], numbers)
                self.known += len(new)
                out[rest] = self.found.get(mixed[rest])
            # states of equal hash move on to the next one
            same = (self.node[out[rest]] == node[rest]) & (self.last[out[rest]] == last[rest]).all(1) & (self.behind[out[rest]] == behind[rest]).all(1)
            rest = rest[~same]
            mixed[rest] += 1
        return out

    def _room(self, states: int) -> None:
        if states > len(self.node):
            more = max(states, 2 * len(self.node)) - len(self.node)
            self.node = np.append(self.node, np.zeros(more, np.int64))
            self.last = np.append(self.last, np.full((more, self.width), NONE, np.int32), 0)
            self.behind = np.append(self.behind, np.zeros((more, self.width), np.int8), 0)

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain BPE of a short text, the best score first, the leftmost of equals; and the last two parts merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for n in range(len(parts) - 1):
                rank = self.rank.get(parts[n] + parts[n + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, n
            if best is None:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(last)]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE of both pieces together leaves them as they are, for each pair.

        Goes back in time over what stood at the border: the right parts of the one and the left parts of the
        other, undoing the later merge first. They stay apart if no two of them would have merged before one
        of them was merged with its other neighbour.
        """
        out = left < 0
        odd = np.flatnonzero(~out & (self.uneven[left] | self.uneven[right]))
        out[odd] = [self._apart_slowly(*pair) for pair in zip(left[odd].tolist(), right[odd].tolist())]
        rest = np.flatnonzero((left >= 0) & ~(self.uneven[left] | self.uneven[right]))
        left, right = left[rest].astype(np.int64), right[rest].astype(np.int64)
        left_end = right_end = np.full(len(rest), NEVER)
        while len(rest):
            both = self.pairs.get(left << 24 | right)
            both[both < 0] = NEVER
            meet = (both < left_end) & (both <= right_end) & (both < NEVER)
            long_left = self.size[left] > 1
            undo_left = (self.size[right] == 1) | long_left & (self.rank_of[left] > self.rank_of[right])
            out[rest[~meet & undo_left & ~long_left]] = True
            go = np.flatnonzero(~meet & ~(undo_left & ~long_left))
            rest, left, right, undo = rest[go], left[go], right[go], undo_left[go]
            left_end = np.where(undo, self.rank_of[left], left_end[go])
            right_end = np.where(undo, right_end[go], self.rank_of[right])
            left, right = np.where(undo, self.split[left, 1], left), np.where(undo, right, self.split[right, 0])
        return out

    def _apart_slowly(self, left: int, right: int) -> bool:
        known = self.judged.get((left, right))
        if known is None:
            pair = [self.pieces[left], self.pieces[right]]
            known = self.judged[left, right] = self._merge("".join(pair))[0] == pair
        return known

    def _moves(self, states: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compiles transitions: the state after one more character of the vocabulary, and the change of the count."""
        row = np.arange(len(states))
        node = self.node[states]
        wide = int(self.chain_size[node].max())
        chain = self.chain[node, :wide]
        last, behind = self.last[states, :wide].copy(), self.behind[states, :wide]
        child = np.where(chain >= 0, self.children.get((np.maximum(chain, 0) << 21 | chars[:, None]).ravel()).reshape(chain.shape), -1)
        piece = np.where(child >= 0, self.piece_at[child], -1)
        fits = np.zeros(piece.shape, bool)
        fits[piece >= 0] = self._apart(last[piece >= 0], piece[piece >= 0])
        first = fits.argmax(1)
        if not fits[row, first].all():
            raise AssertionError("no piece ends a text")
        token, count = piece[row, first], behind[row, first] + 1
        at_mark = row[chars == ord(MARK)]
        empty = self.chain_size[node[at_mark]] - 1
        before = last[at_mark, empty]
        last[at_mark, empty] = np.where((before >= 0) & ~self.ends_in_mark[before], BEGIN, before)
        kept = child >= 0
        at = np.cumsum(kept, 1) - 1
        r, c = np.nonzero(kept)
        new_last, new_behind = np.full((len(row), self.width), NONE, np.int32), np.zeros((len(row), self.width), np.int8)
        new_last[r, at[r, c]], new_behind[r, at[r, c]] = last[r, c], behind[r, c] - count[r]
        new_last[row, kept.sum(1)] = token
        after = np.where(kept.any(1), child[row, kept.argmax(1)], 0)
        return self._states(after, new_last, new_behind), count

    def step(self, states: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the emitted change of each lane; compiles transitions that aren't known yet."""
        if self.known > MAX_STATES:
            states = self._forget(states)
        keys = states.astype(np.int64) << 21 | chars
        found = self.moves.get(keys)
        missing = found < 0
        if missing.any():
            new = np.unique(keys[missing])
            after, emit = self._moves(new >> 21, new & 0x1FFFFF)
            moves = after << 8 | (emit.astype(np.int64) + 128)
            self.moves.put(new, moves)
            found[missing] = moves[np.searchsorted(new, keys[missing])]
        return found >> 8, (found & 255) - 128

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of each text, for texts that begin at ``offsets`` of the UTF-8 bytes ``data``."""
        some = np.diff(offsets) > 0
        out = np.zeros(len(some), np.int64)
        if not some.any():
            return out
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        bytes_of = np.diff(np.append(lead, len(data)))
        first = np.searchsorted(lead, offsets[:-1][some])
        # the mark that goes before every text
        chars = np.insert(np.where(points == ord(" "), ord(MARK), points), first, ord(MARK))
        bytes_of = np.insert(bytes_of, first, 0)
        first = first + np.arange(len(first))
        reset = np.full(len(chars), -1, np.int32)
        emit = np.zeros(len(chars), np.int8)
        odd = ~self.letters[chars]
        reset[odd], emit[odd] = self.at_odd, bytes_of[odd]
        mark = chars == ord(MARK)
        begins = mark & np.append(True, ~mark[:-1])
        begins[first] = True
        reset[begins], emit[begins] = self.at_mark, self.mark_emit
        heads = self._run(chars, reset, emit)
        out[some] = np.add.reduceat(emit, first, dtype=np.int64)
        # a chunk's head begins no text: it is part of the one that its first character is in
        of = np.searchsorted(first, np.arange(len(heads)) * CHUNK, "right") - 1
        out[some] += np.bincount(of, heads, len(first)).astype(np.int64)
        return out

    def _run(self, chars: np.ndarray, reset: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """Fills in what characters emit from each chunk's first reset on; returns what the heads before emit.

        The first character of all is a reset.
        """
        n = len(chars)
        lanes = -(-n // CHUNK)
        size = lanes * CHUNK
        grid = [np.ascontiguousarray(np.append(part, np.zeros(size - n, part.dtype)).reshape(lanes, CHUNK).T) for part in (chars, reset, emit)]
        grid_chars, grid_reset, grid_emit = grid
        if size > n:
            grid_reset[CHUNK - (size - n) :, -1] = self.at_odd
        # tails: every chunk from its first reset on
        state = np.full(lanes, -1, np.int64)
        head = np.full(lanes, CHUNK)
        self.live = [state]
        for j in range(CHUNK):
            fixed = grid_reset[j] >= 0
            head[fixed & (state < 0)] = j
            live = np.flatnonzero(~fixed & (state >= 0))
            state[fixed] = grid_reset[j][fixed]
            if len(live):
                state[live], grid_emit[j, live] = self.step(state[live], grid_chars[j, live])
        emit[:] = grid_emit.T.ravel()[:n]
        heads = self._heads(grid_chars, head, state)
        self.live = []
        return heads

    def _through(self, chars: np.ndarray, lane: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs lanes from one row to another, all in lockstep: the state after it and the tokens emitted."""
        state, total = state.copy(), np.zeros(len(lane), np.int64)
        self.live.append(state)
        for j in range(int(start.min()), int(end.max())):
            live = np.flatnonzero((start <= j) & (j < end))
            after, emitted = self.step(state[live], chars[j, lane[live]])
            state[live] = after
            total[live] += emitted
        self.live.pop()
        return state, total

    def _heads(self, chars: np.ndarray, head: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """What the head of each chunk emits, by composing the chunks' maps; ``leaves`` is -1 where a map isn't constant."""
        total = np.zeros(len(head), np.int64)
        open_ended = leaves < 0
        lane = np.flatnonzero(head > 0)  # never the first chunk
        if not len(lane):
            return total
        entry = leaves[lane - 1].copy()
        guessed = entry < 0
        if guessed.any():
            before = lane[guessed] - 1
            begin = np.full(len(before), CHUNK - WARM)
            self.live.append(entry)
            entry[guessed], _ = self._through(chars, before, begin, begin + WARM, np.full(len(before), self.at_odd))
            self.live.pop()
        # one entry of a map each: the chunk, its entering and leaving state, the tokens emitted
        known_lane, known_entry, known_exit, known_total = (np.zeros(0, np.int64) for _ in range(4))
        starts = ~guessed  # the entries that the text itself passes, as far as known
        # the chunk that a run of chunks without a constant map ends with
        stop = np.minimum.accumulate(np.where(open_ended, len(head) - 1, np.arange(len(head)))[::-1])[::-1]
        rounds = 0
        while True:
            self.live += [known_entry, known_exit, entry]
            exits, emitted = self._through(chars, lane, np.zeros(len(lane), np.int64), head[lane], entry)
            del self.live[-3:]
            known_lane, known_entry = np.append(known_lane, lane), np.append(known_entry, entry)
            known_exit, known_total = np.append(known_exit, exits), np.append(known_total, emitted)
            starts = np.append(starts, np.zeros(len(known_lane) - len(starts), bool))
            follows = self._next(known_lane, known_entry, known_exit, open_ended, head)
            passed = self._passed(starts, follows)
            ends = np.flatnonzero(passed & (follows == -2))
            if not len(ends):
                break
            grow = ends if rounds >= ROUNDS else np.flatnonzero(follows == -2)
            lane, entry = known_lane[grow] + 1, known_exit[grow]
            if SPREAD <= rounds < ROUNDS:
                # text that repeats itself: what its path leads to is likely to come again
                here = known_lane[ends] + 1
                count = stop[here] - here + 1
                lane = np.append(lane, np.repeat(here - np.cumsum(count) + count, count) + np.arange(count.sum()))
                entry = np.append(entry, np.repeat(known_exit[ends], count))
            wanted = np.unique(lane[head[lane] > 0] << 32 | entry[head[lane] > 0])
            wanted = wanted[~np.isin(wanted, known_lane << 32 | known_entry)]
            lane, entry = wanted >> 32, wanted & 0xFFFFFFFF
            rounds += 1
        total[known_lane[passed]] = known_total[passed]
        return total

    @staticmethod
    def _next(lane: np.ndarray, entry: np.ndarray, leaves: np.ndarray, open_ended: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The entry of the next chunk's map that each entry leads to: -2 if it isn't known yet, -1 if none is needed."""
        keys = lane << 32 | entry
        order = np.argsort(keys)
        wanted = (lane + 1) << 32 | leaves
        at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
        found = np.where(keys[order][at] == wanted, order[at], -2)
        needed = open_ended[lane] & (np.append(head, 0)[lane + 1] > 0)
        return np.where(needed, found, -1)

    @staticmethod
    def _passed(starts: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """The entries on the paths from the starts: maps of 1, 2, 4 ... chunks are composed from halves."""
        passed, jump = starts.copy(), np.maximum(follows, -1)
        while (jump >= 0).any():
            passed[jump[passed & (jump >= 0)]] = True
            jump = np.where(jump >= 0, jump[jump], -1)
        return passed


@lru_cache(1)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as sentencepiece would count, without a shuffle.

    A NULL or empty text has 0 bytes and tokens. Other columns are left out; repeated rows and NULL ids stay.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for rows, data, offsets in text_slices(batches):
            tokens = transducer.counts(data, offsets)
            out = [rows.column("id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

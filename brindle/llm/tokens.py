"""Token counts of a byte-pair SentencePiece model by a compiled finite-state transducer.

Merges by priority have a left-to-right form: the pieces of a prefix end in exactly one piece that may stand after the
pieces before it, and whether two pieces may stand together depends on these two alone. So a deterministic transducer
can read characters and emit, with each, by how many tokens the count of the text so far has changed. Its states are
the piece beginnings that are still open, each with the class of the piece before it and the count there; they are
made when first met and kept in a hash table of transitions.

Texts are cut into segments, and these into chunks that all run side by side. A chunk doesn't know the state that it begins
in, but the machine restarts at every space after another character, so the map from entry state to exit state is
constant for nearly all chunks. For the others the map is held on the entry states that can occur: those that a chunk
before them can leave, all chunks adding theirs at once until none is new, which is soon, as states that read the same
characters soon agree or come round again. Maps are then composed by a parallel prefix scan, doubling the stretch of
chunks that a map spans in each step, which gives every chunk its true entry state; only then are tokens counted there.

States are made when first met. A machine that has MOST_STATES of them before a segment forgets them all and begins
anew, so its memory is bounded, whatever the texts: a segment of SEGMENT characters makes twice as many states at most.

Defined cases: null and empty texts have no tokens; special tokens' strings inside texts are ordinary text; characters
outside the vocabulary count a token per UTF-8 byte; texts of any length are counted whole, segment by segment, with or
without spaces; repeated rows are counted alike; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import raw_texts

SPACE = "▁"
SLAB = 1 << 21
CHUNK = 256
SEGMENT = 1 << 18
MOST_STATES = 1 << 19
_WIDTH = 4096
_UNKNOWN = 1
_STATE = (1 << 22) - 1
#: Entry states at most that all chunks hold because one of them met them late.
_SPREAD = 16
#: Subtrees of more pieces than this keep the preceding piece itself, not its class.
_CLASS_MOST = 60


def _led(nodes: np.ndarray, exits: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """The nodes that nodes with such exit states lead to."""
    chunk = (nodes >> 22) + 1
    goes = np.append(closed, False)[chunk]
    return np.unique(chunk[goes] << 22 | exits[goes])


class Transducer:
    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.pieces = sorted(score, key=lambda p: (len(p) > 1, -score[p] if len(p) > 1 else 0))
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.score = [score[p] for p in self.pieces]
        self.parts = [self._last_merge(p) for p in self.pieces]
        self.child: list[dict[int, int]] = [{}]
        self.ends = [-1]
        singles = [p for p in self.pieces if len(p) == 1 and p != SPACE]
        if len(singles) + 2 > _WIDTH:
            raise ValueError("the vocabulary has more single characters than the table has columns")
        self.column = {SPACE: 1} | {p: k + 2 for k, p in enumerate(singles)}
        self.columns = np.zeros(0x110000, np.int32)
        for p, k in self.column.items():
            self.columns[ord(p)] = k
        self.columns[32] = 1
        for r, p in enumerate(self.pieces):
            if self.parts[r] is None:
                continue
            node = 0
            for c in p:
                at = self.child[node].setdefault(self.column[c], len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.ends.append(-1)
                node = at
            self.ends[node] = r
        self.below: dict[int, list[int]] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.classes: dict[tuple, object] = {}
        self.first_of: dict[tuple, int] = {}
        self.width = len(singles) + 2
        self._forget()

    def _forget(self) -> None:
        """No states but the initial and the unknown one."""
        self.states: dict[tuple, int] = {((0, -1, 0),): 0, (): _UNKNOWN}
        self.list: list[tuple] = [((0, -1, 0),), ()]
        self.moves: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.moves |= {_UNKNOWN * _WIDTH + k: (_UNKNOWN, 0) for k in range(self.width)}
        self._empty(1 << 20)
        self._put(self.moves)

    # The vocabulary

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Pieces by plain merging, best score first, leftmost among equals, until ``stop`` are left."""
        own = list(text)
        while len(own) > stop:
            ranks = [self.rank.get(a + b) for a, b in zip(own, own[1:])]
            best = max((self.score[r] for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = next(k for k, r in enumerate(ranks) if r is not None and self.score[r] == best)
            own[at : at + 2] = [own[at] + own[at + 1]]
        return own

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; itself twice for a character; None if no merges make it."""
        if len(piece) == 1:
            return (self.rank[piece],) * 2
        own = self.merged(piece, 2)
        return (self.rank[own[0]], self.rank[own[1]]) if len(own) == 2 else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives a and b."""
        found = self.allowed.get((a, b))
        if found is None:
            one, two = self.pieces[a], self.pieces[b]
            if one[-1] == two[0] == SPACE and not one.strip(SPACE) and not two.strip(SPACE):
                found = self.merged(one + two) == [one, two]  # runs of spaces all have the same score
            else:
                found = self._kept(a, b)
            self.allowed[a, b] = found
        return found

    def _kept(self, left: int, right: int) -> bool:
        """Undo the last merges on both sides of the border, latest first, looking for an earlier merge across it."""
        bound = len(self.pieces)
        while True:
            across = self.rank.get(self.pieces[left] + self.pieces[right])
            if across is not None and across < bound:
                return False
            whole_left, whole_right = self.parts[left][1] == left, self.parts[right][0] == right
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                bound, left = left, self.parts[left][1]
            else:
                bound, right = right + 1, self.parts[right][0]

    def _below(self, node: int) -> list[int]:
        if node not in self.below:
            self.below[node] = [p for at in self.child[node].values() for p in ([self.ends[at]] if self.ends[at] >= 0 else []) + self._below(at)]
        return self.below[node]

    def _class(self, node: int, before: int) -> int | None:
        """One piece for all those after which the same pieces may come here; None if no piece may."""
        key = (node, before)
        if key not in self.classes:
            if len(self._below(node)) > _CLASS_MOST:
                self.classes[key] = before
            else:
                allowed = tuple(p for p in self._below(node) if self.may_follow(before, p))
                self.classes[key] = self.first_of.setdefault((node, allowed), before) if allowed else None
        return self.classes[key]

    # The machine

    def move(self, state: int, column: int) -> tuple[int, int]:
        """(next state, tokens emitted), compiled when first asked for."""
        key = state * _WIDTH + column
        found = self.moves.get(key)
        if found is None:
            last, opened = None, []
            for node, before, count in self.list[state]:
                at = self.child[node].get(column)
                if at is None:
                    continue
                end = self.ends[at]
                if last is None and end >= 0 and (before < 0 or self.may_follow(before, end)):
                    last = (end, count + 1)
                if self.child[at]:
                    opened.append((at, before, count))
            piece, emitted = last
            entries = []
            for node, before, count in opened:
                if before >= 0 and (before := self._class(node, before)) is None:
                    continue
                entries.append((node, before, count - emitted))
            new = (*entries, (0, piece, 0))
            to = self.states.setdefault(new, len(self.list))
            if to == len(self.list):
                self.list.append(new)
            found = self.moves[key] = (to, emitted)
        return found

    def _empty(self, size: int) -> None:
        """An open hash table; a slot packs state and column (34 bits), next state (22) and tokens emitted (8)."""
        self.table = np.full(size, -1, np.int64)
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.held = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _put(self, moves: dict[int, tuple[int, int]]) -> None:
        if (self.held + len(moves)) * 8 > len(self.table):
            self._empty(4 * len(self.table))
            moves = self.moves | moves
        mask = len(self.table) - 1
        for key, slot in zip(moves, self._slots(np.array(list(moves), np.int64)).tolist()):
            while self.table[slot] >= 0 and self.table[slot] >> 30 != key:
                slot = (slot + 1) & mask
            to, out = moves[key]
            self.held += self.table[slot] < 0
            self.table[slot] = key << 30 | to << 8 | out & 255

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Packed slots of keys; what is missing is compiled."""
        slots = self._slots(keys)
        got = self.table[slots]
        off = np.flatnonzero((got >> 30) != keys)
        mask = len(self.table) - 1
        while off.size:
            missing = off[got[off] < 0]
            if missing.size:
                self._put({k: self.move(k // _WIDTH, k % _WIDTH) for k in np.unique(keys[missing]).tolist()})
                return self._find(keys)
            slots[off] = (slots[off] + 1) & mask
            got[off] = self.table[slots[off]]
            off = off[(got[off] >> 30) != keys[off]]
        return got

    def emitted(self, columns: np.ndarray) -> np.ndarray:
        """Tokens emitted at each character of a sequence of columns; column 0 is a break."""
        before = np.r_[0, columns[:-1]]
        restart = (columns == 0) | (before == 0) | ((columns == 1) & (before != 1))
        out, open_state = [], self.list[0]
        for at in range(0, len(columns), SEGMENT):
            if len(self.list) > MOST_STATES:
                self._forget()
            entry = self.states.setdefault(open_state, len(self.list))
            if entry == len(self.list):
                self.list.append(open_state)
            made, leave = self._segment(columns[at : at + SEGMENT], restart[at : at + SEGMENT], entry)
            open_state = self.list[leave]
            out.append(made)
        return np.concatenate(out) if out else np.zeros(0, np.int8)

    def _segment(self, columns: np.ndarray, restart: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """(tokens emitted at each character, state at the end) of a segment that begins in a state."""
        n = len(columns)
        chunks = -(-n // CHUNK)
        pad = chunks * CHUNK - n
        side = np.ascontiguousarray(np.r_[columns, np.zeros(pad, columns.dtype)].reshape(chunks, CHUNK).T)
        fresh = np.ascontiguousarray(np.r_[restart, np.zeros(pad, bool)].reshape(chunks, CHUNK).T)
        size = np.full(chunks, CHUNK)
        size[-1] -= pad
        out = np.zeros((CHUNK, chunks), np.int8)

        def run(own: np.ndarray, state: np.ndarray, until: np.ndarray) -> np.ndarray:
            """States of some chunks after their first ``until`` characters, from given ones; output is kept."""
            order = np.argsort(-until, kind="stable")
            own, until, left = own[order], until[order], state[order].copy()
            for k in range(int(until[0]) if len(until) else 0):
                m = int(np.searchsorted(-until, -k))  # chunks that go on
                lane = own[:m]
                left[:m] *= ~fresh[k, lane]
                got = self._find(left[:m] * _WIDTH + side[k, lane])
                out[k, lane] = got  # its low byte
                left[:m] = (got >> 8) & ((1 << 22) - 1)
            state = np.empty_like(left)
            state[order] = left
            return state

        every = np.arange(chunks)
        head = np.where(fresh.any(axis=0), fresh.argmax(axis=0), size)
        closed = head == size  # no restart: what leaves the chunk depends on what enters it
        leave = run(every, np.where(closed, 0, _UNKNOWN), size)
        enters = np.r_[entry, leave[:-1]]
        if closed.any():
            enters, last = self._entries(closed, size, leave, entry, run)
            leave[-1] = last if closed[-1] else leave[-1]
        # A chunk's characters before its first restart, now that its entry is known.
        again = every[(head > 0)]
        run(again, enters[again], head[again])
        return np.ascontiguousarray(out.T).reshape(-1)[:n], int(leave[-1])

    @staticmethod
    def _entries(closed: np.ndarray, size: np.ndarray, leave: np.ndarray, entry: int, run: Callable) -> tuple[np.ndarray, int]:
        """(entry state of every chunk, exit state of the last): maps of closed chunks held on what can enter, and composed.

        A node is a closed chunk with one state that may enter it; it leads to the next chunk's node with the state that
        leaves it. leave has the exits of the others, and of closed chunks for the state 0.
        """
        chunks = len(closed)
        after = np.flatnonzero(closed)
        first = after[(after == 0) | ~closed[after - 1]]  # each begins a stretch of closed chunks
        given = np.where(first > 0, leave[first - 1], entry)
        known = after << 22  # chunk and entry state in one number
        exits = leave[after]
        new = np.setdiff1d(np.r_[first << 22 | given, _led(known, exits, closed)], known)
        rounds = 0
        while new.size:
            left = run(new >> 22, new & _STATE, size[new >> 22])
            known, exits = np.r_[known, new], np.r_[exits, left]
            new, rounds = _led(new, left, closed), rounds + 1
            if rounds >= 4 and rounds & (rounds - 1) == 0:
                # What still spreads chunk by chunk, as where a text repeats itself, is held by all chunks at once.
                new = np.union1d(new, (after[:, None] << 22 | np.unique(left)[:_SPREAD]).ravel())
            new = np.setdiff1d(new, known)
        order = np.argsort(known)
        known, exits = known[order], exits[order]
        # Where a node leads; the end of a stretch leads to itself.
        chunk = known >> 22
        goes = np.append(closed, False)[chunk + 1]
        leads = np.where(goes, np.searchsorted(known, np.where(goes, (chunk + 1) << 22 | exits, 0)), np.arange(len(known)))
        met = np.zeros(len(known), bool)
        met[np.searchsorted(known, first << 22 | given)] = True
        span = 1
        while span < chunks:  # all nodes that true entries lead to within span chunks; then maps of twice the span
            met[leads[met]] = True
            leads = leads[leads]
            span *= 2
        true = known[met]
        out = leave.copy()
        out[true >> 22] = exits[met]
        enters = np.r_[entry, out[:-1]]
        return enters, int(out[-1])

    def counts(self, texts: list[bytes | None]) -> list[int]:
        totals = [0] * len(texts)
        group: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _parts(text or b""):
                group.append((i, part))
                size += len(part)
                if size >= SLAB:
                    self._add(group, totals)
                    group, size = [], 0
        self._add(group, totals)
        return totals

    def _add(self, group: list[tuple[int, str]], totals: list[int]) -> None:
        if not group:
            return
        points = np.frombuffer("".join(f"\n{part}" for _, part in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *(len(part) + 1 for _, part in group[:-1])])
        columns = self.columns[points]
        columns[first] = 0
        outside = columns == 0
        outside[first] = False
        sizes = outside * (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        sums = np.add.reduceat(self.emitted(columns).astype(np.int64) + sizes, first)
        for (i, _), n in zip(group, sums.tolist()):
            totals[i] += n


def _parts(text: bytes) -> Iterator[str]:
    """The text as the library begins it, with a space, in parts of about a slab, cut before a space after another character."""
    if not text:
        return
    at, lead = 0, " "
    while len(text) - at > SLAB:
        end = text.find(b" ", at + SLAB - 1)
        while end > 0 and (text[end - 1 : end] == b" " or text[end - 3 : end] == SPACE.encode()):
            end = text.find(b" ", end + 1)
        if end < 0:
            break
        yield lead + text[at:end].decode("utf-8", "replace")
        at, lead = end, ""
    yield lead + text[at:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(model_file: str) -> Transducer:
    """One machine for a Python worker: what a task has compiled serves the next ones."""
    return Transducer(model_file)


def counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every text, without begin or end tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            texts = raw_texts(batch.column(1))
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(machine.counts(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, n_bytes long, n_tokens long")

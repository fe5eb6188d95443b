"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. The tokens of a text's prefixes determine each other: the last token
of a prefix is the one vocabulary entry that ends there and is compatible with
the last token before it (two tokens are compatible if encoding their joined
bytes gives the two back). So a state needs no more than the bytes since the
last settled boundary with the last token of each of their prefixes. Reading a
byte appends one last token. A boundary is live while some vocabulary entry
could still start there; as soon as all live boundaries share their first
tokens these are emitted, after a lookahead that the longest entry bounds.
States and transitions are made when first needed and kept, so common pieces
cost one lookup a byte, and whole pieces are remembered as well.

A text is cut by the pattern into pieces which are encoded separately; a piece
that is itself an entry is that token.

Decoding runs the tokens' bytes through an incremental UTF-8 state machine, which
keeps the bits of a character until its last byte is there. The machine's moves
over whole tokens are made lazily too, so a token costs one lookup.

Defined results: null counts as empty, an empty text has no tokens. Remembered
states are dropped when they reach their bound, pieces when half of theirs has
come since their last use, and made again; that changes no result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from contextlib import suppress
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.tables import ship, tidy

MAX_STATES = 150_000
MAX_PIECES = 600_000
#: Bytes that wait before settled tokens are looked for.
LOOKAHEAD = 16
NEVER = 1 << 60
ONE = [bytes([i]) for i in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """From the bytes of a piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.open = {t[:i] for t in ranks for i in range(1, len(t))}  # what some entry goes on from
        # A machine that finds the entries which end at a byte. A node is the longest end of what was read that begins an entry.
        self._nodes: dict[bytes, int] = {}
        self._begun: list[bytes] = []
        self._ends: list[tuple[tuple[int, int], ...]] = []  # the entries that end at a node and their lengths, longest first
        self._live: list[tuple[int, ...]] = []  # how many bytes ago an entry that goes on may have begun
        self._next: dict[int, int] = {}  # node << 8 | byte -> node
        self._node(b"")
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._state((None, b"", (), 0))

    def _state(self, key: tuple) -> int:
        i = self._ids.get(key[:3])  # the rest follows from the bytes
        if i is None:
            i = self._ids[key[:3]] = len(self._states)
            self._states.append(key)
        return i

    def _node(self, begun: bytes) -> int:
        i = self._nodes.get(begun)
        if i is None:
            i = self._nodes[begun] = len(self._begun)
            self._begun.append(begun)
            ends = [begun[k:] for k in range(len(begun))]
            self._ends.append(tuple((self.ranks[e], len(e)) for e in ends if e in self.ranks))
            self._live.append(tuple(len(e) for e in ends if e in self.open))
        return i

    def _further(self, node: int, byte: int) -> int:
        """The machine's node after one more byte; nodes are parts of entries, so only the steps between them need a bound."""
        to = self._next.get(node << 8 | byte)
        if to is None:
            read = self._begun[node] + ONE[byte]
            while read and read not in self.open and read not in self.ranks:
                read = read[1:]
            if len(self._next) >= 4 * self.max_states:
                self._next.clear()
            to = self._next[node << 8 | byte] = self._node(read)
        return to

    def by_merging(self, piece: bytes) -> tuple[list[int], tuple[bytes, bytes] | None]:
        """The definition: join the neighbours of least rank, leftmost first, until none can be; also the last two joined."""
        parts, last = [piece[i : i + 1] for i in range(len(piece))], None
        while True:
            rank, i = min(((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)), default=(NEVER, 0))
            if rank == NEVER:
                return [self.ranks[p] for p in parts], last
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def edges(self, token: int) -> tuple[list, list] | None:
        """What stands at a token's left and right edge while it is being joined: (bytes, rank of the join that ends it).

        None for an entry that joining never makes.
        """
        if token not in self._edges:
            piece = self.tokens[token]
            made, last = self.by_merging(piece)
            if made != [token]:
                self._edges[token] = None
            elif last is None:
                self._edges[token] = [(piece, NEVER)], [(piece, NEVER)]
            else:
                left, right = self.edges(self.ranks[last[0]])[0], self.edges(self.ranks[last[1]])[1]
                self._edges[token] = [*left[:-1], (left[-1][0], token), (piece, NEVER)], [*right[:-1], (right[-1][0], token), (piece, NEVER)]
        return self._edges[token]

    def _compatible(self, before: int, token: int) -> bool:
        """Whether encoding the two tokens' joined bytes gives the two.

        It doesn't if at some time the pieces on both sides of the boundary
        would be joined before either is joined with what is on its own side;
        of equal ranks the left join comes first.
        """
        known = self._pairs.get(before << 32 | token)
        if known is None:
            known = self.edges(token) is not None
            if known:
                ranks, left, right = self.ranks, iter(self.edges(before)[1]), iter(self.edges(token)[0])
                (x, ends_x), (y, ends_y) = next(left), next(right)
                while True:
                    rank = ranks.get(x + y, NEVER)
                    if rank < ends_x and rank <= ends_y:
                        known = False
                        break
                    if ends_x <= ends_y:
                        if ends_x == NEVER:
                            break
                        x, ends_x = next(left)
                    else:
                        y, ends_y = next(right)
            if len(self._pairs) >= 4 * self.max_states:
                self._pairs.clear()
            self._pairs[before << 32 | token] = known
        return known

    def _path(self, lasts: Sequence[int], end: int) -> list[int]:
        out, sizes = [], self.sizes
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= sizes[token]
        return out[::-1]

    def _last(self, node: int, before: int | None, lasts: Sequence[int]) -> int:
        """The last token of what was read up to the node: the one entry that ends there and is compatible with the token before it, mostly a long one."""
        n, pairs = len(lasts) + 1, self._pairs
        for token, size in self._ends[node]:
            left = lasts[n - size - 1] if size < n else before
            fits = self.edges(token) is not None if left is None else pairs.get(left << 32 | token)
            if fits or fits is None and self._compatible(left, token):
                return token
        raise ValueError(f"the vocabulary has no token that ends {self._begun[node]!r}")

    def _settle(self, node: int, lasts: Sequence[int]) -> int:
        """Where the tokens end that all live boundaries share: the paths to them are followed back until they meet."""
        n, sizes = len(lasts), self.sizes
        live = {n - k for k in self._live[node]}
        end = n
        while live:
            last = max(live)
            if last == end:
                live.remove(end)
            elif last > end:
                live.remove(last)
                live.add(last - sizes[lasts[last - 1]])
            else:
                end -= sizes[lasts[end - 1]]
        return end

    def _cut(self, pending: bytes, lasts: Sequence[int], end: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after the tokens that are settled up to `end`, and these."""
        emitted, node = tuple(self._path(lasts, end)), 0
        for byte in pending[end:]:  # entries that begin before the cut don't count any more
            node = self._further(node, byte)
        return (emitted[-1], pending[end:], tuple(lasts[end:]), node), emitted

    def _move(self, here: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after one more byte, and the tokens that it settles."""
        before, pending, lasts, node = here
        node = self._further(node, byte)
        lasts += (self._last(node, before, lasts),)
        pending += ONE[byte]
        end = self._settle(node, lasts) if len(lasts) >= LOOKAHEAD else 0
        return self._cut(pending, lasts, end) if end else ((before, pending, lasts, node), ())

    def stream(self, data: Iterable[int], keep: int = NEVER) -> Iterator[int]:
        """Token ids as soon as they are settled; of the transitions that have to be made, the first `keep` are remembered."""
        state, data = 0, iter(data)
        for byte in data:
            move = self._moves.get(state << 8 | byte)
            if move is not None:
                state, emitted = move
            elif keep:
                keep -= 1
                at = self._states[state]
                to, emitted = self._move(at, byte)
                if len(self._states) >= self.max_states:
                    self._reset()
                    state = self._state(at)
                key, state = state << 8 | byte, self._state(to)
                self._moves[key] = state, emitted
            else:
                state = yield from self._by_hand(self._states[state], chain((byte,), data))
                if state is None:
                    return
                continue
            if emitted:
                yield from emitted
        lasts = self._states[state][2]
        yield from self._path(lasts, len(lasts))

    def _by_hand(self, here: tuple, data: Iterable[int]) -> Generator[int, None, int | None]:
        """What _move does to the bytes one after the other, without keeping it; ends at a state that is kept, or with the data."""
        before, pending, lasts, node = here
        pending, lasts = bytearray(pending), list(lasts)
        steps, last = self._next, self._last
        for byte in data:
            node = steps.get(node << 8 | byte) or self._further(node, byte)
            lasts.append(last(node, before, lasts))
            pending.append(byte)
            end = self._settle(node, lasts) if len(lasts) >= LOOKAHEAD else 0
            if end:
                here, emitted = self._cut(bytes(pending), lasts, end)
                yield from emitted
                state = self._ids.get(here[:3])
                if state is not None:
                    return state
                before, pending, lasts, node = here[0], bytearray(here[1]), list(here[2]), here[3]
        yield from self._path(lasts, len(lasts))
        return None

    def encode(self, piece: bytes) -> list[int]:
        """All token ids of a piece; each new piece adds one transition, so that what only one piece uses isn't kept."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else list(self.stream(piece, keep=1))


#: Fixed values of UTF-8: first and last lead byte, bytes to follow, least and greatest second byte.
LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
#: A state of the UTF-8 machine: bits read of a character, bytes to follow, least and greatest next byte.
START = (0, 0, 0x80, 0xBF)
BAD = "\ufffd"


def utf8_step(state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
    """The machine's next state, and what the byte completes; a character that is cut short or begins wrong gives U+FFFD."""
    bits, need, low, high = state
    if need and low <= byte <= high:
        bits = bits << 6 | byte & 0x3F
        return ((bits, need - 1, 0x80, 0xBF), "") if need > 1 else (START, chr(bits))
    cut = BAD if need else ""
    if byte < 0x80:
        return START, cut + chr(byte)
    for first, last, more, low, high in LEADS:
        if first <= byte <= last:
            return (byte & 0x3F >> more, more, low, high), cut
    return START, cut + BAD


class Utf8Stream:
    """Text from bytes that come in any portions; a character waits for its last byte."""

    def __init__(self) -> None:
        self.state = START

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            self.state, text = utf8_step(self.state, byte)
            out.append(text)
        return "".join(out)

    def close(self) -> str:
        """What a character that never ended gives."""
        cut, self.state = self.state[1], START
        return BAD if cut else ""


class Made(dict):
    """Values that are made when first asked for and kept for good."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Decoder:
    """The UTF-8 machine run over whole tokens: a token's bytes from one state are stepped through once, and the move is kept."""

    def __init__(self, tokens: dict[int, bytes], max_moves: int = MAX_PIECES):
        self.tokens, self.max_moves = tokens, max_moves
        self.whole = Made(self._whole)
        self._forget()

    def _forget(self) -> None:
        self.states, self.numbers = [START], {START: 0}
        self.moves: dict[int, tuple[int, str]] = {}

    def _move(self, key: int) -> tuple[int, str]:
        machine = Utf8Stream()
        machine.state = self.states[key >> 32]
        text = machine.feed(self.tokens[key & 0xFFFFFFFF])
        if len(self.moves) >= self.max_moves:
            self._forget()
        number = self.numbers.setdefault(machine.state, len(self.states))
        if number == len(self.states):
            self.states.append(machine.state)
        move = number << 32, text
        if len(self.moves) or not key >> 32:  # after forgetting, the old number of a state other than the start is void
            self.moves[key] = move
        return move

    def _whole(self, token: int) -> str | None:
        """What a token completes by which the machine goes from its start to its start; None for other tokens."""
        state, text = self._move(token)
        return None if state else text

    def text(self, ids: Iterable[int]) -> str:
        """All that the stream gives. Between whole tokens the machine is at its start; only from others on it goes by single moves."""
        ids = list(ids)
        parts = list(map(self.whole.__getitem__, ids))
        try:
            return "".join(parts)
        except TypeError:
            pass
        at, n = 0, len(parts)
        with suppress(ValueError):
            while True:
                at = parts.index(None, at)
                state, text = self.moves.get(ids[at]) or self._move(ids[at])
                parts[at], at = text, at + 1
                while state and at < n:
                    state, text = self.moves.get(state | ids[at]) or self._move(state | ids[at])
                    parts[at], at = text, at + 1
                if state:
                    parts.append(BAD)
        return "".join(parts)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The characters that each token completes."""
        state, moves = 0, self.moves
        for i in ids:
            move = moves.get(state | i)
            if move is None:
                move = self._move(state | i)
                moves = self.moves
            state, text = move
            if text:
                yield text
        if state:
            yield BAD


class Codec:
    """Encoding and decoding of texts."""

    def __init__(self, path: str, pattern: str, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(read_ranks(path))
        self.decoder = Decoder(self.transducer.tokens)
        self.find = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self.decimal = [str(i) for i in range(max(self.transducer.tokens) + 1)]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}  # remembered before pieces was last full

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, add = self.pieces, out.extend
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.earlier.get(piece)
                if ids is None:
                    ids = tuple(self.transducer.encode(piece.encode()))
                if len(known) >= self.max_pieces // 2:
                    self.earlier, known = known, {}
                    self.pieces = known
                known[piece] = ids
            add(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.text(ids)


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process and vocabulary."""
    return Codec(path, pattern)


OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _encode(path: str, pattern: str, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        makes = {
            "n_tokens": len,
            "ids": lambda ids: ids,
            "ids_sha256": lambda ids: hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": lambda ids: hashlib.sha256(c.decode(ids).encode()).hexdigest(),
        }
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                columns = {o: [] for o in outputs}
                for text in part.column("text").to_pylist():
                    ids = c.encode(text or "")
                    for o in outputs:
                        columns[o].append(makes[o](ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(columns[o], OUTPUTS[o]) for o in outputs)], ["doc_id", *outputs])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, *, outputs: tuple[str, ...] = ("n_tokens", "ids"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and outputs for whole texts: n_tokens, ids, ids_sha256, and decoded_sha256, which decodes the ids again."""
    ship(docs.sparkSession)
    sql = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"doc_id {docs.schema[key].dataType.simpleString()}", *(f"{o} {sql[o]}" for o in outputs)])
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_encode(path, pattern, outputs)), schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decode(path, pattern)), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")

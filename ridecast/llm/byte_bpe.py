"""Byte-level BPE as a lazily determinised finite-state transducer, and decoding through a UTF-8 state machine.

The encoding of a text is the only sequence of vocabulary tokens of which every two neighbours are stable: merging their
joined bytes by rank gives just these two tokens again.  So the encoding of each prefix ends in one token, found from the
encodings of shorter prefixes.  A state of the transducer is the last token emitted, while that matters, and the bytes read after it.  A byte
adds the prefix that it ends; a prefix stays live while the bytes after it begin some token.  Tokens that the encodings of
all live prefixes share are emitted, so a token leaves as soon as no continuation can change it; nothing looks back
further.  States and transitions are made when a text first needs them and kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields

START = -1
FREE = -2
NO_RANK = 1 << 62
STATES = 1 << 18            # states that a worker keeps, and pairs; a full table is emptied and refilled
KNOWN = 1 << 19             # pieces that a worker keeps
PIECES = 1 << 16            # pieces of a text that are held at a time
BATCH_BYTES = 4 << 20       # ids or bytes in an Arrow batch, unless one row has more


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class State(dict):
    """byte -> (next state, ids emitted, packed).  Missing transitions are computed once.  ``ends[i]`` is the last token of
    the encoding of the first i bytes of ``text``, for the places in ``live`` and those that their encodings pass.  ``tail``
    holds the ids still pending if a piece ends here, once a piece has."""

    __slots__ = ("last", "text", "ends", "live", "machine", "tail")

    def __init__(self, machine: "Transducer", last: int, text: bytes, ends: tuple, live: tuple):
        self.machine, self.last, self.text, self.ends, self.live, self.tail = machine, last, text, ends, live, None

    def __missing__(self, byte: int):
        move = self[byte] = self.machine.move(self, byte)
        return move


class Transducer:
    """Encodes pieces of bytes by the ranks of a vocabulary that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.begins = {t[:i] for t in ranks for i in range(1, len(t))}
        self.packed = {r: r.to_bytes(4, "little") for r in self.tokens}
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        gc.collect()                                            # states point at each other
        self.start = self._state(START, b"", (START,), (0,))

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of a few bytes by merging the pair of least rank, the leftmost first."""
        rank = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        costs = [rank(raw[i:i + 2], NO_RANK) for i in range(len(raw) - 1)]
        while costs and (least := min(costs)) != NO_RANK:
            at = costs.index(least)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], NO_RANK)
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (or START)."""
        pair = (a << 32) + b                                    # one int: a tuple takes twice the room
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > STATES:
                self.pairs.clear()
            left = self.tokens[a] if a != START else b""
            known = self.pairs[pair] = self.merge(left + self.tokens[b]) == ([a, b] if a != START else [b])
        return known

    def _state(self, last: int, text: bytes, ends: tuple, live: tuple) -> State:
        if not live or live[0]:
            last = FREE                                         # no token can begin at the root any more: all are alike
        found = self.states.get((last, text))
        if found is None:
            found = self.states[last, text] = State(self, last, text, ends, live)
        return found

    def _path(self, ends: tuple, at: int) -> list[int]:
        """The tokens from the root of a state to place ``at``."""
        path = []
        while at:
            path.append(ends[at])
            at -= len(self.tokens[ends[at]])
        return path[::-1]

    def move(self, state: State, byte: int) -> tuple[State, bytes]:
        text, ends = state.text + bytes((byte,)), state.ends
        found, live = None, []
        for i in state.live:
            rest = text[i:]
            token = self.ranks.get(rest)
            if found is None and token is not None and self.stable(ends[i], token):
                found = token
            if rest in self.begins or not i and state.last == START and token is not None:
                live.append(i)
        ends = (*ends, found)
        if found is not None:
            live.append(len(text))
        heads = set(live)
        while len(heads) > 1:                                   # the last place that all live encodings pass
            at = max(heads)
            heads.remove(at)
            heads.add(at - len(self.tokens[ends[at]]))
        root, = heads
        if not root:
            return self._state(state.last, text, ends, tuple(live)), b""
        ids = b"".join(map(self.packed.__getitem__, self._path(ends, root)))
        return self._state(ends[root], text[root:], ends[root:], tuple(i - root for i in live)), ids

    def finish(self, state: State) -> bytes:
        """The ids still pending at the end of a piece.  A piece that is a token itself is that token."""
        if state.last == START and state.text in self.ranks:
            return self.packed[self.ranks[state.text]]
        return b"".join(map(self.packed.__getitem__, self._path(state.ends, len(state.text))))

    def encode(self, piece: bytes) -> bytes:
        """Little-endian 32-bit ids of one piece, in one pass over its bytes."""
        if len(self.states) > STATES:
            self.clear()
        out = bytearray()
        state = self.start
        for byte in piece:
            state, ids = state[byte]
            if ids:
                out += ids
                if len(self.states) > STATES:                  # a very long piece: start a new table in mid-run
                    keep = state
                    self.clear()
                    state = self._state(keep.last, keep.text, keep.ends, keep.live)
        if state.tail is None:
            state.tail = self.finish(state)
        return bytes(out) + state.tail if out else state.tail


class Pieces(dict):
    """piece -> its packed ids, through the transducer on first sight.  Half of ``KNOWN`` pieces make a generation; the one
    before is kept, and what is asked for again moves on, so that frequent pieces stay."""

    def __init__(self, machine: Transducer):
        self.machine, self.before = machine, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.machine.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= KNOWN // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the text that is complete, keeps the at most three bytes of an open character,
    and ``end`` closes the stream.  Ill-formed bytes become U+FFFD."""

    #: (first lead, last lead, least and greatest second byte, bytes that follow the lead): well-formed sequences.
    LEADS = ((0xC2, 0xDF, 0x80, 0xBF, 1), (0xE0, 0xE0, 0xA0, 0xBF, 2), (0xE1, 0xEC, 0x80, 0xBF, 2),
             (0xED, 0xED, 0x80, 0x9F, 2), (0xEE, 0xEF, 0x80, 0xBF, 2), (0xF0, 0xF0, 0x90, 0xBF, 3),
             (0xF1, 0xF3, 0x80, 0xBF, 3), (0xF4, 0xF4, 0x80, 0x8F, 3))

    def __init__(self):
        self.held = b""

    @classmethod
    def wants(cls, tail: bytes) -> bool:
        """Whether the bytes are the open beginning of a well-formed character."""
        for first, last, low, high, more in cls.LEADS:
            if first <= tail[0] <= last:
                return (len(tail) <= more and (len(tail) < 2 or low <= tail[1] <= high)
                        and all(0x80 <= b <= 0xBF for b in tail[2:]))
        return False

    def feed(self, data: bytes) -> str:
        data = self.held + data
        open_at = len(data)
        for i in range(len(data) - 1, max(len(data) - 4, -1), -1):
            if data[i] & 0xC0 != 0x80:                          # the last byte that begins a character
                if self.wants(data[i:]):
                    open_at = i
                break
        self.held = data[open_at:]
        return data[:open_at].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def known_pieces(vocabulary: bytes) -> Pieces:
    """The transducer of a rank file, kept for the next tasks of the same Python worker."""
    gc.set_threshold(100_000, 50, 50)                       # its tables are hundreds of thousands of live objects
    return Pieces(Transducer(read_ranks(vocabulary)))


def encode_text(text: str, pattern: regex.Pattern, known: Pieces) -> bytes:
    """Packed ids of a whole text, a block of pieces at a time."""
    if len(text) <= PIECES:
        return b"".join(map(known.__getitem__, pattern.findall(text)))
    found = pattern.finditer(text)
    out = []
    while block := [m.group() for m in islice(found, PIECES)]:
        out.append(b"".join(map(known.__getitem__, block)))
    return b"".join(out)


def decode_ids(ids: np.ndarray, tokens: list[bytes] | dict[int, bytes]) -> str:
    """The text of a row of ids, block by block."""
    machine, out = Utf8Machine(), []
    for a in range(0, len(ids), PIECES):
        out.append(machine.feed(b"".join(map(tokens.__getitem__, ids[a:a + PIECES].tolist()))))
    out.append(machine.end())
    return "".join(out)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator:
    for value in batch.column(column):
        yield value.as_py()


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", column: str = "text",
           packed: bool = False) -> DataFrame:
    """(key, n_tokens, ids) per row of ``docs``; ``ids`` is an array of ints, or with ``packed`` little-endian unsigned
    32-bit ids in one binary.  ``vocabulary`` is the content of a rank file.

    Each row is on its own: null counts as the empty text and gives no ids; repeated rows and null keys stay as they are;
    other columns are left out, whatever their names; an empty table gives an empty one.  A task holds one text, its ids
    and ``STATES`` states and pairs and ``KNOWN`` pieces at most (about 300 MB), so a text of n bytes takes about 10 n bytes
    beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rule = known_pieces(vocabulary), regex.compile(pattern)
        for batch in batches:
            first, ids, size = 0, [], 0
            for i, text in enumerate(_rows(batch, 1)):
                ids.append(encode_text(text or "", rule, known))
                size += len(ids[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pack(batch.column(0)[first:i + 1], ids)
                    first, ids, size = i + 1, [], 0

    def pack(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        if packed:
            column = pa.array(ids, pa.binary())
        else:
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            column = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        return pa.RecordBatch.from_arrays([keys, pa.array(counts), column], ["key", "n_tokens", "ids"])

    rows = fields(docs, key, column).toDF("key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}")
    return out.withColumnRenamed("key", key)


def decode(rows: DataFrame, vocabulary: bytes, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, text) per row of ``rows``: the text of its ids (an array of ints or packed).  Null ids give a null text, no
    ids the empty text; an id that the vocabulary lacks raises an error; bytes that are no UTF-8 become U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(vocabulary)
        tokens: list = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, ids in enumerate(_rows(batch, 1)):
                if ids is None:
                    texts.append(None)
                else:
                    texts.append(decode_ids(np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.array(ids, np.int64),
                                            tokens))
                    size += len(texts[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:i + 1], pa.array(texts, pa.string())],
                                                     ["key", "text"])
                    first, texts, size = i + 1, [], 0

    frame = fields(rows, key, column).toDF("key", "ids")
    kind = frame.schema["key"].dataType.simpleString()
    return frame.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) per row of ``docs``: packed ids as of ``encode`` and the text that they decode to, in
    one pass, so that a worker has one set of tables.  Odd rows as in ``encode``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rule = known_pieces(vocabulary), regex.compile(pattern)
        for batch in batches:
            first, ids, texts, size = 0, [], [], 0
            for i, text in enumerate(_rows(batch, 1)):
                ids.append(encode_text(text or "", rule, known))
                texts.append(decode_ids(np.frombuffer(ids[-1], "<u4"), known.machine.tokens))
                size += len(ids[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[first:i + 1], pa.array([len(x) // 4 for x in ids], pa.int64()),
                         pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["key", "n_tokens", "ids", "decoded"])
                    first, ids, texts, size = i + 1, [], [], 0

    rows = fields(docs, key, column).toDF("key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)


def digest(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of a round trip, row by row."""
    return round_trip(docs, vocabulary, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

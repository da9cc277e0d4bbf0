"""Byte-level BPE as a lazily determinised transducer, and decoding as a streaming UTF-8 machine."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import fresh, long_lists

#: More transducer states, pairs or remembered pieces than these are dropped and built anew, so memory stays bounded.
MAX_STATES = 100_000
MAX_PAIRS = 500_000
MAX_PIECES = 100_000
#: Bytes of a piece after which agreed tokens are emitted before its end is seen.
LOOKAHEAD = 256
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of ids and texts handed on at once, whatever the batch; a longer text comes alone.
HANDED_BYTES = 1 << 20


class Transducer:
    """Encodes pieces byte by byte with the ranks of a vocabulary.

    A path through the automaton is a run of tokens of which each two neighbours stay apart when they are merged side
    by side; exactly one such run spells a given text, and it is its BPE encoding. A state is the set of places in the
    token trie at which a token begun at some earlier byte may stand; states and steps are made when a text first
    reaches them. At each byte the one token that can end there is kept in a register window, so the paths of all tokens
    still open are known; what they agree on is emitted, and the window is cut there.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.children: dict[int, int] = {}
        self.token_at = [-1]
        self.depth = [0]
        self.inner = {0}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            if self._reachable(rank):
                node = 0
                for byte in token:
                    key = node << 8 | byte
                    if key not in self.children:
                        self.children[key] = len(self.token_at)
                        self.token_at.append(-1)
                        self.depth.append(self.depth[node] + 1)
                        self.inner.add(node)
                    node = self.children[key]
                self.token_at[node] = rank
        self.apart: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.remembered = Remembered(self)
        self._restart()

    def _restart(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple[int, ...]] = []
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self._intern((0,), ())

    def _reachable(self, rank: int) -> bool:
        """Whether merging the token's own bytes gives the token; notes its two halves."""
        parts = [self.tokens[rank][i:i + 1] for i in range(len(self.tokens[rank]))]
        halves = None
        while len(parts) > 1:
            best = min(((self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks), default=None)
            if best is None:
                return False
            i = best[1]
            halves = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
            if max(halves) > best[0] and min(map(len, parts[i:i + 2])) > 1:
                raise ValueError("a merge has a lower rank than one it is made of")
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        self.halves[rank] = halves
        return True

    def _edge(self, rank: int, side: int) -> list[tuple[bytes, float, float]]:
        """Parts that touch the left (0) or right (1) end of a token, with the ranks at which each appears and goes."""
        out, goes, at = [], float("inf"), rank
        while True:
            halves = self.halves[at]
            out.append((self.tokens[at], at if halves else -1, goes))
            if not halves:
                break
            goes, at = at, halves[side]
        self.edges[side][rank] = out
        return out

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens remain two when their bytes stand side by side: no merge across the seam comes first."""
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > MAX_PAIRS:
                self.apart.clear()
            known = self.apart[key] = not self._merges(self.edges[1].get(left) or self._edge(left, 1), self.edges[0].get(right) or self._edge(right, 0))
        return known

    def _merges(self, left: list, right: list) -> bool:
        rank_of = self.ranks.get
        for a, a_born, a_goes in left:
            for b, b_born, b_goes in right:
                # parts that never stand side by side aren't looked up; of equal ranks the leftmost merges first
                if b_born < a_goes and a_born <= b_goes:
                    rank = rank_of(a + b)
                    if rank is not None and rank < a_goes and rank <= b_goes:
                        return True
        return False

    def _intern(self, nodes: tuple[int, ...], ends: tuple[tuple[int, int], ...]) -> int:
        if (nodes, ends) not in self.number:
            self.number[nodes, ends] = len(self.states)
            self.states.append(nodes)
            self.ends.append(ends)
        return self.number[nodes, ends]

    def _step(self, at: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The state behind a byte: open tokens one byte on, a new one at the root, and the tokens that may end here."""
        met = [child for node in self.states[at] if (child := self.children.get(node << 8 | byte)) is not None]
        made = self._intern((*(c for c in met if c in self.inner), 0), tuple((self.token_at[c], self.depth[c]) for c in met if self.token_at[c] >= 0))
        step = self.steps[at << 8 | byte] = (made, self.ends[made])
        return step

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._restart()
        at, out, steps, apart = 0, [], self.steps, self.apart
        chosen = [-1]  # the token that ends at each byte of the window; first the one before it
        windowed = len(piece) > LOOKAHEAD
        for byte in piece:
            try:
                at, ends = steps[at << 8 | byte]
            except KeyError:
                at, ends = self._step(at, byte)
            for token, length in ends:
                before = chosen[-length]
                if before < 0:
                    break
                known = apart.get(before << 32 | token)
                if known or known is None and self._apart(before, token):
                    break
            chosen.append(token)
            if windowed and len(chosen) > LOOKAHEAD + 1:
                chosen = self._emit(chosen, {len(chosen) - 1 - self.depth[node] for node in self.states[at]}, out)
        rest = self._run(chosen, len(chosen) - 1)
        return out + rest if out else rest

    def _run(self, chosen: list[int], at: int) -> list[int]:
        """The tokens of the window up to a byte."""
        run, length = [], self.length
        while at:
            token = chosen[at]
            run.append(token)
            at -= length[token]
        run.reverse()
        return run

    def _emit(self, chosen: list[int], open_at: set[int], out: list[int]) -> list[int]:
        """Emit the tokens up to the last byte that the paths of all open tokens pass; the window that is left."""
        while len(open_at) > 1:
            furthest = max(open_at)
            open_at.remove(furthest)
            open_at.add(furthest - self.length[chosen[furthest]])
        agreed = open_at.pop()
        out.extend(self._run(chosen, agreed))
        return chosen[agreed:]

    def encode_packed(self, pieces: Iterable[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.remembered.__getitem__, pieces)), np.int32)

    def encode(self, pieces: Iterable[str]) -> list[int]:
        return self.encode_packed(pieces).tolist()


class Remembered(dict):
    """Ids (32-bit, packed) of the short pieces met lately; others are encoded when asked for. When ``MAX_PIECES`` are held they become
    the older half, from which what is met again comes back, and the half before them goes."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.encode_piece, self.older = machine.encode_piece, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.encode_piece(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self) >= MAX_PIECES:
                self.older.clear()
                self.older.update(self)
                self.clear()
            self[piece] = ids
        return ids


#: Lead byte ranges of UTF-8 with the range of the next byte and the number of bytes that follow (Unicode, table 3-7).
UTF8_LEADS = ((0xC2, 0xDF, 0x80, 0xBF, 1), (0xE0, 0xE0, 0xA0, 0xBF, 2), (0xE1, 0xEC, 0x80, 0xBF, 2), (0xED, 0xED, 0x80, 0x9F, 2), (0xEE, 0xEF, 0x80, 0xBF, 2),
              (0xF0, 0xF0, 0x90, 0xBF, 3), (0xF1, 0xF3, 0x80, 0xBF, 3), (0xF4, 0xF4, 0x80, 0x8F, 3))


class StreamingDecoder:
    """Token ids to text, piece by piece. The state is the beginning of a character: its bytes, the range of the next
    one and how many follow. What can't become a character gives U+FFFD, one for each longest beginning."""

    START = (b"", 0, 0, 0)

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.state, self.known = tokens, self.START, {}
        #: Text of the tokens that are whole characters.
        self.whole: dict[int, str] = {}
        self.leads = {b: (low, high, n) for first, last, low, high, n in UTF8_LEADS for b in range(first, last + 1)}

    def _bytes(self, state: tuple, data: bytes) -> tuple[tuple, str]:
        out = []
        held, low, high, left = state
        for byte in data:
            if left:
                if low <= byte <= high:
                    held, low, high, left = held + bytes([byte]), 0x80, 0xBF, left - 1
                    if not left:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held, left = b"", 0
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.leads:
                held, (low, high, left) = bytes([byte]), self.leads[byte]
            else:
                out.append("�")
        return (held, low, high, left) if left else self.START, "".join(out)

    def feed(self, ids: Iterable[int]) -> str:
        if self.state is self.START:
            try:
                return "".join([self.whole[i] for i in ids])
            except KeyError:  # a character in several tokens, or one not met yet: step by step
                pass
        out, state, known = [], self.state, self.known
        for i in ids:
            step = known.get((state, i))
            if step is None:
                if len(known) > MAX_PIECES:
                    known.clear()
                step = known[state, i] = self._bytes(state, self.tokens[i])
                if state is self.START and step[0] is self.START:
                    self.whole[i] = step[1]
            state = step[0]
            out.append(step[1])
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.state[3] else ""
        self.state = self.START
        return rest


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


_compiled: dict[int, Transducer] = {}


def _transducer(content: bytes) -> Transducer:
    """One per Python worker and vocabulary."""
    if hash(content) not in _compiled:
        _compiled.clear()
        _compiled[hash(content)] = Transducer(parse_ranks(content))
    return _compiled[hash(content)]


_tokens: dict[int, dict[int, bytes]] = {}


def _token_bytes(content: bytes) -> dict[int, bytes]:
    """Bytes of each token, one table per Python worker and vocabulary; decoding needs no transducer."""
    if hash(content) not in _tokens:
        _tokens.clear()
        _tokens[hash(content)] = {i: b for b, i in parse_ranks(content).items()}
    return _tokens[hash(content)]


def handed(rows: Iterable, size: Callable) -> Iterator[list]:
    """The rows in lists of ``HANDED_BYTES`` or little more, one at least."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= HANDED_BYTES:
            yield part
            part, held = [], 0
    yield part


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    return long_lists(rows, pa.int32())


def read_vocabulary(spark: SparkSession, path: str):
    """The rank file, sent to the executors once; a file above ``MAX_VOCABULARY_BYTES`` is refused."""
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def encode_column(text: Column, vocabulary, pattern: str) -> Column:
    """array<int> of token ids; null counts as empty."""
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine, cut = _transducer(vocabulary.value), regex.compile(pattern)
        for texts in batches:
            rows = (machine.encode_packed(cut.findall(t.as_py() or "")) for t in texts)
            yield from map(_id_lists, handed(rows, lambda ids: ids.nbytes))
    return encode(text)


def decode_column(ids: Column, vocabulary) -> Column:
    """Text of token ids; null counts as none. Bytes that are no UTF-8 give U+FFFD."""
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = StreamingDecoder(_token_bytes(vocabulary.value))
        for lists in batches:
            rows = (decoder.feed(x.values.to_numpy().tolist() if x.is_valid else ()) + decoder.finish() for x in lists)
            yield from (pa.array(part, pa.string()) for part in handed(rows, len))
    return decode(ids)


def round_trip_batches(batches: Iterator[pa.Array], content: bytes, pattern: str) -> Iterator[pa.Array]:
    """Ids and decoded text of each text, in parts of ``HANDED_BYTES`` whatever the batch."""
    machine, cut = _transducer(content), regex.compile(pattern)
    decoder = StreamingDecoder(machine.tokens)
    for texts in batches:
        own = (machine.encode_packed(cut.findall(t.as_py() or "")) for t in texts)
        rows = ((ids, decoder.feed(ids.tolist()) + decoder.finish()) for ids in own)
        for part in handed(rows, lambda row: row[0].nbytes + len(row[1])):
            yield pa.StructArray.from_arrays([_id_lists([ids for ids, _ in part]), pa.array([x for _, x in part], pa.string())], ["ids", "decoded"])


def round_trip_column(text: Column, vocabulary, pattern: str) -> Column:
    """struct<ids, decoded>: token ids of a text and the text decoded from them, made by one worker instead of two, so
    the ids don't travel to the JVM and back and each task holds one transducer."""
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return round_trip_batches(batches, vocabulary.value, pattern)
    return both(text)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus token ids under ``ids`` (underscores in front if the name is taken).

    Every row is encoded alone: null and empty texts give no ids, repeated rows equal ids, other columns stay, an empty
    table stays empty. A text of any length is encoded in one pass that keeps only the ids.
    """
    return docs.withColumn(fresh(docs, ids), encode_column(F.col(f"`{text}`"), read_vocabulary(docs.sparkSession, path), pattern))


def decode_documents(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` plus the decoded text under ``text`` (underscores in front if the name is taken). Null ids give an empty text."""
    return tokens.withColumn(fresh(tokens, text), decode_column(F.col(f"`{ids}`"), read_vocabulary(tokens.sparkSession, path)))


def round_trip_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` plus the token ids and the text decoded from them (underscores in front of names that are taken): what
    ``encode_documents`` and ``decode_documents`` give one after the other."""
    made, ids, decoded = fresh(docs, "made"), fresh(docs, ids), fresh(docs, decoded)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.withColumn(made, round_trip_column(F.col(f"`{text}`"), read_vocabulary(docs.sparkSession, path), pattern))
    return both.select(*kept, F.col(f"{made}.ids").alias(ids), F.col(f"{made}.decoded").alias(decoded))

"""Byte-level BPE as a finite-state transducer that is determinised only where texts lead it.

After each byte exactly one vocabulary token can end the merged form of what was read so far, so the
parses of all prefixes form a tree. Of that tree only the ends that a longer token may still start from
are open, and they lie within one longest token. A state is the list of open ends, each with its place in
the vocabulary's trie and the token before it; beside it goes the token that ended at each recent byte.
Reading a byte drops the ends that no token can reach any more; tokens on which all the others agree are
certain and are emitted. States are numbered when first met and their transitions are kept; both tables
are emptied when they grow too large.

Two tokens may stand side by side only if merging their bytes gives just these two; that is derived from
the parts that meet at their border while they are merged, once for a pair. Decoding is streamed: ids become
bytes in small runs, which pass through an incremental UTF-8 state machine that keeps the bytes of an unfinished
character between runs.

Null text: as empty text, no ids. Any bytes decode; malformed UTF-8 becomes U+FFFD in the decoded text
(the decoded bytes stay as they are). Rows repeat and doc_id may be null; each row stands alone. Long texts are
taken whole. Empty table: no rows. Extra columns stay; those with the name of a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import aside, carried, schema_with

#: Largest number of transitions, states and remembered pieces in one Python worker.
KEEP_TRANSITIONS, KEEP_PIECES = 400_000, 300_000
#: Longest piece that is remembered.
LONG_PIECE = 48
NO_TOKEN, LAST = -1, 1 << 60
#: Bytes of a long piece after which the tokens that are certain are emitted.
EMIT_EVERY = 1024
#: Key of a state's own number among its moves.
OWN = -1
#: Ids that one step of the decoder takes.
DECODE_RUN = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """States and transitions over the bytes of one piece (a match of the splitting pattern)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words = ranks, {i: w for w, i in ranks.items()}
        self.sizes = {i: len(w) for w, i in ranks.items()}
        self.children: dict[int, int] = {}  # a trie of the vocabulary: node << 8 | byte -> node
        self.inner: list[bool] = [False]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for word, i in ranks.items():
            node = 0
            for b in word:
                nxt = self.children.get(node << 8 | b)
                if nxt is None:
                    nxt = self.children[node << 8 | b] = len(self.inner)
                    self.inner[node] = True
                    self.inner.append(False)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = i
        self.fits: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict] = []  # for each state: byte -> (the next state's moves, closing token); OWN -> its number
        self.n_moves = 0
        self.start = self._number(((0, NO_TOKEN),))

    def _number(self, state: tuple) -> int:
        n = self.ids.get(state)
        if n is None:
            n = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({OWN: n})
        return n

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Parts left by merging the lowest-ranked pair, the leftmost first, down to ``until`` parts: the definition."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: int) -> tuple[list, list] | None:
        """For both edges of a token, the parts that stand there while it is merged, each with the rank at
        which it is merged away; None for a token that merging never gives."""
        known = self.edges.get(token, self)
        if known is not self:
            return known
        word = self.words[token]
        left, right = [(word, LAST)], [(word, LAST)]
        halves = self.merged(word, 2) if len(word) > 1 else []
        if len(word) > 1 and (len(halves) != 2 or self.ranks.get(halves[0] + halves[1]) != token):
            self.edges[token] = None
            return None
        if halves:
            inner = [self.spines(self.ranks[h]) for h in halves]
            left += [(w, min(d, token)) for w, d in inner[0][0]]
            right += [(w, min(d, token)) for w, d in inner[1][1]]
        self.edges[token] = (left, right)
        return left, right

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens keeps them apart: no pair of parts that meet at their
        border is merged before either is merged away. At equal ranks the pair further left goes first."""
        key = left << 32 | right
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > KEEP_TRANSITIONS:
                self.fits.clear()
            a, b = self.spines(left), self.spines(right)
            ok = a is not None and b is not None
            if ok:
                get = self.ranks.get
                for y, y_ends in b[0]:
                    for x, x_ends in a[1]:
                        r = get(x + y)
                        if r is not None and r < x_ends and r <= y_ends:
                            ok = False
                            break
                    if not ok:
                        break
            self.fits[key] = ok
        return ok

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        """The next state, and the token that ends the merged form of what was read with this byte."""
        state, closing = [], NO_TOKEN
        for node, last in self.states[number]:
            nxt = self.children.get(node << 8 | byte)
            if nxt is None:
                continue
            if self.inner[nxt]:
                state.append((nxt, last))
            token = self.token_at[nxt]
            if token >= 0 and closing < 0 and (self.may_follow(last, token) if last != NO_TOKEN else self.spines(token) is not None):
                closing = token
        if closing < 0:
            raise ValueError("the vocabulary lacks single bytes")
        state.append((0, closing))
        return self._number(tuple(state)), closing

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.n_moves > KEEP_TRANSITIONS:
            self._clear()
        moves, out = self.moves[self.start], []
        closed: list[int] = []  # for each byte since the last emission the token that ended there
        add = closed.append
        for at in range(0, len(piece), EMIT_EVERY):
            if at:
                self._emit(moves[OWN], closed, out)
            for byte in piece[at : at + EMIT_EVERY]:
                try:
                    moves, token = moves[byte]
                except KeyError:
                    state, token = self._step(moves[OWN], byte)
                    self.n_moves += 1
                    moves[byte] = (self.moves[state], token)
                    moves = self.moves[state]
                add(token)
        out += self._path(closed, len(closed))  # the end of the piece closes the last open end
        return out

    def _path(self, closed: list[int], end: int) -> list[int]:
        out, sizes = [], self.sizes
        while end:
            out.append(closed[end - 1])
            end -= sizes[out[-1]]
        return out[::-1]

    def _emit(self, state: int, closed: list[int], out: list[int]) -> None:
        """Moves the tokens on which all open ends agree to the output, and forgets their bytes."""
        paths = [self._path(closed, len(closed) - self.depth[node]) for node, _ in self.states[state]]
        k = 0
        while all(len(p) > k for p in paths) and len({p[k] for p in paths}) == 1:
            k += 1
        out += paths[0][:k]
        del closed[: sum(self.sizes[t] for t in paths[0][:k])]


#: A splitting pattern, and what gives the same pieces faster on texts of the characters in SIMPLE: there
#: letters are A-Z, a-z and the Latin letters from U+00C0 to U+024F, digits 0-9, white space blank and U+0009 to U+000D.
_LETTERS, _SPACE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\\t-\\r "
SIMPLE = re.compile("[\x00-\x1b\x20-\x7f\u00c0-\u024f]*")
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIMPLE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}0-9{_LETTERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.known = pattern == KNOWN_PATTERN
        self.seen: dict[str, bytes] = {}
        top = max(ranks.values(), default=-1) + 1
        self.token_bytes = [self.transducer.words.get(i, b"") for i in range(top)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        seen, get, out = self.seen, self.seen.get, []
        split = SIMPLE_PATTERN if self.known and SIMPLE.fullmatch(text) else self.pattern
        for piece in split.findall(text):
            ids = get(piece)
            if ids is None:
                ids = array("I", self.transducer.encode_piece(piece.encode())).tobytes()
                if len(piece) <= LONG_PIECE:
                    if len(seen) >= KEEP_PIECES:
                        seen.clear()
                    seen[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode_runs(self, ids: Iterable[int]) -> Iterator[bytes]:
        word, ids = self.token_bytes.__getitem__, iter(ids)
        while run := list(islice(ids, DECODE_RUN)):
            yield b"".join(map(word, run))

    def decode_text(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return "".join([machine.feed(run)[0].decode() for run in self.decode_runs(ids)]) + machine.close()[0].decode()

    def decoded_bytes(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes that ids stand for, as whole characters; malformed bytes pass as they are."""
        machine = Utf8Machine()
        for run in self.decode_runs(ids):
            yield machine.feed(run)[1]
        yield machine.close()[1]


class Utf8Machine:
    """UTF-8 in runs of bytes: a state tells which bytes may follow, and only whole characters leave.

    The states are those of the well-formed byte sequences: START, then one, two or three continuation bytes to come,
    with narrower ranges after E0, ED, F0 and F4. ``feed`` gives the well-formed text, in which each maximal malformed
    part is U+FFFD, and the bytes it took them from; the bytes of an unfinished character wait for the next run.
    """

    #: State: for each byte the next state, or None where it cannot follow.
    START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4 = range(8)
    MOVES: list[list[int | None]] = [[None] * 256 for _ in range(8)]
    #: Valid text in one step: runs of ASCII and of whole characters, which the machine need not walk byte by byte.
    WHOLE = re.compile(rb"(?:[\x00-\x7F]++|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})*+")
    BAD = "\ufffd".encode()

    def __init__(self):
        self.state, self.held = self.START, b""

    def feed(self, run: bytes) -> tuple[bytes, bytes]:
        """(well-formed UTF-8, the bytes it stands for) of what is complete with this run."""
        held = self.held
        data, at, size = held + run, len(held), len(held) + len(run)
        text, begin, last, state = [], 0, 0, self.state  # begin: of the character in hand; last: what text covers
        while at < size:
            if state == self.START:
                at = begin = self.WHOLE.match(data, at).end()
                if at == size:
                    break
            move = self.MOVES[state][data[at]]
            if move is None:
                # the bytes so far are one malformed part; the byte at hand begins anew, unless it was alone
                text += [data[last:begin], self.BAD]
                at += state == self.START
                begin = last = at
                state = self.START
                continue
            at += 1
            state = move
            if state == self.START:
                begin = at
        self.state, self.held = state, data[begin:]
        text.append(data[last:begin])
        return b"".join(text), data[:begin]

    def close(self) -> tuple[bytes, bytes]:
        """What an unfinished character leaves."""
        held, self.state, self.held = self.held, self.START, b""
        return (self.BAD if held else b""), held


def _utf8_moves() -> None:
    m, tail = Utf8Machine, range(0x80, 0xC0)
    rules = (
        (m.START, range(0x00, 0x80), m.START), (m.START, range(0xC2, 0xE0), m.ONE), (m.START, (0xE0,), m.AFTER_E0), (m.START, (*range(0xE1, 0xED), 0xEE, 0xEF), m.TWO),
        (m.START, (0xED,), m.AFTER_ED), (m.START, (0xF0,), m.AFTER_F0), (m.START, range(0xF1, 0xF4), m.THREE), (m.START, (0xF4,), m.AFTER_F4),
        (m.ONE, tail, m.START), (m.TWO, tail, m.ONE), (m.THREE, tail, m.TWO),
        (m.AFTER_E0, range(0xA0, 0xC0), m.ONE), (m.AFTER_ED, range(0x80, 0xA0), m.ONE), (m.AFTER_F0, range(0x90, 0xC0), m.TWO), (m.AFTER_F4, range(0x80, 0x90), m.TWO),
    )
    for state, those, after in rules:
        for b in those:
            m.MOVES[state][b] = after


_utf8_moves()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", as_ids: bool = True, round_trip: bool = False) -> DataFrame:
    """Adds n_tokens and ids (array of int), or with as_ids=False the digests of ids and decoded bytes.

    path: vocabulary file of token ranks, found on every executor. round_trip also adds decoded text.
    """
    made = ("n_tokens", "ids", "decoded") if as_ids else ("n_tokens", "ids_sha256", "decoded_sha256")
    made = made if round_trip or not as_ids else made[:2]
    rows, columns = aside(documents, text, made)
    names = carried(rows, "_text")
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = schema_with(rows, names, ", ".join(f"{c} {kinds[c]}" for c in made))

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            n_tokens, first, second = [], [], []
            for t in batch.column("_text"):
                ids = own.encode(t.as_py() or "")
                numbers = np.frombuffer(ids, "<u4")
                n_tokens.append(len(numbers))
                if as_ids:
                    first.append(numbers.astype(np.int32))
                    if round_trip:
                        second.append(own.decode_text(numbers.tolist()))
                else:
                    first.append(hashlib.sha256(ids).hexdigest())
                    digest = hashlib.sha256()
                    for part in own.decoded_bytes(numbers.tolist()):
                        digest.update(part)
                    second.append(digest.hexdigest())
            out = [batch.column(c) for c in names] + [pa.array(n_tokens, pa.int64()), pa.array(first, pa.list_(pa.int32()) if as_ids else pa.string())]
            if len(made) > 2:
                out.append(pa.array(second, pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema).select(*columns, *made)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, as_ids=False)

"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hex_sha256

# Entries a worker remembers before it starts afresh: bounds its memory.
MOST_WORDS = 300_000
MOST_PIECES = 80_000
MOST_STATES = 50_000
MOST_PAIRS = 300_000
# Characters up to which a piece is remembered.
LONG = 64
# Patterns of which no match goes on from another character into a space, and none looks back: what lies
# between a space after another character and the next such one is cut into pieces by itself.
BY_WORD = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
# Rows of which a worker holds the tokens at once.
ROWS = 256


def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file with their ids."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class Vocabulary:
    """Tokens by rank, and which pairs of them may stand side by side.

    A token longer than a byte comes from one merge of two others. A sequence of
    tokens is the encoding of its bytes exactly if every two neighbours are: no
    merge across their border ever comes before the merges that made them.
    """

    def __init__(self, path: str):
        self.ids = ranks(path)
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        # The tokens as a tree of bytes: next[node][byte] is a node, token[node] the
        # token that ends there or -1, depth[node] its bytes. Node 0 is the root.
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        self.depth = [0]
        for token, rank in self.ids.items():
            node = 0
            for byte in token:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.next[node][byte]
            self.token[node] = rank
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if rank not in self.halves:
            parts = [bytes([b]) for b in self.tokens[rank]]
            while len(parts) > 2:
                ranks = [self.ids.get(a + b, rank) for a, b in zip(parts, parts[1:])]
                least = min(ranks)
                if least >= rank:
                    raise ValueError(f"token {rank} does not come from merges of lower ranks")
                at = ranks.index(least)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[rank] = tuple(self.ids[p] for p in parts) if len(parts) == 2 else None
        return self.halves[rank]

    def fit(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        # Backward through the merges of both sides: `until` is the rank of the next
        # merge that takes one of the pieces at the border. A merge across it must
        # not come first. Of equal ranks the one further left comes first.
        until = float("inf")
        while True:
            across = self.ids.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < until:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                until, left = left, a[1]
            else:
                until, right = right + 1, b[0]


class State(dict):
    """A state of the transducer: what is growing, and the steps known so far.

    grown  places in the token tree of all that is growing, the longest first
    ends   the tokens that end here, longest first: id, length below zero, and what fits before it
    """

    __slots__ = ("grown", "ends", "owner")

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.owner.step(self, byte)
        return found


class Befores(dict):
    """Whether a token fits before another one, as far as that has been asked."""

    __slots__ = ("token", "owner")

    def __missing__(self, before: int) -> bool:
        self.owner.pairs += 1
        found = self[before] = before < 0 or self.owner.vocabulary.fit(before, self.token)
        return found


class Transducer:
    """Reads a piece byte by byte; each byte tells the last token of the encoding of
    all bytes so far, and the tokens before it are those of the bytes before it.

    While bytes come in, tokens grow from several starts at once. The state is the
    set of their places in the token tree, made deterministic when a piece first
    needs it. Of the tokens that end with a byte exactly one fits what comes before it;
    that is kept by byte. A token is emitted once all that still grows agrees on what
    comes before: what grows is never longer than the longest token.
    """

    # Bytes after which kept tokens are looked through for agreement.
    LOOK = 4096

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.length = {rank: len(token) for token, rank in vocabulary.ids.items()}
        self._afresh()

    def _afresh(self) -> None:
        self.states: dict[tuple[int, ...], State] = {}
        self.befores: dict[int, Befores] = {}
        self.pairs = 0
        self.begin = self._state((0,))

    def _state(self, grown: tuple[int, ...]) -> State:
        if grown not in self.states:
            state = self.states[grown] = State()
            state.grown, state.owner = grown, self
            tokens = [t for place in grown if (t := self.vocabulary.token[place]) >= 0]
            state.ends = [(t, -self.length[t], self._befores(t)) for t in tokens]
        return self.states[grown]

    def _befores(self, token: int) -> Befores:
        if token not in self.befores:
            new = self.befores[token] = Befores()
            new.token, new.owner = token, self
        return self.befores[token]

    def step(self, state: State, byte: int) -> State:
        tree = self.vocabulary.next
        places = [place for node in state.grown if (place := tree[node].get(byte)) is not None]
        return self._state((*places, 0))

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > MOST_STATES or self.pairs > MOST_PAIRS:
            self._afresh()
        # last[n] is the last token of the first n bytes; -1 fits before any other.
        state, last, out = self.begin, [-1], []
        for at in range(0, len(piece), self.LOOK):
            if at:
                self._settle(state, last, out)
            for byte in piece[at:at + self.LOOK]:
                state = state[byte]
                # What the token goes back from here: its length from the end of `last`.
                for token, back, befores in state.ends:
                    if befores[last[back]]:
                        break
                last.append(token)
        return out + self._back(last, len(last) - 1)

    def _settle(self, state: State, last: list[int], out: list[int]) -> int:
        """Emits the tokens that all growing starts agree on; returns their bytes."""
        ends = {len(last) - 1 - self.vocabulary.depth[place] for place in state.grown}
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(furthest - self.length[last[furthest]])
        settled = ends.pop()
        out += self._back(last, settled)
        del last[:settled]
        return settled

    def _back(self, last: list[int], end: int) -> list[int]:
        """The tokens of the first `end` bytes."""
        out = []
        while end > 0:
            token = last[end]
            out.append(token)
            end -= self.length[token]
        out.reverse()
        return out


class Memory(dict):
    """The encodings of pieces seen lately. When it is full, only those that are
    asked for again while it fills anew stay."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MOST_PIECES:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            found = tuple(self.transducer.encode(piece.encode()))
        if len(piece) <= LONG:
            self[piece] = found
        return found


class Words(dict):
    """The encodings of words seen lately, each with the space before it; None for what a space does not end."""

    MARKS = frozenset(".,;:!?")

    def __init__(self, pieces, memory: Memory):
        super().__init__()
        self.pieces, self.memory = pieces, memory
        self.older: dict[str, tuple[int, ...] | None] = {}

    def __missing__(self, word: str) -> tuple[int, ...] | None:
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word, ())
        if found == ():
            # Letters are one piece, and a mark after them another one.
            if word.isalpha():
                found = tuple(self.memory.transducer.encode((" " + word).encode()))
            elif word[-1:] in self.MARKS and word[:-1].isalpha():
                found = self[word[:-1]] + self.memory[word[-1]]
            else:
                found = None if not word or word[-1].isspace() else self.encode(" " + word)
        if len(word) <= LONG:
            self[word] = found
        return found

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.memory.__getitem__, self.pieces.findall(text))))


class Encoder:
    # A space after anything else. What `re` takes for white space is all that `regex` does, and four more.
    SPACE = re.compile(r"(?<=\S) ")

    def __init__(self, path: str, pattern: str):
        self.words = Words(regex.compile(pattern), Memory(Transducer(Vocabulary(path))))
        self.by_word = pattern in BY_WORD

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text, without special tokens."""
        first, *rest = text.split(" ") if self.by_word else [text]
        found = list(map(self.words.__getitem__, rest))
        # The last one ends with the text, not with a space.
        if not first or first[-1].isspace() or None in found:
            first, *rest = self.SPACE.split(text) if self.by_word else [text]
            found = [self.words.encode(" " + w) if not w or w[-1].isspace() else self.words[w] for w in rest]
        return np.fromiter(chain(self.words.encode(first), chain.from_iterable(found)), np.int32)


# Bytes that follow a first byte of UTF-8, by its value; 0 where none can.
FOLLOW = [0] * 192 + [1] * 32 + [2] * 16 + [3] * 8 + [0] * 8


class Utf8Stream:
    """Text from bytes that arrive in parts. Between parts the state is the bytes
    of a character that is not yet whole. Wrong bytes become U+FFFD."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, part: bytes) -> str:
        data = self.waiting + part
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            first = data[-back]
            if first >= 0xC0:
                if FOLLOW[first] >= back:
                    cut = len(data) - back
                break
            if first < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, path: str):
        self.tokens = {rank: token for token, rank in ranks(path).items()}

    def parts(self, ids: np.ndarray, step: int = 8192) -> Iterator[bytes]:
        for at in range(0, len(ids), step):
            yield b"".join(map(self.tokens.__getitem__, ids[at:at + step].tolist()))

    def decode(self, ids: np.ndarray) -> str:
        stream = Utf8Stream()
        return "".join([*map(stream.feed, self.parts(ids)), stream.close()])


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker; it is large and learns as it goes."""
    return Encoder(path, pattern)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The columns of `docs` and the token ids of the whole text, as array<int>.

    `vocabulary` is a rank file that every worker can read, `pattern` the expression
    that cuts a text into pieces; each piece is encoded on its own, without special
    tokens. Null counts as empty, which has no tokens. A column of the caller's of
    the new name is replaced. Rows do not depend on each other; an empty table stays
    empty. A worker holds the vocabulary, bounded memories, and a batch of rows.
    """
    return _coded(docs, ids, T.ArrayType(T.IntegerType()), lambda column: _encoded(column, vocabulary, pattern), text)


def decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """The columns of `docs` and the text that the token ids stand for.

    Ids are decoded in parts; bytes of a character that is not yet whole wait for
    the next part. Bytes that are no UTF-8 become U+FFFD. Null counts as no tokens;
    an id that is not in the vocabulary raises KeyError.
    """
    return _coded(docs, text, T.StringType(), lambda column: _decoded(column, vocabulary), ids)


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str,
    text: str = "text", ids: str = "token_ids", decoded: str = "decoded",
) -> DataFrame:
    """`encode`, then `decode` of its ids, in one pass through Python."""
    def both(column: pa.Array) -> pa.Array:
        tokens = _encoded(column, vocabulary, pattern)
        return pa.StructArray.from_arrays([tokens, _decoded(tokens, vocabulary)], ["ids", "text"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    made = "both"
    while made in docs.columns:
        made += "_"
    done = _coded(docs, made, kind, both, text)
    kept = [F.col(f"`{n}`") for n in docs.columns if n not in (ids, decoded)]
    return done.select(*kept, F.col(f"{made}.ids").alias(ids), F.col(f"{made}.text").alias(decoded))


def _coded(docs: DataFrame, name: str, kind: T.DataType, function, source: str) -> DataFrame:
    """The columns of `docs` and one more, made of the column `source` batch by batch."""
    at = docs.columns.index(source)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("made", kind)])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                made = function(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "made"])

    done = plain.mapInArrow(batches, schema)
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n != name]
    return done.select(*kept, F.col("made").alias(name))


def _encoded(texts: pa.Array, vocabulary: str, pattern: str) -> pa.ListArray:
    coder = encoder(vocabulary, pattern)
    found = [coder.encode(x.as_py() or "") for x in texts]
    ends = np.cumsum([0, *map(len, found)])
    values = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _decoded(ids: pa.ListArray, vocabulary: str) -> pa.StringArray:
    coder = decoder(vocabulary)
    none = np.empty(0, np.int32)
    return pa.array(
        [coder.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else none) for x in ids], pa.string())


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    done = round_trip(docs.select("doc_id", "text"), vocabulary, pattern)
    return done.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        hex_sha256(F.array_join(F.transform("token_ids", lambda i: i.cast("string")), " ")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"))

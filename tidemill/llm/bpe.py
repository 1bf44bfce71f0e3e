"""Byte-level BPE as a transducer, and the decoder of its tokens.

Two tokens may stand side by side in an encoding if encoding their bytes together gives these
two again, and a sequence of tokens is the encoding of its bytes if that holds for all its
neighbours. So each prefix of a word has one encoding, which its last token and the encoding
of a shorter prefix make up. The transducer reads bytes from left to right and keeps the last
tokens of the prefixes that a longer token could still start from. What all of them agree on
is final and is emitted; the rest waits for as many bytes as the longest token has, at most.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.llm.common import by_slices
from tidemill.llm.pretokens import splitter

#: States, verdicts on pairs of tokens and words a task remembers; each is made anew when there are more.
MAX_STATES = 50_000
MAX_FITS = 200_000
MEMO_WORDS = 150_000
MEMO_CHARS = 64
#: Times that a move is read before it gets a state.
PATIENCE = 64
#: Bytes read without making states before what is final is emitted.
LOOKAHEAD = 1024


def read_ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _State:
    """What is not emitted yet: the last token before it, its bytes, for each of their prefixes
    where the last token of its encoding begins and which it is, and the places a longer token
    may still start from, with their nodes."""

    __slots__ = ("emitted", "pending", "begins", "last", "live", "moves", "rest")

    def __init__(self, emitted, pending, begins, last, live):
        self.emitted, self.pending, self.begins, self.last, self.live = emitted, pending, begins, last, live
        self.moves, self.rest = {}, None


class Vocabulary:
    """What all transducers over the same tokens share: the tree of the tokens and their halves."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.children: dict[int, int] = {}  # by node and byte
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.children.get(key, 0)
                if not node:
                    node = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self._links()
        self.lefts, self.rights = self._halves()
        self.partial = {rank for rank, token in self.tokens.items() if not _whole(token)}

    def _links(self):
        """For each node its depth, the node of the longest proper suffix in the tree, and the longest
        token that ends there; for each token its length and the longest token that it ends in."""
        n = len(self.token_at)
        self.depth, self.fail, self.ends = [0] * n, [0] * n, [-1] * n
        self.lengths, self.shorter = [0] * (max(self.tokens) + 1), [-1] * (max(self.tokens) + 1)
        level = [(0, key & 255, child) for key, child in self.children.items() if key < 256]
        below = {}
        for key, child in self.children.items():
            below.setdefault(key >> 8, []).append((key & 255, child))
        while level:
            following = []
            for node, byte, child in level:
                self.depth[child] = self.depth[node] + 1
                link = node
                while link:
                    link = self.fail[link]
                    if found := self.children.get(link << 8 | byte):
                        self.fail[child] = found
                        break
                token, suffix = self.token_at[child], self.ends[self.fail[child]]
                if token >= 0:
                    self.lengths[token], self.shorter[token] = self.depth[child], suffix
                self.ends[child] = token if token >= 0 else suffix
                following += [(child, b, c) for b, c in below.get(child, ())]
            level = following

    def _halves(self):
        """For each token the two it was merged from; -1 for bytes."""
        left, right, ranks = [-1] * (max(self.tokens) + 1), [-1] * (max(self.tokens) + 1), self.ranks
        for token, word in self.tokens.items():
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                rank, i = min((ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    raise ValueError(f"token {token} cannot be merged from the ones before it")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                left[token], right[token] = ranks[parts[0]], ranks[parts[1]]
        return left, right


class Transducer:
    """Encodes words. States are determinised lazily: a move gets a state of its own when it was
    needed ``patience`` times; before, the rest of the word is read without making states."""

    def __init__(self, vocabulary: Vocabulary | dict[bytes, int], max_states: int = MAX_STATES, patience: int = PATIENCE):
        self.vocabulary = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary(vocabulary)
        self.max_states, self.patience = max_states, patience
        self.fits: dict[int, bool] = {}
        self.bytes = [bytes([b]) for b in range(256)]
        self._restart()

    def _restart(self):
        for state in getattr(self, "states", {}).values():
            state.moves.clear()  # states refer to each other
        self.states: dict[tuple[int, bytes], _State] = {}
        self.start = _State(-1, b"", (), (), ((0, 0),))

    def forget(self):
        """Drop what was remembered of the words so far."""
        self._restart()
        self.fits.clear()

    def encode(self, word: bytes) -> list[int]:
        out, state = [], self.start
        for at, byte in enumerate(word):
            move = state.moves.get(byte, 0)
            if type(move) is int:  # how often it was needed
                if move < self.patience:
                    state.moves[byte] = move + 1
                    return out + self._read(state, word, at)
                move = self._move(state, byte)
            if move[0]:
                out += move[0]
            state = move[1]
        if state.rest is None:
            state.rest = _path(state.begins, state.last, len(state.last))
        return out + state.rest

    def _read(self, state, word, at):
        """The tokens from ``state`` on for the bytes from ``at`` on."""
        words, fits = self.vocabulary, self.fits
        child_of, fail, ends, lengths, shorter = words.children.get, words.fail, words.ends, words.lengths, words.shorter
        out, emitted, begins, last, node = [], state.emitted, list(state.begins), list(state.last), state.live[0][1]
        for byte in word[at:]:
            child = child_of(node << 8 | byte)
            while not child:
                node = fail[node]
                child = child_of(node << 8 | byte)
            node, token, n = child, ends[child], len(last) + 1
            while True:  # the longest token that ends here and stays as it is beside the one before
                begin = n - lengths[token]
                pair = (last[begin - 1] if begin else emitted) << 32 | token
                fit = fits.get(pair)
                if self._fit(pair) if fit is None else fit:
                    break
                token = shorter[token]
            begins.append(begin)
            last.append(token)
            if n > LOOKAHEAD:
                live, at = [(n, 0)], node
                while at:
                    live.append((n - words.depth[at], at))
                    at = fail[at]
                if cut := _shared(begins, live):
                    out += _path(begins, last, cut)
                    emitted, begins, last = out[-1], [b - cut for b in begins[cut:]], last[cut:]
        return out + _path(begins, last, len(last))

    def _move(self, state, byte):
        if len(self.states) >= self.max_states:
            self._restart()
        child_of, token_at, fits = self.vocabulary.children.get, self.vocabulary.token_at, self.fits
        last, live, found = state.last, [], -1
        for place, node in state.live:
            child = child_of(node << 8 | byte)
            if child:
                live.append((place, child))
                if found < 0:
                    token = token_at[child]
                    if token >= 0:
                        pair = (last[place - 1] if place else state.emitted) << 32 | token
                        fit = fits.get(pair)
                        if self._fit(pair) if fit is None else fit:
                            begin, found = place, token
        begins, last = state.begins + (begin,), last + (found,)
        live.append((len(last), 0))
        cut = _shared(begins, live)
        pending = state.pending + self.bytes[byte]
        if cut:
            emit = _path(begins, last, cut)
            key = (emit[-1], pending[cut:])
        else:
            emit, key = None, (state.emitted, pending)
        after = self.states.get(key)
        if after is None:
            if cut:
                begins, last = tuple([b - cut for b in begins[cut:]]), last[cut:]
                live = [(place - cut, node) for place, node in live]
            after = self.states[key] = _State(*key, begins, last, tuple(live))
        state.moves[byte] = move = (emit, after)
        return move

    def _fit(self, pair):
        """Whether two tokens, given as ``left << 32 | right``, stay as they are side by side.

        Undoes their merges from the last one back: at each time the symbols at the border
        must not form a token that comes before the next merge of either.
        """
        if len(self.fits) >= MAX_FITS:
            self.fits.clear()
        self.fits[pair] = fit = pair < 0 or self._stay(pair >> 32, pair & 0xFFFFFFFF)
        return fit

    def _stay(self, left, right):
        words = self.vocabulary
        rank_of, tokens, before = words.ranks.get, words.tokens, 1 << 60
        while rank_of(tokens[left] + tokens[right], before) >= before:
            if left > right:  # of equal ranks, the merge further left comes first
                before, left = left, words.rights[left]
                if left < 0:
                    return True
            else:
                before, right = right + 1, words.lefts[right]
                if right < 0:
                    return True
        return False


def _shared(begins, live):
    """The longest prefix that every way to go on shares."""
    cut = live[0][0]
    if cut:
        for place, _ in live:
            while cut != place:
                if cut > place:
                    cut = begins[cut - 1]
                else:
                    place = begins[place - 1]
    return cut


def _whole(token):
    """Whether a token is whole characters."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _path(begins, last, end):
    out = []
    while end:
        out.append(last[end - 1])
        end = begins[end - 1]
    return out[::-1]


# Bytes that may lead a UTF-8 character, with the range of the byte after them.
_LEADS = (
    (0x00, 0x7F, 0, 0, 0),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)


class Utf8Machine:
    """Reads UTF-8 byte by byte; a state is (bytes still to come, lowest, highest next byte)."""

    START = (0, 0, 0)

    def step(self, state, byte):
        """The state after ``byte``; raises where no text can hold it."""
        more, low, high = state
        if more:
            if low <= byte <= high:
                return (more - 1, 0x80, 0xBF) if more > 1 else self.START
        else:
            for first, last, follow, low, high in _LEADS:
                if first <= byte <= last:
                    return (follow, low, high) if follow else self.START
        raise UnicodeDecodeError("utf-8", bytes([byte]), 0, 1, "not UTF-8 here")


class StreamDecoder:
    """Text from tokens, one at a time: ``feed`` returns the characters that are complete."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.machine, self.moves = tokens, Utf8Machine(), {}
        self.state, self.held = Utf8Machine.START, b""

    def move(self, state, token):
        """State after the token, remembered: there are few states and a fixed number of tokens."""
        key = (state, token)
        if key not in self.moves:
            after = state
            for byte in self.tokens[token]:
                after = self.machine.step(after, byte)
            self.moves[key] = after
        return self.moves[key]

    def feed(self, token: int) -> str:
        self.state = self.move(self.state, token)
        self.held += self.tokens[token]
        if self.state[0]:
            return ""
        done, self.held = self.held, b""
        return done.decode()

    def finish(self) -> str:
        """The rest; a character that was cut off becomes U+FFFD."""
        rest, self.held, self.state = self.held, b"", Utf8Machine.START
        return rest.decode(errors="replace")


class _Words(dict):
    """Words to their tokens as text, and the bytes they decode to; remembered for short words.

    When there are too many they become the former ones, from which those still in use are taken over.
    """

    def __init__(self, transducer, decode):
        self.transducer, self.decode, self.former = transducer, decode, {}

    def __missing__(self, word):
        entry = self.former.get(word)
        if entry is None:
            ids = self.transducer.encode(word.encode())
            entry = (" ".join(map(str, ids)), self.decode(ids))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.former = dict(self)
                self.clear()
            self[word] = entry
        return entry


_shown, _decoded = map(itemgetter, range(2))


def _numbers(shown: str) -> np.ndarray:
    return np.fromstring(shown, np.int32, sep=" ") if shown else np.empty(0, np.int32)


class Codec:
    """Encodes texts and decodes tokens; what it remembers of words goes with ``forget``."""

    def __init__(self, vocabulary: str | Vocabulary = "byte_bpe_50k.tiktoken"):
        vocabulary = vocabulary_of(vocabulary) if isinstance(vocabulary, str) else vocabulary
        self.tokens = vocabulary.tokens
        self.transducer = Transducer(vocabulary)
        self.split = splitter(public_tokenizers.PATTERN)
        self.decoder, self.partial = StreamDecoder(self.tokens), vocabulary.partial
        self.words = _Words(self.transducer, self.decode)

    def forget(self) -> None:
        self.words.clear()
        self.words.former.clear()
        self.transducer.forget()
        self.decoder.moves.clear()

    def encode(self, text: str) -> list[int]:
        """Tokens of a text, each match of the public pattern by itself."""
        return _numbers(self.round_trip(text)[0]).tolist()

    def round_trip(self, text: str) -> tuple[str, bytes]:
        """Tokens of a text, their numbers joined by spaces, and what they decode to.

        A word is whole characters, so its tokens are decoded on their own, once for all places
        it stands at.
        """
        found = list(map(self.words.__getitem__, self.split(text)))
        return " ".join(map(_shown, found)), b"".join(map(_decoded, found))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the characters that the tokens make up.

        Where each token holds whole characters the machine never leaves its first state;
        otherwise it follows the tokens one by one.
        """
        tokens, moves, move = self.tokens, self.decoder.moves, self.decoder.move
        if self.partial.isdisjoint(ids):
            return b"".join(map(tokens.__getitem__, ids))
        state, out, held = Utf8Machine.START, [], []
        for token in ids:
            state = moves.get((state, token)) or move(state, token)
            held.append(tokens[token])
            if not state[0]:
                out += held
                held.clear()
        return b"".join(out) + b"".join(held).decode(errors="replace").encode()


@functools.cache
def vocabulary_of(name: str) -> Vocabulary:
    """The tables of a vocabulary, which do not grow; a worker process keeps them for its tasks."""
    return Vocabulary(read_ranks(name))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _round_trips(batches, vocabulary, at):
    """Slices of batches with the texts at column ``at``, each with the round trips of its texts.

    The words of a task are forgotten at its end, also when it fails.
    """
    gc.set_threshold(200_000, 50, 100)  # as in map_rows
    codec = Codec(vocabulary)
    try:
        for batch in by_slices(batches):
            yield batch, (codec.round_trip(text or "") for text in batch.column(at).to_pylist())
    finally:
        codec.forget()


def bpe_round_trip(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    id_col: str = "doc_id",
    text_col: str = "text",
    with_tokens: bool = False,
) -> DataFrame:
    """One row per document: id, ``n_tokens``, digests of the tokens and of the decoded bytes.

    ``with_tokens`` adds the tokens themselves as ``token_ids``. A map over the documents
    without shuffle. Null text is empty: no tokens, digests of the empty string. Null ids and
    repeated rows pass through; other columns are not read; no text is cut.
    """
    if with_tokens:
        named = docs.select(F.col(id_col), F.col(text_col).alias(f"{id_col}_text"))
        return add_tokens(named, vocabulary, f"{id_col}_text").select(id_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch, trips in _round_trips(batches, vocabulary, 1):
            rows = [(shown.count(" ") + bool(shown), _sha(shown.encode()), _sha(decoded)) for shown, decoded in trips]
            columns = [pa.array(list(x), f.type) for x, f in zip(zip(*rows), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def add_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, ``token_ids`` and what ``bpe_round_trip`` gives beside them.

    A map; columns of ``docs`` with the names of the new ones are replaced. Null text is empty
    and has no tokens; repeated rows and nulls elsewhere pass through; no text is cut, and an
    empty table gives an empty one.
    """
    new = StructType.fromDDL("token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    old = docs.select(*[f for f in docs.columns if f not in new.names])
    at, kinds = old.columns.index(text_col), [f.type for f in to_arrow_schema(new)]

    def run(batches):
        for batch, trips in _round_trips(batches, vocabulary, at):
            tokens, prints, decoded = [], [], []
            for shown, data in trips:
                tokens.append(pa.array(_numbers(shown)))
                prints.append(_sha(shown.encode()))
                decoded.append(_sha(data))
            ends = np.cumsum([0, *map(len, tokens)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(tokens)).cast(kinds[0])
            columns = [ids, *(pa.array(x, k) for x, k in zip((np.diff(ends), prints, decoded), kinds[1:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new.names])

    return old.mapInArrow(run, StructType([*old.schema, *new]))

"""Counts and tokens against the public libraries, the decoder against whole texts."""

import random

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from tidemill.llm.bpe import Codec, StreamDecoder, Transducer, Utf8Machine, bpe_round_trip, read_ranks
from tidemill.llm.token_counts import PairHeap, text_counter, token_counts

SPECIAL = "<|endoftext|>"
ODD = ["", " ", "\n\n \n", "a" * 5000, " " * 700, "=" * 900, "ab" * 3000, f"x{SPECIAL}y{SPECIAL}{SPECIAL}", "it's we'LL I'd 'tis",
       "naïve Ünïcode ÿ× ÷", "a\x1c\x1db \x85\xa0", "٣²½ 漢字かな", "👩‍👩‍👧 é", "﻿​"]


def texts(n=1500):
    rng = random.Random(7)
    letters = list("aabethe  \n\t'sd_-129éßñ") + ["日", "🎉", "\x85", SPECIAL, "ing", "tion"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return Codec()


def test_counts_equal_the_library():
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]
    assert list(map(text_counter("byte_bpe_50k.json"), texts())) == want


def test_merging_by_heap_is_merging_by_lowest_rank():
    heap = PairHeap([(b"b", b"c"), (b"a", b"b"), (b"bc", b"bc"), (b"a", b"a")])
    assert [heap.count(w) for w in (b"", b"a", b"abc", b"bcbc", b"aaa", b"abbcbc")] == [0, 1, 2, 1, 2, 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_tokens_equal_the_library_and_decode(name):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(name), special_tokens={})
    own = Codec(name)
    for text in texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_the_transducer_emits_after_bounded_lookahead_and_survives_restarts():
    small = Transducer(read_ranks("byte_bpe_50k.tiktoken"), max_states=50)
    large = Transducer(read_ranks("byte_bpe_50k.tiktoken"))
    word = (" the" * 200).encode()
    assert small.encode(word) == large.encode(word)
    longest = max(map(len, large.vocabulary.tokens.values()))
    assert all(len(s.pending) <= 2 * longest for s in large.states.values())


def test_decoding_a_stream_holds_back_unfinished_characters(codec):
    decoder = StreamDecoder(codec.tokens)
    text = "日本 🎉 é"
    parts = [decoder.feed(token) for token in codec.encode(text)]
    assert "".join(parts) == text and "" in parts and decoder.finish() == ""
    first = codec.transducer.vocabulary.ranks["🎉".encode()[:1]]
    assert decoder.feed(first) == "" and decoder.finish() == "�"


def test_the_machine_takes_what_utf8_allows():
    def machine(data):
        state = Utf8Machine.START
        try:
            for byte in data:
                state = Utf8Machine().step(state, byte)
        except UnicodeDecodeError:
            return False
        return state == Utf8Machine.START

    def python(data):
        try:
            data.decode()
            return True
        except UnicodeDecodeError:
            return False

    rng = random.Random(3)
    edges = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5, 0xFF]
    for _ in range(20_000):
        data = bytes(rng.choice(edges) for _ in range(rng.randint(1, 4)))
        assert machine(data) == python(data)


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, f"a {SPECIAL}", 7), (3, "x" * 300_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint")
    counts = token_counts(docs).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counts)[:4] == [(-1, 0, 0), (1, 0, 0), (1, 0, 0), (2, 15, 3)]
    assert [r.over_limit for r in counts if r.doc_id == 3] == [True]
    trips = bpe_round_trip(docs, with_tokens=True).collect()
    assert len(trips) == 5 and all(len(r.token_ids) == r.n_tokens for r in trips)
    assert token_counts(docs.limit(0)).count() == bpe_round_trip(docs.limit(0)).count() == 0


def test_moves_get_states_only_where_they_are_busy():
    ranks = read_ranks("byte_bpe_50k.tiktoken")
    lazy, eager = Transducer(ranks, patience=8), Transducer(ranks, patience=1)
    words = [f" stat{i}e{i * 7919 % 1000}x".encode() for i in range(30)]
    assert [lazy.encode(w) for w in words] == [eager.encode(w) for w in words]
    assert 0 < len(lazy.states) < len(eager.states)
    assert len(Codec().words[" state"]) == 2
    word = (" the" * 200).encode()
    assert eager.encode(word) == eager.encode(word) == lazy.encode(word)
    longest = max(map(len, eager.vocabulary.tokens.values()))
    assert all(len(s.pending) <= 2 * longest for s in eager.states.values())

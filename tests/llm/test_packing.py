import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annalist.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PEER = Tokenizer.from_file(PATH)
PEER.encode_special_tokens = True


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
def test_plan_uses_every_piece_once(counts):
    used = defaultdict(int)
    for often, pattern in packing.plan_packs(counts, 64):
        assert often > 0 and sum(pattern) <= 64
        for length in pattern:
            used[length] += often
    assert used == counts


def test_shortest_pack_takes_the_next_length():
    assert sorted(packing.plan_packs({7: 1, 6: 1, 3: 2, 1: 1}, 10)) == [(1, (6, 3, 1)), (1, (7, 3))]


@settings(deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]))))
def test_ids_by_runs_are_those_of_whole_texts(texts):
    words = packing.WordIds(PEER.to_str())
    for text, ids in zip(texts, words.of_texts(texts, 1)):
        assert ids.tolist() == [*PEER.encode(text, add_special_tokens=False).ids, 1]


def test_a_worker_keeps_few_words():
    words = packing.WordIds(PEER.to_str())
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    for start in range(0, 600_000, 20_000):
        number = np.arange(start, start + 20_000)
        new = ["".join(x) for x in letters[number[:, None] // 26 ** np.arange(5) % 26]]
        words.of_texts([" ".join(new), "w" * 100 + "."], 1)
        assert len(words.known) <= 450_000
    assert all(len(k) <= packing.CACHE_LENGTH for k in words.known if k not in words.special)


def test_ids_stay_equal_when_the_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    words = packing.WordIds(PEER.to_str())
    texts = ["one, two three.", "two four five 5", "one six, seven", "", "eight one. nine", "Two THREE three. " + "long" * 20 + "!"]
    for text in texts * 3:
        assert words.of_texts([text], 1)[0].tolist() == [*PEER.encode(text, add_special_tokens=False).ids, 1]


def check(docs, scratch, size, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(np.array([*PEER.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, scratch, PATH, size=size).collect():
        match = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert match
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r.length)
    assert {k: sum(v) for k, v in documents.items()} == {k: sum(map(len, v)) for k, v in ids.items()}
    assert sorted(sequences) == list(range(len(sequences)))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return [sum(n for _, n in v) for v in sequences.values()]


def test_edge_cases(documents, nothing, scratch, monkeypatch):
    check(documents, scratch, 64, monkeypatch)
    assert check(nothing, scratch, 64, monkeypatch) == []


def test_little_padding(spark, sf_dir, scratch, monkeypatch):
    fill = check(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch, 2048, monkeypatch)
    assert sum(2048 - x for x in fill if x & (x - 1)) < 0.03 * sum(fill)


def test_pieces_hold_their_ids(documents):
    for r in packing.pieces(documents, PATH, size=64, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_special_tokens_in_texts():
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "foo<|endoftext|>bar.", "<|ENDOFTEXT|> <|EndOfText|>x", "<|startoftext|><|endoftext|>", "<|endoftext|", "é<|endoftext|>\u0301", "<<|startoftext|>'s", "none"]
    words = packing.WordIds(plain.to_str())
    for _ in range(2):
        for text, ids in zip(texts, words.of_texts(texts, 1)):
            assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as file:
    CODEC = bpe.Codec(file.read())
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def same(texts):
    for text, ids in zip(texts, CODEC.encode(texts)):
        assert ids.tolist() == PEER.encode_ordinary(text), text
        assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=4))
def test_any_text(texts):
    same(texts)


def test_contractions_and_spaces():
    chance = random.Random(1)
    letters = "ab st rvemld''''  \n\t1½²é中!?. 　́😀LLRE\x1c\x85"
    same(["".join(chance.choice(letters) for _ in range(chance.randint(0, 14))) for _ in range(5000)])


def test_every_code_point():
    same([f"a{chr(c)}{chr(c)}1 {chr(c)} b" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000])


def test_long_slices():
    chance = random.Random(2)
    same(["a" * 5000, "".join(chance.choice("abcdefgh") for _ in range(5000)), "ab" * 999])


def test_parts_of_long_texts(monkeypatch):
    text = "It's a text   with 12 numbers, we'll see. " * 30 + " " * 50 + "\n"
    monkeypatch.setattr(bpe, "PART", 77)
    monkeypatch.setattr(bpe, "DECODED", 10)
    same([text, "", "b", text[5:]])


def test_offsets():
    (ids,) = CODEC.encode(["naïve cafés"])
    offsets = CODEC.offsets(ids)
    assert [CODEC.decode(np.array([i])) for i in ids] == ["naïve cafés".encode()[a:b] for a, b in zip(offsets, offsets[1:])]


def test_operator(documents):
    rows = bpe.encode(documents, PATH, keys=("doc_id", "source")).collect()
    texts = documents.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(t.doc_id), PEER.encode_ordinary(t.text or "")) for t in texts)
    assert all(len(r.offsets) == len(r.ids) + 1 for r in rows)
    decoded = bpe.decode(bpe.encode(documents, PATH), PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in decoded) == sorted((str(t.doc_id), (t.text or "").encode()) for t in texts)


def test_digests(documents, nothing):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(documents, PATH).collect()}
    for row in documents.select("doc_id", "text").collect():
        text = row.text or ""
        ids = np.array(PEER.encode_ordinary(text), "<u4")
        assert (row.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in found
    assert bpe.round_trip_digests(nothing, PATH).count() == 0


def test_ranks_are_those_of_the_file():
    with open(PATH, "rb") as file:
        assert CODEC.ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}

import json
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens, words


def plain_words(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", lowered)


def plain_shingles(text, width=5):
    found = plain_words(text)
    if not found:
        return set()
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))}


texts = st.lists(st.one_of(st.none(), st.text(alphabet="abC É\n\t\u00a0.é", max_size=60)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_shingles_are_those_of_a_plain_scan(rows):
    array = pa.array(rows, pa.string())
    named = {}
    for lo, hi, hashed, bounds in words.words(array):
        for i in range(lo, hi):
            own = plain_words(rows[i])
            got = hashed[bounds[i - lo] : bounds[i - lo + 1]].tolist()
            assert len(got) == len(own)
            for word, value in zip(own, got, strict=True):
                assert named.setdefault(word, value) == value
    assert len(set(named.values())) == len(named)
    sets = list(words.shingle_sets(array))
    assert [len(s) for s in sets] == [len(plain_shingles(t)) for t in rows]
    for a in range(len(rows)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain_shingles(rows[a]) & plain_shingles(rows[b]))


def test_slices_and_sliced_arrays():
    rows = ["a b c d e f " * 40_000, None, "x y", "", "a b c d e f"]
    array = pa.array(["before", *rows, "after"], pa.string()).slice(1, 5)
    assert [len(s) for s in words.shingle_sets(array)] == [6, 0, 1, 0, 2]
    assert list(words.shingle_sets(pa.array([], pa.string()))) == []


def test_a_word_beyond_the_long_limit():
    a, b = "x" * 5000, "x" * 4999 + "y"
    got = [h.tolist() for _, _, h, _ in words.words(pa.array([a, b, a.upper()]))][0]
    assert got[0] == got[2] != got[1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_tokenizer(name):
    encoder = tokens.encoder(tokens.vocabulary(name))

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text(alphabet="abzA Z  \n\t\r.,;:!?'0éÀ×÷ñ\u00a0\u2003\u0301あ\x0b-sl", max_size=50)), min_size=1, max_size=8))
    def run(rows):
        for text, ids in zip(rows, encoder.rows(pa.array(rows, pa.string()), 7), strict=True):
            assert ids.tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 7]

    run()


def test_the_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    encoder = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    rows = [f"word{i} and some more" for i in range(20)]
    for _ in range(3):
        got = [ids.tolist() for ids in encoder.rows(pa.array(rows), 0)]
        assert got == [[*encoder.tokenizer.encode(t).ids, 0] for t in rows]


def test_other_settings_are_encoded_whole(tmp_path):
    with open(tokens.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        settings_ = json.load(file)
    settings_["pre_tokenizer"]["use_regex"] = False  # merges may then cross white space
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings_))
    encode = tokens.Encoder(str(path))
    assert not encode.cuttable and all(tokens.encoder(tokens.vocabulary(n)).cuttable for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    rows = ["one two three", None, "", "The cat.  The cat!\nthe CAT"]
    got = [ids.tolist() for ids in encode.rows(pa.array(rows), 0)]
    assert got == [[*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in rows]


def test_a_part_that_shares_a_hash_with_another_is_not_taken_for_it(monkeypatch):
    real = words.prefix_sums
    # every byte counts alike in the first hash, so parts of one length collide
    monkeypatch.setattr(words, "prefix_sums", lambda data, values=words.RAW: real(data, np.full(256, 7, np.uint64) if values is words.RAW else values))
    encode = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    rows = ["the cat sat on the mat", "dog", "one two three", "cat the"]
    got = [ids.tolist() for ids in encode.rows(pa.array(rows), 0)]
    assert got == [[*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in rows]

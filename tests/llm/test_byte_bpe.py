"""Byte-level BPE by rank file against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from geoloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(PATH), special_tokens={})


def want(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()


def texts():
    rng = random.Random(1)
    alphabet = "abcdefgh 'sté日\n\t  0123!?-_🙂ßЖ　\x1cعا"
    odd = [None, "", "a", "  ", "\n\n x", "'s it's", "é" * 50, "日本語のテキスト", "x" * 3000, "ab" * 2500, "a \x1c b\x85c", "<|endoftext|>", "<41><42>"]
    short = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    return odd + short + ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 300))) for _ in range(60)]


def test_reports_equal_the_library(spark):
    rows = list(enumerate(texts()))
    got = byte_bpe.byte_report(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {k: want(t) for k, t in rows}


def test_columns_stay_and_ids_come_back_as_bytes(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_ROWS", 2)
    rows = [("one two", 1, "w", "x"), (None, 2, "w", "y"), ("one two", None, None, "z")]
    docs = spark.createDataFrame(rows, "text string, ids int, words string, `_places` string")
    got = byte_bpe.decode_ids(byte_bpe.encode_texts(docs.drop("ids"), PATH), PATH)
    assert got.columns == ["text", "words", "_places", "ids", "decoded"]
    assert sorted((r._places, r.ids, bytes(r.decoded)) for r in got.collect()) == sorted(
        (r[3], LIBRARY.encode_ordinary(r[0] or ""), (r[0] or "").encode()) for r in rows
    )
    ids = spark.createDataFrame([(None,), ([],), ([50_000, None, 10**6, 5],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in byte_bpe.decode_ids(ids, PATH).collect()] == [None, b"", LIBRARY.decode_bytes([50_000, 5])]
    assert byte_bpe.byte_report(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_heap_for_very_long_words_and_files_that_are_no_merge_order():
    ranks = byte_bpe.rank_table(PATH)
    rng = random.Random(2)
    for word in ("ab" * 3000, "a" * 5001, "".join(rng.choice("abcdeilnorst") for _ in range(9000))):
        assert byte_bpe.heap_word(ranks, word.encode()) == LIBRARY.encode_ordinary(word)
    with pytest.raises(ValueError):
        byte_bpe.merges({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_a_slice_holds_the_first_bytes_of_places_once(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 1000)
    ranks = byte_bpe.rank_table(PATH)
    rng = random.Random(3)
    parts = ["tion", "heit", "é", "ment", "日", "\x00", " ", "a", "\n"]
    rows = [(1, "".join(rng.choice(parts) for _ in range(4000)) + " " + "x" * 3000), (2, "b")]
    [row] = byte_bpe._worded(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "text", ranks, ["doc_id"]).collect()
    heads, places = [bytes(h) for h in row.heads], 0
    assert len(set(heads)) == len(heads)
    for w in row.words:
        word = bytes(w.w) if w.ids is None else b""
        assert [heads[k] for k in w.heads] == [word[i : i + byte_bpe.HEAD] for i in range(len(word))]
        places += len(word)
    assert len(heads) * 20 < places
    known = byte_bpe.heads(ranks)
    for head in heads:
        entry = known.get(head, {"found": [], "longer": None})
        if len(head) == byte_bpe.HEAD and head in known:
            assert entry["found"] == [ranks[head[:n]] for n in range(2, byte_bpe.HEAD + 1) if head[:n] in ranks]
            assert (entry["longer"] or []) == sorted({len(t) for t in ranks if len(t) > byte_bpe.HEAD and t.startswith(head)})


def test_bytes_that_are_no_token_and_ranks_without_a_character(spark, tmp_path):
    file = tmp_path / "ranks"
    small = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b"ababab": 4, b"\x00": 5, b"a\x00": 6}
    file.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in small.items()))
    docs = spark.createDataFrame([(1, "abababab"), (2, "a"), (3, "c"), (4, "bca"), (5, "ba\x00")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encode_texts(docs, str(file)).collect()}
    assert got == {1: [3, 3], 2: [0], 3: [None], 4: [1, None, 0], 5: [1, 0, 5]}
    with pytest.raises(ValueError):
        byte_bpe.merge_lists({b"a": 0, b"b": 1, b"ab": 1 << 21})

"""The rank queue's encoding against the library, decoding as exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tallyrack.llm import byte_pairs
from tallyrack.llm.common import file_bytes, tokenizer_path

ODD = [
    None, "", " ", "\n\n x\n", "  a  b ", "日本語テキスト🤗̀e▁", "<|endoftext|>hi it's we'LL", "a" * 3000, "\x00ab\x1c\x1d\x85​", "é à ü ß Ω ſ K",
    " 　x", "١٢٣ ½ Ⅷ x²", "lorem ipsum " * 3000, "ab" * 40_000, " " * 5000 + "x", "don'T '' !'s", "ٱ\U0001e900\U000313a5 \U0001fae0",
]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_pairs.read_ranks(file_bytes(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    cuts = [byte_pairs.cutting_pattern(public_tokenizers.PATTERN, points) for points in (0x110000, 0x80)]
    return byte_pairs.BytePairs(file_bytes(tokenizer_path("byte_bpe_multi_50k.tiktoken")), *cuts, cache_words=50)


def test_digests_equal_the_library(spark, library):
    rows = [(i, t, "x", i, 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", 3, 1), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string, n_tokens int, `odd.name` int").repartition(3)
    got = byte_pairs.encoding_digests(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 3 for r in got) == 2
    for r in got:
        t = "no id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert byte_pairs.encoding_digests(df.limit(0)).count() == 0


def test_ids_and_back(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    full = byte_pairs.encode_documents(df)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_pairs.decode_ids(full).collect()}
    for r in full.collect():
        t = ODD[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(t) and r["decoded"] == t and back[r["doc_id"]] == t.encode()
    parts = spark.createDataFrame([(0, None), (1, []), (2, [library.encode_ordinary("日")[0]])], "doc_id bigint, ids array<bigint>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_pairs.decode_ids(parts).collect()}
    assert got[0] == got[1] == b"" and got[2] == library.decode_single_token_bytes(library.encode_ordinary("日")[0])


def test_every_code_point_is_cut_as_the_library_cuts(pairs, library):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for a in range(0, len(points), 4096):
        some = points[a : a + 4096]
        text = "".join(f"a{c}1{c} {c}" for c in some)
        assert pairs.encode(text).tolist() == library.encode_ordinary(text)


def test_random_words(pairs, library):
    at = random.Random(5)
    for _ in range(400):
        alphabet = at.choice(["ab", "abcde", "aehint", "the ing'", "日本é", "\n\t  x1"])
        text = "".join(at.choice(alphabet) for _ in range(at.randint(1, 800)))
        assert pairs.encode(text).tolist() == library.encode_ordinary(text)


def test_queue_is_empty_after_each_word(pairs):
    pairs.merge(b"abcdefgh" * 200)
    assert not any(pairs.queue.words) and not any(pairs.queue.buckets)


def test_equal_ranks_merge_from_the_left():
    """A vocabulary in which a longer token has a lower rank than its parts, and runs of one byte."""
    import base64

    import tiktoken

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"aa", b"aaaa", b"ab", b"aaa", b"cab"]
    blob = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    own = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=byte_pairs.read_ranks(blob), special_tokens={})
    made = byte_pairs.BytePairs(blob, *[byte_pairs.cutting_pattern(r"\p{L}+", p) for p in (0x110000, 0x80)])
    at = random.Random(1)
    for _ in range(500):
        word = "".join(at.choice("aabc") for _ in range(at.randint(1, 40)))
        assert made.encode(word).tolist() == own.encode_ordinary(word)


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        byte_pairs.BytePairs(b"YQ== 0", "a", "a")


def test_a_task_takes_few_steps_of_python_for_new_words(pairs, monkeypatch):
    """Lines of the module that a task runs for texts of words that were not met before: fewer than
    three a byte (1.4; 34.8 when each word was merged by itself)."""
    import sys
    from types import SimpleNamespace

    at = random.Random(7)
    texts = [" ".join("".join(at.choice("aehinorst") for _ in range(at.randint(5, 12))) for _ in range(100)) for _ in range(300)]
    monkeypatch.setattr(byte_pairs, "map_rows", lambda df, make, *more: make)
    work, lines = byte_pairs.encoding_digests(SimpleNamespace(dtypes=[("doc_id", "bigint")]))(), 0

    def line(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return line

    held = sys.gettrace()
    sys.settrace(lambda frame, event, arg: line if frame.f_code.co_filename == byte_pairs.__file__ else None)
    try:
        got = work([list(range(300)), texts])
    finally:
        sys.settrace(held)
    assert got["ids_sha256"] == [hashlib.sha256(pairs.encode(t).tobytes()).hexdigest() for t in texts]
    assert lines < 3 * sum(map(len, texts))


def test_words_merged_together_equal_each_alone(pairs, library):
    at = random.Random(11)
    draw = lambda: "".join(at.choice(at.choice(["ab", "aehint", "the ing'", "日本é", "\n\t  x1", "\0z"])) for _ in range(at.randint(1, 48)))
    words = [draw().encode() for _ in range(3000)] + [b" the", b"a", b"a" * 192, b"ab" * 90]
    assert pairs.merge_many(words) == [np.array(pairs.merge(w), "<u4").tobytes() for w in words]
    assert pairs.merge_many([]) == [] and pairs.merge_many([b"zq"]) == [np.array(pairs.merge(b"zq"), "<u4").tobytes()]
    texts = [t or "" for t in ODD] + [" ".join(draw() for _ in range(60)) for _ in range(60)]
    for at_once, least in ((1 << 20, 1), (70, 1), (70, 1 << 30), (1, 1)):
        assert [i.tolist() for i in pairs.encode_many(texts, at_once, least)] == list(map(library.encode_ordinary, texts))
    assert list(pairs.encode_many([])) == [] and not pairs.ready


def test_words_merged_together_where_longer_tokens_rank_lower():
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"aa", b"aaaa", b"ab", b"aaa", b"cab"]
    # ranks far apart, so that several buckets are in use
    blob = b"\n".join(base64.b64encode(t) + b" %d" % (i if i < 256 else 256 + (i - 256) * 150) for i, t in enumerate(tokens))
    made, at = byte_pairs.BytePairs(blob, "a", "a"), random.Random(2)
    words = [bytes(at.choice(b"aabc") for _ in range(at.randint(1, 40))) for _ in range(3000)]
    assert made.merge_many(words) == [np.array(made.merge(w), "<u4").tobytes() for w in words]
    for lacking in (-1, 300, 1 << 40):
        with pytest.raises(KeyError):
            made.decode(np.array([97, lacking]))


def test_texts_of_the_first_plane_are_cut_as_the_library_cuts(library):
    cuts = [byte_pairs.cutting_pattern(public_tokenizers.PATTERN, points) for points in (0x110000, 0x80, 0x10000)]
    made = byte_pairs.BytePairs(file_bytes(tokenizer_path("byte_bpe_multi_50k.tiktoken")), "never", cuts[1], cut_plane=cuts[2])
    points = [chr(p) for p in range(0x80, 0x10000) if not 0xD800 <= p < 0xE000]
    for a in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c} {c}" for c in points[a : a + 4096])
        assert made.encode(text).tolist() == library.encode_ordinary(text)
    made = byte_pairs.BytePairs(file_bytes(tokenizer_path("byte_bpe_multi_50k.tiktoken")), cuts[0], cuts[1], cut_plane="never")
    text = "é\U00010000 \U0001e900\U000313a5 x"
    assert made.encode(text).tolist() == library.encode_ordinary(text)

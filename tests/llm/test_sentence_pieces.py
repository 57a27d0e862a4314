"""SentencePiece: ids, spans and texts against the library; normalisation by compiled maps."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto

from flowlens.llm.sentence_pieces import (
    CharacterMap, PieceEncoder, PieceModel, decode, encode, normalize, round_trip_digests,
)

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ENCODER = PieceEncoder(PieceModel(PATH))
TEXTS = [None, "", " ", "Hello  world\n\n x ", "a▁ b▁▁c", "\t tabs\r\n", "日本語 テキスト é", "<s> </s> <unk> <0x0A>",
         "😀 \x00 \x7f", "x" * 5000, "one two " * 3000, "▁", " ▁ ", "fi ﬁ ½ Ａ"]


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,.\n▁é日😀 \t1<s>The"), max_size=30), max_size=5))
def test_ids_and_texts_equal_the_library(texts):
    array = pa.array(texts, pa.string())
    ids, begins, ends, counts = ENCODER.encode(array)
    expected = [LIBRARY.encode(t) for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]
    sizes, of_ids, of_text = ENCODER.digests(array)
    assert sizes.tolist() == counts.tolist()
    assert of_ids == [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in expected]
    assert of_text == [hashlib.sha256(LIBRARY.decode(e).encode()).hexdigest() for e in expected]


@settings(deadline=None)
@given(st.text(st.sampled_from("ab ,.\n▁é日😀 \tThe"), max_size=30))
def test_spans_equal_the_library(text):
    _, begins, ends, _ = ENCODER.encode(pa.array([text]))
    expected = [(p.begin, p.end) for p in LIBRARY.encode(text, return_type='proto').pieces]
    assert list(zip(begins.tolist(), ends.tolist())) == expected


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "null id", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    expected = sorted(repr((d, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or "")))) for d, t, _ in rows)
    got = decode(encode(docs, PATH), PATH).collect()
    assert sorted(repr((r.doc_id, list(r.ids), r.decoded)) for r in got) == expected
    texts = {d: (t or "").encode() for d, t, _ in rows}
    for r in got:
        assert b"".join(texts[r.doc_id][a:b] for a, b in zip(r.begins, r.ends)) == texts[r.doc_id]
    digests = round_trip_digests(docs, PATH).collect()
    assert sorted(repr((r.doc_id, r.n_tokens, r.covered_bytes)) for r in digests) == sorted(
        repr((d, len(LIBRARY.encode(t or "")), len((t or "").encode()))) for d, t, _ in rows)
    assert encode(docs.limit(0), PATH).count() == 0
    assert round_trip_digests(docs.limit(0), PATH).count() == 0


def double_array(rules):
    """A small compiled map by the format's rules: every node gets a free block of 256 units."""
    trie = {}
    for key in rules:
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = rules[key]
    pool, units, used = b"", {0: 0}, [1]

    def place(node, unit):
        nonlocal pool
        block = used[0] * 256
        used[0] += 1
        offset = unit ^ block
        units[unit] |= (offset << 10) if offset < 1 << 21 else ((offset >> 8) << 10) | 512
        if None in node:
            units[unit] |= 256
            units[block] = len(pool) | 1 << 31
            pool += node[None].encode() + b"\0"
        for byte in [b for b in node if b is not None]:
            units[block ^ byte] = byte
        for byte in [b for b in node if b is not None]:
            place(node[byte], block ^ byte)

    place(trie, 0)
    body = np.zeros((used[0] + 1) * 256, "<u4")
    for at, value in units.items():
        body[at] = value & 0xFFFFFFFF
    return len(body.tobytes()).to_bytes(4, "little") + body.tobytes() + pool


RULES = {"ﬁ": "fi", "½": "1⁄2", "Ａ": "A", "\t": " ", "é": "é", "abc": "X", "ab": "Y", "\x01": ""}


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_compiled_maps_normalise_like_the_library(tmp_path, trim, prefix):
    model = proto.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.normalizer_spec.precompiled_charsmap = double_array(RULES)
    model.normalizer_spec.remove_extra_whitespaces = trim
    model.normalizer_spec.add_dummy_prefix = prefix
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    library, mapped = SentencePieceProcessor(model_file=str(path)), PieceModel(str(path))
    texts = ["ﬁne ½ Ａbc", "  lead and  double \t tail  ", "été", "ab abc abcd", "\x01a\x01", "日 x", "", " "]
    encoder = PieceEncoder(mapped)
    for text in texts:
        out, align = normalize(mapped, text, True)
        assert out.decode() == library.normalize(text)
        assert len(align) == len(out) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())
        ids, begins, ends, _ = encoder.encode(pa.array([text]))
        pieces = library.encode(text, return_type='proto').pieces
        assert ids.tolist() == [p.id for p in pieces]
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in pieces]


def test_longest_prefix_wins():
    table = CharacterMap(double_array(RULES))
    assert table.longest_prefix(b"abcd", 0) == (3, b"X")
    assert table.longest_prefix(b"abd", 0) == (2, b"Y")
    assert table.longest_prefix(b"ad", 0) == (0, b"")
    assert CharacterMap(b"").longest_prefix(b"abc", 0) == (0, b"")

"""Token counts against the library, over blocks and buckets of any size."""

from __future__ import annotations

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from flowlens.llm import block_counts
from flowlens.llm.token_counts import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello  world\n\n x ", "a▁ b▁▁c", "\t tabs\r\n", "日本語 テキスト é", "<s> </s> <0x0A>",
         "😀 \x00 \x7f", "x" * 5000, "one two " * 3000]


@pytest.mark.parametrize("block", [60, 16_000_000])
def test_counts_equal_the_library(spark, monkeypatch, block):
    monkeypatch.setattr(block_counts, "BLOCK_BYTES", block)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "y", 1), (None, "null id", "z", 1)] + [(100 + i, "hot copy text", "z", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block string, n_words int").repartition(3)
    library = SentencePieceProcessor(model_file=PATH)
    got = token_counts(docs, PATH).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == sorted(
        repr((d, len((t or "").encode()), len(library.encode(t or "")))) for d, t, _, _ in rows)
    assert all((r.n_pretokens > 0) == (r.n_bytes > 0) for r in got)


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r.n_tokens for r in token_counts(docs, PATH).collect()] == [0, 0]
    assert token_counts(docs.limit(0), PATH).count() == 0

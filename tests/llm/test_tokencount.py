from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm.common import new_path
from peakloom.llm.tokencount import SEPARATOR, WIDTH, count_tokens, document_tokens, tokens_of

from .conftest import ODD


def test_against_the_tokenizer(odd, spark):
    found = sorted(((r.doc_id, r.n_tokens) for r in document_tokens(odd, new_path(spark, "tokens-test")).collect()), key=repr)
    assert found == sorted(((d[0], len(tokens_of(d[1] or ""))) for d in ODD), key=repr)


def test_tokens_decode_to_the_text():
    from peakloom.llm.tokencount import TOKENIZERS, VOCABULARY, _encoding

    text = "Straße, it's 42 ñandús\n\n  東京"
    assert _encoding(f"{TOKENIZERS}/{VOCABULARY}").decode(tokens_of(text)) == text
    assert max(tokens_of(text)) < SEPARATOR


@pytest.mark.parametrize("block", [1, 3, 4, 100])
@pytest.mark.parametrize("tokens", [[], [SEPARATOR], [1, 2], [1, SEPARATOR, 2, 3, SEPARATOR], [SEPARATOR, SEPARATOR, 5], [1] * 10 + [SEPARATOR] + [2] * 9])
def test_documents_across_blocks(spark, tmp_path, tokens, block):
    path = tmp_path / "f.tokens"
    path.write_bytes(np.array(tokens, WIDTH).tobytes())
    files = spark.createDataFrame([(str(path), len(tokens))], "path string, n_tokens long")
    want, n = [], 0
    for t in tokens:
        if t == SEPARATOR:
            want.append(n)
            n = 0
        else:
            n += 1
    want += [n] * (n > 0)
    assert [r.n_tokens for r in count_tokens(files, block_tokens=block).orderBy("ordinal").collect()] == want


def test_files_of_no_size_and_clashing_names(spark, odd):
    assert count_tokens(spark.createDataFrame([("nowhere", 0), ("nowhere", None)], "path string, n_tokens long")).count() == 0
    clashing = odd.withColumn("path", F.lit(1)).withColumn("ordinal", F.lit(2)).withColumn("n_tokens", F.lit(3)).withColumn("block", F.lit(4))
    assert document_tokens(clashing, new_path(spark, "tokens-test")).count() == len(ODD)


def test_empty(none, spark):
    assert document_tokens(none, new_path(spark, "tokens-test")).count() == 0

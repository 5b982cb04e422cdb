import zlib

import numpy as np
import pytest
from odd_rows import ODD

from tidewatch.llm import packing, tokens


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def test_ids_equal_the_tokenizers_library(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [t or "" for _, t, *_ in ODD] + ["<|endoftext|> a", "  a\n\n b\t c  ", "it's we'll　x \x85 y"]
    own, lib = tokens.token_ids(), library()
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == np.array(want.ids, dtype="<u4").tobytes()


def check(rows, pieces, width=1024):
    lib = library()
    ids = {}
    for n, (_, text, *_rest) in enumerate(rows):
        ids[n] = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    at = {}
    for p in pieces:
        at.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for doc, found in ((r[0], ids[n]) for n, r in enumerate(rows)):
        own = sorted(at[(doc, len(found))], key=lambda p: p.start)
        copies = sum(r[0] == doc and len(ids[n]) == len(found) for n, r in enumerate(rows))
        assert sum(p.length for p in own) == copies * len(found)
        for p in own:
            part = found[p.start : p.start + p.length]
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for window in windows.values():
        place = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == place
            place += p.length
        assert 0 < place <= width
        padding += 0 if place & (place - 1) == 0 else width - place
    return padding


def test_every_id_in_one_piece_and_no_padding(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect()) == 0
    assert check(ODD, packing.pack(odd_docs).collect()) == 0


def test_empty_table_and_extra_columns(make_docs, clash):
    assert packing.pack(make_docs([])).count() == 0
    assert packing.pack(clash).count() > 0


@pytest.mark.parametrize("size", [1, 300, 512, 1023])
def test_rule_takes_the_smallest_sum_of_squares(size):
    rng = np.random.default_rng(size)
    levels = packing.SumOfSquares(1024)
    levels.count[1:1024] = rng.integers(0, 4, 1023)
    best = None
    for h in range(0, 1024 - size + 1):
        if h and not levels.count[h]:
            continue
        after = levels.count.copy()
        if h:
            after[h] -= 1
        if h + size < 1024:
            after[h + size] += 1
        cost = int((after[1:1024] ** 2).sum())
        if best is None or cost <= best[0]:
            best = (cost, h)
    assert levels.level_for(size) == best[1]


def test_added_tokens_in_a_text_are_those_of_the_library(make_docs):
    lib = library()
    lib.encode_special_tokens = False
    texts = ["x <|endoftext|> a", "<|endoftext|>", "<|endoftext|><|endoftext|>  b", "é<|endoftext|>\n\n", "<|endoftext|", "it's <|ENDOFTEXT|> we", "", "   "]
    found = {p.doc_id: p for p in packing.pack(make_docs(list(enumerate(texts)))).collect() if p.start == 0}
    for doc, text in enumerate(texts):
        want = np.array(lib.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert found[doc].doc_tokens == len(want) + 1
        assert found[doc].ids_crc32 == zlib.crc32(np.append(want, np.uint32(0))[: found[doc].length].tobytes())
        assert tokens.token_ids().ids(text) == want.tobytes()
    assert tokens.token_ids().ids("x <|endoftext|> a") == np.array([87, 220, 50256, 257], dtype="<u4").tobytes()

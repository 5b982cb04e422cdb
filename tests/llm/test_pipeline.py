import zlib

import corpus_pipeline
from tidewatch.llm import mixing, pii
from tidewatch.llm.tokens import token_ids


def test_stages_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        seen.append(docs)
    start, good, single, masked, mixed = (sorted((r.doc_id, r.text) for r in d.collect()) for d in seen)
    assert len(start) > len(good) > len(single) == len(masked)
    assert [d for d, _ in masked] == [d for d, _ in single]
    tag = pii.tagger()
    assert dict(masked) == {d: pii.mask(t, pii.find_spans([t], tag)[0][1]) for d, t in single}
    assert {d for d, _ in mixed} <= {d for d, _ in masked} and set(mixed) <= set(masked)
    pieces = corpus_pipeline.run(spark, sf).collect()
    want = {d: len(token_ids().encode(t)) // 4 + 1 for d, t in mixed}
    copies = {d: sum(1 for x, _ in mixed if x == d) for d in want}
    assert sum(p.length for p in pieces) == sum(n * copies[d] for d, n in want.items())
    texts = dict(mixed)
    for p in pieces:
        ids = token_ids().encode(texts[p.doc_id]) + b"\0\0\0\0"
        assert zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32


def test_mixture_changes_the_shares(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert mixing.mix(docs).count() != docs.count()

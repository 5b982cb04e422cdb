import hashlib
import random
import re
import time

from odd_rows import ODD

from tidewatch.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    kinds = list(PATTERNS)
    found = [(m.start(), kinds.index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


EXTRA = [
    "mail bob.smith+x@mail7.example.com, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "call +1 (017) 555-7713 or +49 30 1234567890123456 é +12", "1.2.3.4.5.6.7.8", "a@b a@b.c @b.c a@@b.c", "00000000000000 " * 3,
]


def test_query_has_the_base_spans(spark, sf, make_docs, tmp_path):
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(EXTRA)]]
    make_docs(rows).unionByName(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", pii.F.col("doc_id") + 1000)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 200
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in PATTERNS)
        assert set(base) <= set(r.spans.split(","))


def test_model_finds_what_patterns_miss_and_leaves_clean_text():
    tag = pii.tagger()
    kinds = lambda text: [(text[a:b], k) for a, b, k in pii.find_spans([text], tag)[0][1]]
    assert kinds("please call 555-123-4567 today") == [("555-123-4567", "phone")]
    assert kinds("write to john (at) foo (dot) com now") == [("john (at) foo (dot) com", "email")]
    secret = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert kinds(f'with token = "{secret}" on') == [(secret, "secret")]
    for clean in ("in 1999 there were 12 of 345 things", "Apache License, Version 2.0. and version 3.", "no digits here at all", "on 2024-05-01 at 10:30 we met"):
        assert kinds(clean) == []


def test_held_out_accuracy():
    tag = pii.tagger()
    right = total = 0
    for words, tags in pii.training_rows(seed=77, count=150):
        labels = [pii.LABELS[n] for n in tag.tag([words])[0]]
        right += sum(a == b for a, b in zip(labels, tags, strict=True) if b != "O" or a != "O")
        total += sum(a != "O" or b != "O" for a, b in zip(labels, tags, strict=True))
    assert right > 0.95 * total


def test_runs_give_the_labels_of_the_whole_text(spark, sf):
    tag = pii.tagger()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + EXTRA + ["7", " 7 ", "x 7 " + "y " * 300 + "= 5"]
    assert pii.model_spans(texts, tag) == pii.model_spans(texts, tag, whole=True)


def test_stage_masks_and_keeps_columns(clash, make_docs):
    out = pii.pii_stage(None, clash, "")
    assert out.columns == clash.columns and out.count() == 10
    row = pii.pii_stage(None, make_docs([(1, "ip 10.0.0.1 end")]), "").first()
    assert row.text == "ip [ip] end" and row.n_chars == 11
    assert pii.pii_stage(None, make_docs([]), "").count() == 0


def test_loud_words_inside_a_run_move_its_end():
    tag = pii.tagger()
    secret = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    tails = ["bob (at) example (dot) com", "call 555-123-4567", "call 555 123 4567", "card 4111.1111.1111.1112", f'token = "{secret}"', "mail a@b.example.com"]
    texts = [f"{loud} {'w ' * gap}{tail} and so on {'w ' * 9}" for loud in ("12", "a=b", "x_y") for gap in range(8) for tail in tails]
    rng = random.Random(8)
    parts = ["w", "w", "w", "w", "w", "ab12", "(at)", "x(dot)", "=", "key", "call", "555", "a_b,", "\n", *tails]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(2_000)]
    assert pii.model_spans(texts, tag) == pii.model_spans(texts, tag, whole=True)
    text = "12 w w bob (at) example (dot) com and so on"
    assert pii.mask(text, pii.find_spans([text], tag)[0][1]) == "12 w w [email] and so on"


def test_base_spans_equal_the_plain_patterns_on_random_strings():
    def plain(text):
        out = [(m.start(), m.end(), "email") for m in pii.EMAIL.finditer(text)]
        for m in pii.IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        return out

    rng = random.Random(3)
    for alphabet in ("a@.-", "ab@.c_d-", "0129.", "01.@x", "25.. 5"):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            got = [s for s in pii.base_spans(text) if s[2] in ("email", "ip")]
            assert sorted(got) == sorted(plain(text)), text


def test_long_runs_take_no_time():
    for text in ("0" * 5000 + ".1.1.1", "1" * 10**6 + ".", "a" * 10**6 + "@", "a.b" * 300_000 + "@x", "@a" * 300_000, "1." * 400_000):
        start = time.time()
        found = pii.base_spans(text)
        assert time.time() - start < 3
        if text.startswith("0"):
            assert found == [(0, 5006, "ip")]
        if text.startswith("1."):
            assert sum(s[2] == "ip" for s in found) == 100_000


def test_the_stage_works_without_a_length(odd_docs):
    got = pii.pii_stage(None, odd_docs.drop("n_chars"), "")
    assert got.columns == ["doc_id", "text", "lang", "source"] and got.count() == 10

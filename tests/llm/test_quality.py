import re

from odd_rows import ODD

from tidewatch.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics_and_odd_rows(spark, make_docs):
    part = "one two three four five six seven eight nine ten eleven twelve"
    rows = [*ODD, (20, f"{part} x {part} y {part}", "en", "a"), (21, f"{part}\n{part}\nz\n{part} #$", "en", "a"), (22, "a " * 50, "en", "a")]
    got = quality.judge(make_docs(rows)).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got) == sorted(str(expected(r[1])) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)


def test_thresholds_follow_language_and_source(make_docs):
    clean = "some plain words of a text that goes on for a while until it has more than twenty words in it at last"
    noisy = clean.replace(" ", " ## ")
    rows = [(i, f"{clean} {i}", "en", "a") for i in range(300)] + [(1000 + i, f"{noisy} {i}", "en", "b") for i in range(300)]
    rows += [(5000, noisy, "en", "a"), (5001, noisy, "en", "b")]
    kept = {r.doc_id: r.kept for r in quality.judge(make_docs(rows)).collect()}
    assert not kept[5000] and kept[5001] and kept[3] and kept[1003]


def test_small_groups_borrow_the_language_sketch(make_docs):
    clean = "some plain words of a text that goes on for a while until it has more than twenty words in it at last"
    rows = [(i, f"{clean} {i}", "en", f"s{i}") for i in range(300)] + [(900, clean.replace(" ", " *** "), "en", "tiny")]
    kept = {r.doc_id: r.kept for r in quality.judge(make_docs(rows)).collect()}
    assert kept[0] and not kept[900]


def test_empty_table_and_extra_columns(make_docs, clash):
    assert quality.judge(make_docs([])).count() == 0
    assert quality.judge(clash).count() == 10
    assert quality.quality_stage(None, clash, "").columns == clash.columns


def test_the_stage_leaves_all_columns_as_they_were(make_docs, clash):
    from pyspark.sql import functions as F

    text = "some plain words of a text that goes on for a while until it has more than twenty words in it at last"
    docs = make_docs([(i, f"{text} {i}") for i in range(30)] + [(99, "too short")])
    names = ["kept", "n_words", "base_failed", "_q_lang", "_q_lines", "__q_lang", "row", "max_word_length", "N_symbols"]
    wide = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names})
    got = quality.quality_stage(None, wide, "").collect()
    assert sorted(r.doc_id for r in got) == list(range(30))
    assert all(r[n] == f"{n} of {r.doc_id}" for r in got for n in names)
    judged = quality.judge(wide.drop("kept", "n_words", "base_failed", "N_symbols")).collect()
    assert all(r["_q_lang"] == f"_q_lang of {r.doc_id}" and r.n_words in (2, 24) for r in judged)

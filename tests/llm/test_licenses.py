import itertools
import re
import re._parser as grammar

from odd_rows import ODD

from tidewatch.llm import licenses
from tidewatch.llm.license_rules import CONFIDENCE, rules


def expansions(parsed):
    """Texts a signature matches: every branch, optional parts left out and taken."""
    parts = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v) for k, v in value if str(k) == "LITERAL"] or ["heck"])
        elif name == "BRANCH":
            parts.append([x for branch in value[1] for x in expansions(branch)])
        elif name == "SUBPATTERN":
            parts.append(expansions(value[-1]))
        else:
            assert name == "MAX_REPEAT"
            parts.append(([""] if value[0] == 0 else []) + expansions(value[2]))
    return ["".join(p) for p in itertools.product(*parts)]


def brute(text):
    """Word count, phrases, labels and score by matching all rules at all words."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places = [
        (i, label) for phrase, label in licenses.BASE for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    joined, starts = " ".join(words), {}
    at = 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    found = []
    for r in rules():
        for m in re.finditer(rf"(?<![^ ])(?:{r.signature})(?![^ ])", joined):
            first = starts[m.start()]
            found.append((first, first + m[0].count(" "), r.tier, r.rule, r.label))
    stay = [
        d for d in found
        if not any(e != d and e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[2:4] < d[2:4]) for e in found)
    ]
    base = sorted({label for _, label in places})
    at = [i for i, _ in places]
    labels = sorted({*base, *(d[4] for d in stay)})
    score = max((CONFIDENCE[d[2]] for d in stay), default=0.0)
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score), sorted(stay)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_every_rule_holds_its_keyword_and_is_found_by_it():
    found = rules()
    assert len(found) > 300 and len({r.signature for r in found}) == len(found)
    for r in found:
        for text in expansions(grammar.parse(r.signature)):
            assert r.keyword in text.split(), (r, text)
            numbered = "".join(f" {i}:{w} " for i, w in enumerate(["x", *text.split(), "y"]))
            assert re.search(licenses.pattern(r.signature), numbered), (r, text)


def test_all_rules_and_odd_rows_equal_brute_force(make_docs):
    rows = [*ODD]
    for r in rules():
        texts = expansions(grammar.parse(r.signature))
        rows.append((1000 + r.rule, f"Some words. {texts[0].title()}, then more; {texts[-1]}!", "en", "a"))
    rows += [
        (50, "GNU Lesser General Public License, version 2.1 or later", "en", "a"),
        (51, "cc-by cc-by CC BY-NC 4.0\nMIT License\nMIT License", "en", "a"),
        (52, "permission is hereby granted free of charge to any person obtaining a copy " * 40, "en", "a"),
        (53, "the apache license version 2 0 and gplv2 or GPL 3.0 and gpl", "en", "a"),
        (54, "submit licenses, mit-licensed emit license", "en", "a"),
    ]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {r[1] for r in rows}
    want = {text: brute(text) for text in texts}
    for r in got:
        values, stay = want[r.text]
        assert tuple(r[c] for c in COLUMNS) == values, r
        assert sorted((d.first_word, d.last_word, d.tier, d.rule, d.label) for d in r.licenses) == stay


def test_containment_and_priority(make_docs):
    texts = [
        "under the GNU Lesser General Public License version 2.1",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under CC BY-NC 4.0.",
        "plain prose on the general public and its licenses",
    ]
    got = {r.text: r for r in licenses.scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    assert [got[t].labels for t in texts] == ["lgpl-2.1", "gpl-2.0", "cc-by,cc-by-nc-4.0", ""]
    assert [got[t].score for t in texts] == [0.9, 1.0, 0.9, 0.0]


def test_copies_clash_and_empty(make_docs, clash):
    rows = [(i, "all copies hold the MIT License\n" * 3, "en", "a") for i in range(500)]
    got = licenses.scan_licenses(make_docs(rows))
    assert {(r.n_base, r.labels, len(r.licenses)) for r in got.collect()} == {(3, "mit", 3)} and got.count() == 500
    assert licenses.scan_licenses(make_docs([])).count() == 0
    mixed = licenses.scan_licenses(clash)
    assert mixed.count() == 10 and set(mixed.columns) == set(clash.columns) | set(licenses.RESULT)
    assert all(r.kept == "x" and r.spans == "x" for r in mixed.collect())


def test_no_python_in_the_plan(spark, sf):
    plan = licenses.op12_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)

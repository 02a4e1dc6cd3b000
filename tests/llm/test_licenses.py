import functools
import random
import re
import time

import duckdb
import pandas as pd

from protomatch.llm.licenses import BASE_PHRASES, Rule, expression_rules, gate_words, license_digest, scan_licenses, signature_rules
from protomatch.llm.sql import license_sql
from tests.llm.helpers import documents, odd_rows, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [*signature_rules(), *expression_rules()]
COMPILED = [re.compile(f"({r.pattern}) ") for r in RULES]


@functools.cache
def matches_ahead(ahead):
    """Words and ranks of the rules that match at the beginning."""
    tried = ((m, rank) for rank, expression in enumerate(COMPILED) if RULES[rank].keyword in ahead for m in [expression.match(ahead)])
    return [(m[1].count(" ") + 1, rank) for m, rank in tried if m]


def brute(text):
    """Counts of the base phrases and kept detections, word by word."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base, found = [], []
    for k in range(len(words)):
        for phrase, label in BASE_PHRASES:
            n = phrase.count(" ") + 1
            if words[k:k + n] == phrase.split():
                base.append((k, label))
        found += [(k, -(k + n), rank, RULES[rank]) for n, rank in matches_ahead(" ".join(words[k:k + 160]) + " ")]
    kept, end = [], 0
    for start, minus_end, _, r in sorted(found, key=lambda x: x[:3]):
        if -minus_end > end:
            kept.append(r)
            end = -minus_end
    labels = {x for _, x in base} | {r.label for r in kept}
    score = max([0.75 for _ in base] + [r.confidence for r in kept], default=0.0)
    return (
        len(words), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score,
    )


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3. MIT license; mit LICENSE", "cc by cc by cc", "gnu general public gnu general public license",
    "Apache License 2.0 apache license", "released under the New BSD license", "SPDX-License-Identifier: MIT license", "MIT", "apache\x00license", "ücc by", "ACC BY", "cc by",
    "under the terms of the GNU Lesser General Public License", None, "", "   ", "licensed under the mozilla public license version 2.0 " * 40,
]


def test_equals_word_by_word_scan(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(TEXTS)]
    got = rows_of(license_digest(scan_licenses(documents(spark, rows))))
    assert sorted(got) == sorted((k, *brute(t)) for k, t in enumerate(TEXTS))


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = odd_rows()
    got = rows_of(license_digest(scan_licenses(documents(spark, rows, clashes=True))))
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
    assert license_digest(scan_licenses(documents(spark, []))).count() == 0


def test_longer_or_earlier_rule_suppresses_contained_ones(spark):
    rules = [Rule("a", "one two", "one", 2, 0, 0.5), Rule("b", "one two three", "one", 3, 1, 0.5), Rule("c", "two", "two", 1, 0, 0.5), Rule("d", "three four", "three", 2, 0, 0.5)]
    scanned = scan_licenses(documents(spark, [(1, "licensed one two three four", None, None, None)]), rules)
    assert [d["label"] for d in scanned.first()["detections"]] == ["b", "d"]


def test_hundreds_of_rules_and_a_plan_without_python_or_shuffle(spark):
    assert len(signature_rules()) > 200 and len(expression_rules()) > 250
    plan = license_digest(scan_licenses(documents(spark, [(1, "x", None, None, None)])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


FORMS = [
    ("SPDX-License-Identifier: MIT", "mit", 4), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0", 6), ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0", 8),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause", 6), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0", 6), ("released under GPLv3", "gpl-3.0", 1),
    ("covered by the GNU LGPL", "lgpl", 2), ("Permission is hereby granted, free of charge", "mit", 7), ("Redistribution and use in source and binary forms", "bsd", 8),
    ("the GNU General Public License, either version 3 of the License, or (at your option) any later version", "gpl-3.0", 17), ("LGPL v2.1 or later", "lgpl-2.1", 5),
    ("SPDX-License-Identifier: LGPL-2.0-only", "lgpl-2.0", 7), ("SPDX-License-Identifier: LGPL-2.0-or-later", "lgpl-2.0", 8), ("LGPL 2.0", "lgpl-2.0", 3), ("CDDL 1.0", "cddl-1.0", 3),
    ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa-3.0", 7), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc-sa-4.0", 9),
]


def test_ids_versions_and_license_texts(spark):
    rows = [(k, f"before it {text}, and after", None, None, None) for k, (text, _, _) in enumerate(FORMS)]
    found = {r["id"]: [(d["label"], -d["minus_end"] - d["start"]) for d in r["detections"]] for r in scan_licenses(documents(spark, rows)).collect()}
    assert found == {k: [(label, n_words)] for k, (_, label, n_words) in enumerate(FORMS)}


def test_all_ids_of_an_expression(spark):
    texts = {"EPL-2.0 OR Apache-2.0": ["epl-2.0", "apache-2.0"], "Apache-2.0 OR MIT": ["apache-2.0", "mit"], "MIT AND BSD-3-Clause": ["mit", "bsd-3-clause"],
             "GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-1.1": ["gpl-2.0", "mpl-1.1"]}
    rows = [(k, f"SPDX-License-Identifier: {t}", None, None, None) for k, t in enumerate(texts)]
    found = {r["id"]: [d["label"] for d in r["detections"]] for r in scan_licenses(documents(spark, rows)).collect()}
    assert found == dict(enumerate(texts.values()))


def a_match(parsed, rng):
    """A random text that the expression matches."""
    text = ""
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            text += chr(value)
        elif kind == "NOT_LITERAL":
            text += rng.choice("xyz")
        elif kind == "IN":
            low, high = value[0][1] if str(value[0][0]) == "RANGE" else (value[0][1], value[0][1])
            text += chr(rng.randint(low, high))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, part = value
            text += "".join(a_match(part, rng) for _ in range(rng.randint(least, min(most, least + 5))))
        elif kind == "SUBPATTERN":
            text += a_match(value[-1], rng)
        elif kind == "BRANCH":
            text += a_match(rng.choice(value[1]), rng)
        else:
            raise ValueError(kind)
    return text


def matches_of_every_rule(times):
    rng = random.Random(3)
    return [(r, a_match(re._parser.parse(r.pattern), rng)) for r in expression_rules() for _ in range(times)]


def test_every_match_holds_its_keyword_and_a_gate_word():
    gate = gate_words(RULES)
    for r, text in matches_of_every_rule(40):
        assert r.keyword in text, (r, text)
        assert any(w in text for w in gate), (r, text)


def test_every_rule_equals_word_by_word_scan_and_sql(spark):
    made = [text for _, text in matches_of_every_rule(1)]
    rng = random.Random(4)
    texts = [f"see {a}; {rng.choice(['and', 'the', ''])} {b.upper()} then. {c}" for a, b, c in zip(made, rng.sample(made, len(made)), rng.sample(made, len(made)), strict=True)] + TEXTS
    want = sorted((k, *brute(t)) for k, t in enumerate(texts))
    table = documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    assert sorted(rows_of(license_digest(scan_licenses(table)))) == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    assert sorted(con.execute(f"select {columns} from ({license_sql()})").fetchall()) == want


def test_time_grows_with_the_text_not_with_its_square(spark):
    def seconds(n):
        began = time.monotonic()
        row = scan_licenses(documents(spark, [(1, "mit license x " * n, None, None, None)])).first()
        assert len(row["detections"]) == n and row["detections"][-1]["start"] == 3 * n - 3
        return time.monotonic() - began

    seconds(10)
    assert seconds(80_000) < 60

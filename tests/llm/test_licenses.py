import random
import re

import pytest

from ledgerline.llm.licenses import BASE, evaluate, postfix, scan, scan_licenses, tokens
from tests.llm.cases import MEDIUM, documents, edge_docs, no_docs


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_documents(spark):
    docs = documents(spark, MEDIUM)
    expected = {r.doc_id: plain(r.text) for r in docs.collect()}
    rows = scan_licenses(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == expected
    assert any(r.n_base for r in rows)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_random_phrases():
    rng = random.Random(4)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "MIT-License", "CC BY", "é"]
    for _ in range(500):
        text = " ".join(rng.choices(words, k=rng.randint(0, 25)))
        assert scan(text.encode())[:5] == plain(text)


def test_binding_of_operators():
    assert postfix("mit or apache-2.0 and gpl-2.0 with classpath".split()) == (
        "mit apache-2.0 gpl-2.0 classpath with and or".split()
    )
    assert postfix("( mit or isc ) and gpl-3.0".split()) == "mit isc or gpl-3.0 and".split()


def by_recursion(expression):
    """A recursive reading of the same grammar."""
    from ledgerline.llm.licenses import PERMISSIVE, label_of

    at = 0

    def value():
        nonlocal at
        token = expression[at]
        at += 1
        if token == "(":
            out = chain("or")
            at += 1
            return out
        return ({label_of(token)} - {None}, label_of(token) in PERMISSIVE)

    def exception():
        nonlocal at
        out = value()
        while at < len(expression) and expression[at] == "with":
            at += 1
            value()
            out = (out[0] | {f"{x}-with-exception" for x in out[0]}, out[1])
        return out

    def chain(operator):
        nonlocal at
        inner = exception if operator == "and" else lambda: chain("and")
        out = inner()
        while at < len(expression) and expression[at] == operator:
            at += 1
            more = inner()
            free = out[1] and more[1] if operator == "and" else out[1] or more[1]
            out = (out[0] | more[0], free)
        return out

    return chain("or")


def test_expressions_equal_recursion():
    rng = random.Random(9)
    names = ["mit", "apache-2.0", "gpl-2.0-only", "lgpl-3.0", "unknown-1", "isc"]

    def some(depth):
        if depth == 0 or rng.random() < 0.4:
            return [rng.choice(names)] + (["with", "classpath-exception-2.0"] if rng.random() < 0.2 else [])
        inner = some(depth - 1) + [rng.choice(["and", "or"])] + some(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(500):
        expression = some(4)
        assert tokens(" ".join(expression), 0) == expression
        assert evaluate(expression) == by_recursion(expression)


@pytest.mark.parametrize(
    ("text", "labels", "permissive"),
    [
        ("SPDX-License-Identifier: MIT", "mit", True),
        ("# SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND BSD-3-Clause\ncode", "bsd,gpl,mit", True),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl,gpl-with-exception", False),
        ("License: Apache-2.0 and then some prose", "apache", True),
        ("license: what you like", "", None),
        ("SPDX-License-Identifier:", "", None),
        ("SPDX-License-Identifier: ((MIT", "", None),
        ("sublicense: MIT", "", None),
    ],
)
def test_tags(text, labels, permissive):
    found = scan(text.encode())
    assert (found[5], found[8]) == (labels, permissive)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = scan_licenses(docs).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    for key in (3, 4, 5):
        assert (by_id[key].n_words, by_id[key].first_word, by_id[key].labels, by_id[key].score) == (0, None, "", 0.0)
    assert scan_licenses(no_docs(spark)).collect() == []

"""Licence scan: notice phrases, identifier tags and licence expressions.

One Aho-Corasick automaton finds notice phrases in the words of the text,
another finds identifier tags in the text itself. What follows a tag is
read as a licence expression by a shunting-yard parser: `with` binds
tightest, then `and`, then `or`.

Defined results: null and empty texts have no words, no labels and score 0;
every place counts, overlapping ones too; an expression ends at the end of
its line or before the first token that cannot continue it, and one without
a known licence gives no label.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import letter_words, ship

# Phrases and labels that the results must have.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
}
# Identifier tags, and labels by how licence identifiers begin.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
IDENTIFIERS = {
    "agpl-": "agpl",
    "apache-": "apache",
    "bsd-": "bsd",
    "cc-by-": "cc-by",
    "cc0-": "cc0",
    "epl-": "epl",
    "gpl-": "gpl",
    "isc": "isc",
    "lgpl-": "lgpl",
    "mit": "mit",
    "mpl-": "mpl",
    "unlicense": "public-domain",
}
PERMISSIVE = frozenset(("apache", "bsd", "cc-by", "cc0", "isc", "mit", "public-domain"))

_BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, expressions array<string>, permissive boolean"
)


def tokens(text: str, at: int) -> list[str]:
    """The tokens of the longest start of `text[at:]` that is an expression.

    A licence is one of IDENTIFIERS or, as all but a few are, hyphenated.
    """
    out: list[str] = []
    whole = depth = 0
    while match := _TOKEN.match(text, at):
        token, after_value = match[1], bool(out) and out[-1] not in _BINDING and out[-1] != "("
        if token == "(":
            if after_value:
                break
            depth += 1
        elif token == ")":
            if not after_value or not depth:
                break
            depth -= 1
        elif (token in _BINDING) != after_value:
            break
        elif token not in _BINDING and "-" not in token and not label_of(token):
            break
        out.append(token)
        if not depth and token not in _BINDING:
            whole = len(out)
        at = match.end()
    return out[:whole]


def postfix(expression: list[str]) -> list[str]:
    """Shunting-yard: operands before their operator."""
    out: list[str] = []
    waiting: list[str] = []
    for token in expression:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in _BINDING:
            while waiting and _BINDING.get(waiting[-1], 0) >= _BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def label_of(identifier: str) -> str | None:
    for start, label in IDENTIFIERS.items():
        if identifier == start or start.endswith("-") and identifier.startswith(start):
            return label
    return None


def evaluate(expression: list[str]) -> tuple[set[str], bool]:
    """Labels named, and whether permissive licences alone can satisfy it.

    `a with b` has the label of a and, if that is known, one more that tells
    of an exception; it is as permissive as a.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token not in _BINDING:
            label = label_of(token)
            stack.append(({label} if label else set(), label in PERMISSIVE))
            continue
        (right, right_free), (left, left_free) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left | {f"{name}-with-exception" for name in left}, left_free))
        elif token == "and":
            stack.append((left | right, left_free and right_free))
        else:
            stack.append((left | right, left_free or right_free))
    return stack[0] if stack else (set(), False)


@cache
def _automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (BASE | NOTICES).items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes | None) -> tuple:
    """The row of results for one text."""
    phrases, tags = _automata()
    words = letter_words(text)
    # One character per byte: positions stay cheap and all terms are ASCII.
    line = f" {b' '.join(words).decode('latin-1')} "
    base, labels, starts, evidence = set(), set(), [], 0
    word = before = 0
    for end, (length, label, is_base) in sorted(phrases.iter(line), key=lambda hit: hit[0] - hit[1][0]):
        start = end - length + 1
        word += line.count(" ", before, start)
        before = start
        labels.add(label)
        evidence += 1
        if is_base:
            base.add(label)
            starts.append(word)
    raw = (text or b"").lower().decode("latin-1")
    expressions, permissive, upto = [], [], 0
    for end, length in tags.iter(raw):
        start = end - length + 1
        if start < upto or (start and (raw[start - 1].isalnum() or raw[start - 1] in "-_")):
            continue
        expression = tokens(raw, end + 1)
        named, free = evaluate(expression)
        if named:
            labels |= named
            evidence += 2
            expressions.append(" ".join(expression))
            permissive.append(free)
            upto = end + 1
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        1 - 0.5**evidence,
        expressions,
        all(permissive) if permissive else None,
    )


def _scanned(texts: pd.Series) -> pd.DataFrame:
    names = [part.split()[0] for part in _RESULT.split(", ")]
    frame = pd.DataFrame([scan(text) for text in texts], columns=names)
    return frame.astype({"first_word": "Int64", "last_word": "Int64", "permissive": "boolean"})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and findings of every document."""
    ship(docs.sparkSession)
    scanned = F.pandas_udf(_scanned, _RESULT)
    found = docs.select("doc_id", scanned(F.col("text").cast("binary")).alias("found"))
    return found.select("doc_id", "found.*")

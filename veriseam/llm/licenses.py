"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are lower-cased in A-Z and cut into words (runs of letters a-z, digits and all characters beyond ASCII). One
automaton over the words joined by single spaces finds all phrases at once, overlapping ones too. Where the tag
``SPDX-License-Identifier`` occurs, the expression behind it is read from the text itself; so is one where notice
phrases stand with only ``and``, ``or``, ``with`` and articles between them. An expression is turned into postfix form
(``WITH`` binds tighter than ``AND``, that tighter than ``OR``) and evaluated: its labels, and whether some choice
of its alternatives has permissive licences only. An expression ends where an operator is due and another word comes,
so prose behind a tag is no part of it; an operand is a licence family or a word with a digit or hyphen in it.

Null texts count as empty: no words, no labels, score 0. Rows that repeat give repeated results; other columns are
ignored. A broken expression yields the labels of the licences in it and the verdict ``unclear``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

# Phrases (in words) and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: First words of SPDX identifiers, their label, and whether the licence is permissive.
FAMILIES = {"mit": ("mit", True), "apache": ("apache", True), "bsd": ("bsd", True), "isc": ("isc", True), "bsl": ("boost", True), "cc0": ("cc0", True), "unlicense": ("unlicense", True), "gpl": ("gpl", False), "lgpl": ("lgpl", False), "agpl": ("agpl", False), "mpl": ("mpl", False), "epl": ("epl", False), "zlib": ("zlib", True), "x11": ("x11", True), "ncsa": ("ncsa", True), "postgresql": ("postgresql", True), "python": ("python", True), "psf": ("python", True), "wtfpl": ("wtfpl", True), "artistic": ("artistic", True), "ofl": ("ofl", True), "cddl": ("cddl", False), "osl": ("osl", False), "eupl": ("eupl", False), "sspl": ("sspl", False)}
PERMISSIVE = frozenset("mit apache bsd isc boost cc0 unlicense cc-by zlib".split())
#: Words that may stand between the notice phrases of one expression.
LINKS = {"and": "and", "or": "or", "with": "with"}
FILLERS = frozenset("the a an either at your option under both version 2 3 0 later".split())

_NOT_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\n\r*]*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def _operand(token: str) -> bool:
    return token.startswith("cc-by") or re.split(r"[-.+]", token)[0] in FAMILIES or any(c.isdigit() or c == "-" for c in token)


def expression_tokens(expression: str) -> list[str]:
    """The tokens of the expression at the start of a text, without what follows it."""
    out: list[str] = []
    depth = 0
    for token in _TOKEN.findall(expression):
        due = not out or out[-1] in _BINDS or out[-1] == "("  # whether an operand is due
        if due and token not in _BINDS and token not in "()" and not (_operand(token) or (out and out[-1] == "with")):
            break
        if not due and token != ")" and token not in _BINDS or token == ")" and not depth:
            break
        depth += (token == "(") - (token == ")")
        out.append(token)
    return out


def postfix(expression: str | list[str]) -> list[str] | None:
    """A licence expression (its text, or its tokens) in postfix form by the shunting-yard algorithm; None if malformed."""
    tokens = _TOKEN.findall(expression) if isinstance(expression, str) else expression
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand is due
    for token in tokens:
        if token in _BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return None if operand else out


def _family(token: str) -> tuple[str, bool]:
    if token.startswith("cc-by"):
        return re.match(r"cc-by(-nc|-nd|-sa)*", token)[0], token == "cc-by" or token.startswith("cc-by-") and token[6:7].isdigit()
    return FAMILIES.get(re.split(r"[-.+]", token)[0], (token.rstrip("+"), token in PERMISSIVE))


def evaluate(expression: str | list[str]) -> tuple[set[str], str]:
    """The labels of a licence expression (its text, or its tokens) and its verdict: permissive, restricted or unclear."""
    found = expression_tokens(expression) if isinstance(expression, str) else expression
    tokens = postfix(found)
    if tokens is None:
        return {_family(t)[0] for t in found if t not in _BINDS and t not in "()"}, "unclear"
    stack: list[tuple[set[str], bool]] = []
    for token in tokens:
        if token not in _BINDS:
            label, free = _family(token)
            stack.append(({label}, free))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # an exception adds rights to its licence and is no licence itself
            stack.append(left)
        else:
            stack.append((left[0] | right[0], left[1] and right[1] if token == "and" else left[1] or right[1]))
    labels, free = stack[0]
    return labels, "permissive" if free else "restricted"


def noticed(words: list[str], places: list[tuple[int, int, str]]) -> list[str]:
    """The verdict of each expression that notice phrases form: (first word, words, label), by first word.

    Phrases are linked where only LINKS and FILLERS stand between them, and a link among these. Phrases within a longer
    one are part of that.
    """
    verdicts: list[str] = []
    tokens: list[str] = []
    upto = -1
    for at, n, label in sorted(places, key=lambda p: (p[0], -p[1])):
        if at < upto:
            continue
        between = words[upto:at] if tokens else []
        links = [LINKS[w] for w in between if w in LINKS]
        if tokens and links and len(between) <= 6 and all(w in LINKS or w in FILLERS for w in between):
            tokens += [links[0] if "or" not in links else "or", label]
        else:
            if len(tokens) > 1:
                verdicts.append(evaluate(tokens)[1])
            tokens = [label]
        upto = at + n
    if len(tokens) > 1:
        verdicts.append(evaluate(tokens)[1])
    return verdicts


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    a.make_automaton()
    return a


def scan_text(text: str | None, matcher) -> tuple:
    """n_words, n_base, first and last word of the base places, base labels, all labels, score, verdicts."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    words = lowered.translate(_NOT_WORD).split(b" ")
    words = [w for w in words if w]
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    hits = list(matcher.iter(joined))
    starts = list(accumulate((len(w) + 1 for w in joined.split(" ")[1:-1]), initial=0)) if hits else []
    places: list[int] = []
    notices: list[tuple[int, int, str]] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged = False
    for end, (size, label, is_base) in hits:
        at = bisect_left(starts, end + 1 - size)
        if is_base:
            places.append(at)
            base.add(label)
        elif not label:
            tagged = True
        if label:
            labels.add(label)
            notices.append((at, bisect_left(starts, end) - at, label))
    verdicts = noticed([w.decode("utf-8", "surrogatepass") for w in words], notices) if len(notices) > 1 else []
    if tagged:
        for m in _EXPRESSION.finditer(lowered.decode("utf-8", "surrogatepass")):
            found, verdict = evaluate(m[1])
            labels |= found
            verdicts.append(verdict)
    score = 1.0 if verdicts else 0.9 if base else 0.7 if labels else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(verdicts)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, verdicts."""
    out = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("verdicts", pa.string())])

    def start():
        matcher = automaton()

        def step(keys, texts):
            made = [scan_text(t, matcher) for t in texts]
            return [keys, *([m[i] for m in made] for i in range(8))]

        return step

    return map_rows(docs.withColumn(id_col, docs[id_col].cast("long")), [id_col, text_col], start, out, f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, verdicts string")

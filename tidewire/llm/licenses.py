"""Licence scan: an Aho-Corasick automaton over words, and licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import map_batches, slim

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Phrases of the base scan and the label that each stands for.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of common licences.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: SPDX identifiers by label, as families: what stands first, its versions and what may follow these.
FAMILIES = [
    ("mit", "mit", "", "|-0|-cmu|-advertising|-enna|-feh|-festival|-modern-variant|-open-group|-wu"),
    ("apache", "apache", "1.0 1.1 2.0", ""),
    ("gpl", "gpl", "1.0 2.0 3.0", "|+|-only|-or-later"),
    ("lgpl", "lgpl", "2.0 2.1 3.0", "|+|-only|-or-later"),
    ("agpl", "agpl", "1.0 3.0", "|-only|-or-later"),
    ("mpl", "mpl", "1.0 1.1 2.0", ""),
    ("mpl", "mpl", "2.0", "-no-copyleft-exception"),
    ("epl", "epl", "1.0 2.0", ""),
    ("bsd", "bsd", "1-clause 2-clause 3-clause 4-clause", ""),
    ("bsd", "bsd", "2-clause", "-patent|-views"),
    ("bsd", "bsd", "3-clause", "-attribution|-clear|-lbnl|-modification|-open-mpi"),
    ("bsd", "0bsd", "", ""),
    ("isc", "isc", "", ""),
    ("cc-by", "cc-by", "1.0 2.0 2.5 3.0 4.0", ""),
    ("cc-by-sa", "cc-by-sa", "1.0 2.0 2.5 3.0 4.0", ""),
    ("cc-by-nc", "cc-by-nc", "1.0 2.0 2.5 3.0 4.0", ""),
    ("cc-by-nd", "cc-by-nd", "1.0 2.0 2.5 3.0 4.0", ""),
    ("cc-by-nc-sa", "cc-by-nc-sa", "1.0 2.0 2.5 3.0 4.0", ""),
    ("cc-by-nc-nd", "cc-by-nc-nd", "1.0 2.0 2.5 3.0 4.0", ""),
    ("cc0", "cc0", "1.0", ""),
    ("public-domain", "unlicense", "", ""),
    ("zlib", "zlib", "", "|-acknowledgement"),
    ("artistic", "artistic", "1.0 2.0", ""),
    ("artistic", "artistic", "1.0", "-cl8|-perl"),
    ("bsl", "bsl", "1.0", ""),
    ("eupl", "eupl", "1.0 1.1 1.2", ""),
    ("cddl", "cddl", "1.0 1.1", ""),
    ("ofl", "ofl", "1.0 1.1", "|-no-rfn|-rfn"),
    ("osl", "osl", "1.0 1.1 2.0 2.1 3.0", ""),
    ("ecl", "ecl", "1.0 2.0", ""),
    ("upl", "upl", "1.0", ""),
    ("psf", "psf", "2.0", ""),
    ("psf", "python", "2.0 2.0.1", ""),
    ("ms-pl", "ms-pl", "", ""),
    ("ms-rl", "ms-rl", "", ""),
    ("ncsa", "ncsa", "", ""),
    ("postgresql", "postgresql", "", ""),
    ("wtfpl", "wtfpl", "", ""),
    ("x11", "x11", "", ""),
]
IDENTIFIERS = {
    first + ("-" + version if version else "") + end: label
    for label, first, versions, ends in FAMILIES
    for version in versions.split() or [""]
    for end in ends.split("|")
}
#: SPDX exceptions that may stand after ``with``.
EXCEPTIONS = set(
    "autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 "
    "ecos-exception-2.0 fltk-exception font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception "
    "libtool-exception linux-syscall-note llvm-exception openjdk-assembly-exception-1.0 openvpn-openssl-exception "
    "qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception universal-foss-exception-1.0 wxwindows-exception-3.1".split()
)
#: Labels of licences that ask for a notice at most.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc-by", "cc0", "public-domain", "zlib", "bsl", "ecl", "upl", "psf", "ncsa", "postgresql", "wtfpl", "x11"}
TAG, BEHIND_TAG = "spdx-license-identifier", re.compile(r":[ \t]*([^\n]*)")
SYMBOL = re.compile(r"\s*(?:([()])|([a-z0-9][a-z0-9.+-]*))")
OPERATORS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> tuple[list[str], bool, int]:
    """The licence expression at the start of ``text``: postfix symbols, whether it is well formed, its length.

    Shunting-yard: operands go to the output, operators wait on a stack until one that binds no tighter
    arrives; ``with`` binds tighter than ``and``, ``and`` than ``or``. The expression ends where two operands
    meet or another character stands. The work grows with its length.
    """
    output: list[str] = []
    stack: list[str] = []
    at, depth, operand_next, well = 0, 0, True, True
    while match := SYMBOL.match(text, at):
        paren, word = match.groups()
        if paren == "(":
            if not operand_next:
                break
            stack.append(paren)
            depth += 1
        elif paren == ")":
            if operand_next or not depth:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in OPERATORS:
            if operand_next:
                well = False
                break
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[word]:
                output.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next:
                break
            output.append(word)
            operand_next = False
        at = match.end()
    well = well and not operand_next and not depth
    return [*output, *(s for s in reversed(stack) if s != "(")], well, at


def evaluate(postfix: list[str]) -> tuple[set[str], bool, bool]:
    """Of an expression the labels of its known licences, whether all are known, and whether permissive ones suffice.

    ``or`` is met by either side, ``and`` by both; an exception after ``with`` qualifies its licence and is none
    itself, and one that is no known exception leaves not all known. The sides' labels are pooled, the smaller set into the larger, so long expressions take no alternatives apart.
    """
    stack: list[tuple[set[str], bool, bool]] = []
    for symbol in postfix:
        if symbol not in OPERATORS:
            label = IDENTIFIERS.get(symbol)
            stack.append(({label} if label else set(), label is not None or symbol in EXCEPTIONS, label in PERMISSIVE))
            continue
        if len(stack) < 2:
            continue
        right, left = stack.pop(), stack.pop()
        if symbol == "with":
            stack.append((left[0], left[1] and bool(left[0]) and right[1] and not right[0], left[2]))
            continue
        small, large = sorted((left[0], right[0]), key=len)
        large |= small
        free = left[2] or right[2] if symbol == "or" else left[2] and right[2]
        stack.append((large, left[1] and right[1], free))
    if not stack:
        return set(), False, False
    labels, known, free = stack[-1]
    return labels, known and bool(labels), free


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases with a blank on either side, so that only whole words match; and the identifier tag's words."""
    made = ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, NOTICE_PHRASES)):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (base, label, len(phrase) + 1))
    tag = f" {TAG.replace('-', ' ')} "
    made.add_word(tag, (None, "", len(tag) - 1))
    made.make_automaton()
    return made


def scan(text: str) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, expressions`` of one text."""
    low = text.translate(UPPER) if not text.isascii() else text.lower()
    words = WORD.findall(low)
    line = f" {' '.join(words)} "
    base, starts, more, expressions, tags = set(), [], set(), [], []
    for end, (kind, label, back) in automaton().iter(line):
        if kind:
            base.add(label)
            starts.append(end - back)
        elif kind is None:
            tags.append(end - back)
        else:
            more.add(label)
    well, permissive = False, None
    if tags:
        spans = [m.span() for m in WORD.finditer(low)]
        word = before = 0
        for at in tags:
            word, before = word + line.count(" ", before, at), at
            tag = BEHIND_TAG.match(low, spans[word + 2][1])
            # The words are joined as in the tag, and a colon follows.
            if not tag or low[spans[word][0] : spans[word + 2][1]] != TAG:
                continue
            postfix, good, length = parse_expression(tag[1])
            labels, known, free = evaluate(postfix)
            if labels:
                expressions.append(tag[1][:length].strip())
                more |= labels
                well |= good and known
                permissive = free and permissive is not False
    first = last = None
    if starts:
        first, last = (line.count(" ", 0, at) for at in (min(starts), max(starts)))
    # A tag that parses is certain; each different phrase adds evidence, and a lone phrase is likely.
    evidence = len(starts) + 2 * len(more - base)
    score = 1.0 if well else 1.0 - 0.5**evidence if evidence else 0.0
    named = ",".join(sorted(base)), ",".join(sorted(base | more))
    return len(words), len(starts), first, last, *named, score, permissive, expressions


SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("permissive", pa.bool_()),
        ("expressions", pa.list_(pa.string())),
    ]
)
SCANNED_SQL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, permissive boolean, expressions array<string>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence evidence of every whole text, one row per input row.

    ``n_base`` counts all places where a base phrase's words stand consecutively, ``first_word`` and
    ``last_word`` are the smallest and largest such place (null: none); ``labels`` adds to the base labels
    those of further notice phrases and of the known identifiers in expressions after tags; ``expressions`` holds
    these that name one, ``permissive`` says whether permissive licences meet all of them (null: there is none). A null or empty text has no words, no labels and score 0. No shuffle; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*map(scan, batch.column("text").to_pylist())))
        return dict(zip(SCANNED.names, [batch.column("doc_id"), *(rows or [[]] * 9)]))

    return slim(docs, id_col, text_col).mapInArrow(map_batches(run, SCANNED), SCANNED_SQL)

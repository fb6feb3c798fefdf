"""Scalar text functions: Column in, Column out, all built from native Spark
expressions (no Python UDF), so they stay inside whole-stage codegen.

Semantics follow Python's ``str`` methods where the evaluation harness uses
them (``strip``, ``split``, ``lower``); regex digit classes are ASCII
(``[0-9]``), which is what Spark (Java) and DuckDB (RE2) agree on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The characters Python's ``str.isspace()`` treats as
# whitespace (what ``str.strip()`` / ``str.split()`` remove), as code points.
# ---------------------------------------------------------------------------
PY_WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)

# The same set as a regex character class, written with \x{..} escapes that
# both Java regex and RE2 understand.
WS_CLASS = "[" + "".join(
    "\\x{%X}" % c for c in PY_WHITESPACE_CODEPOINTS) + "]"
NON_WS_CLASS = "[^" + WS_CLASS[1:]

# ---------------------------------------------------------------------------
# Patterns of the evaluation harness.
# ---------------------------------------------------------------------------
# A number: optional minus, a digit, digits or commas, optional dot, digits.
NUMBER_PATTERN = r"-?[0-9][0-9,]*\.?[0-9]*"
# The answer anchor: "####", optional whitespace, then a number (group 1).
ANCHOR_PATTERN = "####" + WS_CLASS + "*(" + NUMBER_PATTERN + ")"
# Chain-of-thought markers, case-insensitive, not word-anchored.
COT_PATTERN = "(?iu)(step" + WS_CLASS + r"*[0-9]|first,|then,|next,|\n[0-9]\.)"
# Chat-template leakage markers, searched in the lower-cased text.
COLLAPSE_MARKERS = ("user\n", "assistant\n", "<|im_start|>", "<|im_end|>")
# Sentence terminators for sentence counting.
SENTENCE_SPLIT = "[.!?]"
# Punctuation removed from both ends of a word before the first-letter test.
WORD_EDGE_PUNCT = ".,!?\"'"
# Lines shorter than this (after stripping) are ignored by the repetition test.
REPETITION_MIN_LINE = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# E1 -------------------------------------------------------------------------
def py_strip(x) -> Column:
    """Python ``str.strip()``: remove all whitespace (not only spaces) from
    both ends. Spark's one-argument ``trim`` removes only spaces."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def _nonblank(s: Column) -> Column:
    return s.rlike(NON_WS_CLASS)


# E2 -------------------------------------------------------------------------
def repetition_lines(x) -> Column:
    """Lines (split on newline) whose stripped length exceeds 3, stripped
    and lower-cased."""
    stripped = F.transform(F.split(_c(x), "\n"), py_strip)
    kept = F.filter(stripped, lambda l: F.length(l) > REPETITION_MIN_LINE)
    return F.transform(kept, F.lower)


def has_repetition(x) -> Column:
    """True when two such lines are equal (M1: distinct within an array)."""
    ls = repetition_lines(x)
    return F.size(ls) != F.size(F.array_distinct(ls))


# E3 -------------------------------------------------------------------------
def has_chat_collapse(x) -> Column:
    low = F.lower(_c(x))
    cond = None
    for m in COLLAPSE_MARKERS:
        t = low.contains(m)
        cond = t if cond is None else (cond | t)
    return cond


# E4 -------------------------------------------------------------------------
def final_number(x) -> Column:
    """First ``#### n`` (commas removed); else the last number in the
    comma-free text; else null. A trailing dot stays ("4.")."""
    x = _c(x)
    anchored = F.nullif(F.replace(F.regexp_extract(x, ANCHOR_PATTERN, 1),
                                  F.lit(","), F.lit("")), F.lit(""))
    fallback = F.try_element_at(
        F.regexp_extract_all(F.replace(x, F.lit(","), F.lit("")),
                             F.lit(NUMBER_PATTERN), 0),
        F.lit(-1))
    return F.coalesce(anchored, fallback)


# E5 -------------------------------------------------------------------------
def gold_answer(x) -> Column:
    """Text after the last ``####`` of a left-to-right, non-overlapping split
    (as ``str.split``; in ``#####`` the cut is after the first four),
    stripped, commas removed."""
    tail = F.element_at(F.split(_c(x), "####"), -1)
    return F.replace(py_strip(tail), F.lit(","), F.lit(""))


# E6 -------------------------------------------------------------------------
def is_exact(pred, gold) -> Column:
    """String equality; a null prediction is wrong."""
    return F.coalesce(_c(pred) == _c(gold), F.lit(False))


# E7 -------------------------------------------------------------------------
def has_cot_marker(x) -> Column:
    return _c(x).rlike(COT_PATTERN)


def has_cot(x) -> Column:
    """Chain-of-thought marker present and no repeated lines."""
    return has_cot_marker(x) & ~has_repetition(x)


# E8 -------------------------------------------------------------------------
def n_sentences(x) -> Column:
    parts = F.split(py_strip(_c(x)), SENTENCE_SPLIT)
    return F.size(F.filter(parts, _nonblank))


# E9 -------------------------------------------------------------------------
def n_lines(x) -> Column:
    return F.size(F.filter(F.split(_c(x), "\n"), _nonblank))


# E10 ------------------------------------------------------------------------
def words(x) -> Column:
    """Python ``str.split()``: whitespace runs, empty pieces dropped."""
    return F.filter(F.split(_c(x), WS_CLASS + "+"), lambda w: w != "")


def n_words(x) -> Column:
    return F.size(words(x))


# E11 / E12 ------------------------------------------------------------------
def contains_any(x, needles: Iterable[str]) -> Column:
    x = _c(x)
    out = None
    for n in needles:
        t = x.contains(n)
        out = t if out is None else (out | t)
    return out if out is not None else F.lit(False)


def contains_all(x, needles: Iterable[str]) -> Column:
    x = _c(x)
    out = None
    for n in needles:
        t = x.contains(n)
        out = t if out is None else (out & t)
    return out if out is not None else F.lit(True)


def contains_none(x, needles: Iterable[str]) -> Column:
    return ~contains_any(x, needles)


def contains_exact(x, needle: str) -> Column:
    """Case-sensitive substring test on the raw text."""
    return _c(x).contains(needle)


# E13 ------------------------------------------------------------------------
def all_words_start(x, letter: str = "s", min_words: int = 3) -> Column:
    """At least ``min_words`` words and every word, with ``.,!?"'`` removed
    from both ends, starts with ``letter``."""
    ws = F.transform(words(x), lambda w: F.btrim(w, F.lit(WORD_EDGE_PUNCT)))
    return (F.size(ws) >= min_words) & F.forall(
        ws, lambda w: F.startswith(w, F.lit(letter)))


# E14 ------------------------------------------------------------------------
def min_len(x, n: int = 20) -> Column:
    return F.length(_c(x)) > n


# E15 ------------------------------------------------------------------------
# Defaults applied to a parsed verdict.
DEFAULT_WINNER = "Tie"
DEFAULT_REASON = "No reason provided."


# What closes the array around a verdict text; see ``parse_verdict``.
_CLOSING = "end-of-verdict"
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def parse_verdict(raw) -> Column:
    """Struct ``(ok, winner, reason)``; winner/reason default when absent,
    null when the text is not one JSON object (what ``json.loads`` accepts and
    ``.get`` can read). Of a repeated key the last counts.

    The parser stops behind the first value, so the text is read as the first
    of two elements of an array: text behind the object either breaks the
    array or changes its length. Only then are the fields taken."""
    s = py_strip(_c(raw))
    wrapped = F.concat(F.lit("["), s, F.lit(f',"{_CLOSING}"]'))
    parts = F.from_json(wrapped, "array<string>", _JSON)
    whole = F.coalesce(s.startswith("{") & s.endswith("}") & (F.size(parts) == 2)
                       & (F.try_element_at(parts, F.lit(2)) == _CLOSING), F.lit(False))
    fields = F.from_json(s, "winner string, reason string", _JSON)
    return F.struct(whole.alias("ok"),
                    F.when(whole, F.coalesce(fields["winner"], F.lit(DEFAULT_WINNER))).alias("winner"),
                    F.when(whole, F.coalesce(fields["reason"], F.lit(DEFAULT_REASON))).alias("reason"))


# D5 -------------------------------------------------------------------------
# Fixed value: instruction appended to every maths question.
QA_SUFFIX = "\nSolve step by step and give the final numeric answer."


def qa_prompt(question) -> Column:
    return F.concat(_c(question), F.lit(QA_SUFFIX))

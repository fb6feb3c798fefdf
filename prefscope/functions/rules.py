"""Rule engine (F1, F2): instruction-following verdicts from rule data.

A rule is ``(trigger, test)``. The first rule whose trigger is a substring of
the lower-cased prompt decides; no matching rule means "not correct". Tests
are small tuples, compiled into one ordered ``CASE WHEN`` so that all rules
stay in a single projection (no join on ``contains``, which would be a
nested-loop join).

Test forms (``low`` = lower-cased, stripped response; ``raw`` = response):
  ("any", words)        some word is a substring of low
  ("all", words)        every word is a substring of low
  ("none", words)       no word is a substring of low
  ("exact", s)          s is a case-sensitive substring of raw
  ("len_gt", n)         length(low) > n
  ("sentences", n)      exactly n non-blank pieces of strip(raw) split on .!?
  ("lines_ge", n)       at least n non-blank lines in raw
  ("words", n)          exactly n whitespace-separated words in raw
  ("all_start", c, n)   at least n words of low, each starting with c after
                        removing .,!?"' from both ends
  ("and", t1, t2, ..)   all hold
  ("or", t1, t2, ..)    some holds
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefscope.functions import text as T

# ---------------------------------------------------------------------------
# The 25 instruction prompts of the evaluation suite, in order.
# ---------------------------------------------------------------------------
INSTRUCTION_PROMPTS = (
    "List three benefits of regular exercise.",
    "Translate 'good morning' into French.",
    "Write a one-sentence summary of what photosynthesis is.",
    "Give me two synonyms for 'happy'.",
    "Explain what a variable is in programming, in one sentence.",
    "Name the capital of Japan.",
    "Convert 10 kilometers to miles.",
    "Write a short greeting for a birthday card.",
    "What is the boiling point of water in Celsius?",
    "Give a one-line definition of gravity.",
    "Answer the following question in exactly two sentences: What is the main cause of ocean tides?",
    "List exactly 4 items you would need to build a wooden birdhouse, no more and no less.",
    "Explain the concept of inflation to a 5-year-old in one paragraph of exactly three sentences.",
    "Respond ONLY with a JSON object containing the keys 'capital' and 'population' for the country France.",
    "Write a haiku about artificial intelligence.",
    "Give me a list of three distinct colors, but do not include the color blue or red.",
    "Tell me the name of the largest ocean on Earth, and write it in all capital letters.",
    "Provide two antonyms for the word 'cold', separated by a semicolon.",
    "In exactly five words, describe what a book is.",
    "What is the result of 15 multiplied by 4, plus 12? Provide only the final number.",
    "List three different programming languages that are statically typed.",
    "Write a short sentence where every word starts with the letter 'S'.",
    "Who wrote the play Romeo and Juliet? Answer with only the author's name.",
    "What are the three physical states of matter? List them separated by commas.",
    "State the name of the chemical symbol for Gold in exactly one word.",
)

# ---------------------------------------------------------------------------
# The 25 rules (trigger in the lower prompt -> test), in the
# order they are tried.
# ---------------------------------------------------------------------------
INSTRUCTION_RULES = (
    ("exercise", ("and", ("any", ("benefit", "health", "weight", "heart", "cardio", "mental", "sleep", "energy")), ("len_gt", 20))),
    ("french", ("any", ("bonjour",))),
    ("photosynthesis", ("or", ("any", ("photosynthesis",)), ("all", ("plant", "light")))),
    ("synonyms for 'happy'", ("any", ("joyful", "content", "cheerful", "glad", "delighted", "pleased", "merry", "elated"))),
    ("variable", ("any", ("variable", "container", "value"))),
    ("japan", ("any", ("tokyo",))),
    ("kilometers", ("any", ("6.2", "6"))),
    ("birthday", ("any", ("birthday", "happy", "greet", "wish"))),
    ("boiling point", ("any", ("100",))),
    ("gravity", ("any", ("force", "attract", "gravity"))),
    ("ocean tides", ("and", ("sentences", 2), ("any", ("moon", "gravit", "tide", "pull")))),
    ("birdhouse", ("and", ("any", ("wood", "nail", "screw", "glue", "hammer", "saw", "paint")), ("any", ("1", "2", "3", "4", "-", "\n")))),
    ("inflation", ("and", ("sentences", 3), ("any", ("price", "money", "buy", "rise", "cost")))),
    ("json", ("all", ("capital", "population", "paris"))),
    ("haiku", ("and", ("lines_ge", 2), ("any", ("ai", "mind", "computer", "machine", "think", "code")))),
    ("distinct colors", ("and", ("none", ("blue", "red")), ("any", ("green", "yellow", "orange", "purple", "black", "white", "pink", "brown")))),
    ("largest ocean", ("exact", "PACIFIC")),
    ("antonyms for the word 'cold'", ("and", ("exact", ";"), ("any", ("hot", "warm", "heat")))),
    ("five words", ("and", ("words", 5), ("any", ("book", "read", "page", "story", "paper")))),
    ("15 multiplied by 4", ("any", ("72",))),
    ("statically typed", ("any", ("java", "c++", "c#", "rust", "go", "typescript", "swift", "kotlin", "scala"))),
    ("starts with the letter 's'", ("all_start", "s", 3)),
    ("romeo and juliet", ("any", ("shakespeare",))),
    ("states of matter", ("all", ("solid", "liquid", "gas"))),
    ("symbol for gold", ("any", ("au",))),
)


def test_column(spec, raw: Column, low: Column) -> Column:
    """Compile one test spec into a boolean Column."""
    kind = spec[0]
    if kind == "any":
        return T.contains_any(low, spec[1])
    if kind == "all":
        return T.contains_all(low, spec[1])
    if kind == "none":
        return T.contains_none(low, spec[1])
    if kind == "exact":
        return T.contains_exact(raw, spec[1])
    if kind == "len_gt":
        return F.length(low) > spec[1]
    if kind == "sentences":
        return T.n_sentences(raw) == spec[1]
    if kind == "lines_ge":
        return T.n_lines(raw) >= spec[1]
    if kind == "words":
        return T.n_words(raw) == spec[1]
    if kind == "all_start":
        return T.all_words_start(low, spec[1], spec[2])
    if kind in ("and", "or"):
        parts = [test_column(s, raw, low) for s in spec[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if kind == "and" else (out | p)
        return out
    raise ValueError(f"unknown rule test {kind!r}")


def rule_number(prompt, rules=INSTRUCTION_RULES) -> Column:
    """Index of the first rule whose trigger occurs in the lower prompt; null
    when none does. It depends on the prompt alone, so it is worked out on the
    prompt suite (a few rows) and joined to the responses with the prompt."""
    p = F.lower(F.col(prompt) if isinstance(prompt, str) else prompt)
    return F.coalesce(*[F.when(p.contains(trigger), F.lit(i)) for i, (trigger, _) in enumerate(rules)])


def verdict_by_number(number, raw: Column, low: Column, rules=INSTRUCTION_RULES) -> Column:
    """F1 for a known rule: the test of rule ``number`` on the response and on
    its lower-cased, stripped form; false when there is no rule."""
    n = F.col(number) if isinstance(number, str) else number
    out = None
    for i, (_, spec) in enumerate(rules):
        val = F.coalesce(test_column(spec, raw, low), F.lit(False))
        out = F.when(n == i, val) if out is None else out.when(n == i, val)
    return out.otherwise(F.lit(False))


def rule_verdict(prompt, response, rules=INSTRUCTION_RULES) -> Column:
    """verdict of the first rule whose trigger occurs in the lower
    prompt; false when none does. A null response counts as empty text."""
    raw = F.coalesce(F.col(response) if isinstance(response, str) else response,
                     F.lit(""))
    return verdict_by_number(rule_number(prompt, rules), raw, T.py_strip(F.lower(raw)), rules)


def with_rule_verdict(df: DataFrame, number: str = "rule_number", response: str = "response",
                      out: str = "correct", rules=INSTRUCTION_RULES) -> DataFrame:
    """F1 on a table whose rows know their rule: the lowered response is
    staged once, the dispatch compares a number."""
    staged = df.withColumn("_raw", F.coalesce(response, F.lit(""))).withColumn(
        "_low", T.py_strip(F.lower("_raw")))
    return staged.withColumn(out, verdict_by_number(number, F.col("_raw"), F.col("_low"), rules)).drop(
        "_raw", "_low")


def instruction_ok(prompt, response, rules=INSTRUCTION_RULES) -> Column:
    """rule verdict and no chat-template collapse and no repeated lines."""
    raw = F.coalesce(F.col(response) if isinstance(response, str) else response,
                     F.lit(""))
    return (rule_verdict(prompt, raw, rules) & ~T.has_chat_collapse(raw)
            & ~T.has_repetition(raw))

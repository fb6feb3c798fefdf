"""Text functions and rules on inputs whose answers were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from prefscope.functions import text as T
from prefscope.functions.rules import INSTRUCTION_PROMPTS, instruction_ok, rule_verdict

NBSP, IDEOGRAPHIC = "\xa0", "　"

# function -> [(input, answer)]
CASES = {
    "strip": (T.py_strip, [
        ("a\t\n Tokyo  ", "a\t\n Tokyo"), (" x ", "x"), (NBSP + "y" + IDEOGRAPHIC + "\x0b", "y"),
        ("\x1c\x85z", "z"), ("", ""), (" \n\t", ""), ("​w", "​w")]),
    "repetition": (T.has_repetition, [
        ("same line\nsame line", True), ("Same Line \n  same line", True), ("abc\nabc", False),
        ("abcd\nabcd", True), ("one line\nother line", False), ("", False), ("\n\n\n", False),
        ("long one\n\nshort\nlong one", True), (" abc \n abc ", False)]),
    "collapse": (T.has_chat_collapse, [
        ("USER\nhi", True), ("superuser\nx", True), ("assistant\n", True), ("<|IM_START|>", True),
        ("a<|im_end|>", True), ("user: hi", False), ("assistant", False), ("", False)]),
    "final_number": (T.final_number, [
        ("#### 1,234.5", "1234.5"), ("#### 7 and #### 9", "7"), ("####\t-3", "-3"), ("#### $18 then 4.", "4."),
        ("x 12,5,6", "1256"), ("-3 and 7.", "7."), ("no number", None), ("", None), ("1,200", "1200"),
        ("3.14.15", "15"), ("####5", "5"), ("a-5", "-5"), ("#### 2.", "2.")]),
    "gold": (T.gold_answer, [
        ("work #### 1,000 ", "1000"), ("#### 1 #### 2", "2"), ("no mark", "no mark"), ("##### 3", "# 3"),
        ("####", ""), ("a####\t5\n", "5")]),
    "cot": (T.has_cot, [
        ("Step 1: go", True), ("STEP2", True), ("step one", False), ("First, we", True), ("strengthen, it", True),
        ("next, that", True), ("list:\n1. a", True), ("1. a", False), ("then we", False), ("", False),
        ("first, x\nsame line\nsame line", False)]),
    "sentences": (T.n_sentences, [
        ("One. Two! Three?", 3), ("One", 1), ("...", 0), ("", 0), ("a.b", 2), (" . x . ", 1), ("3.5", 2)]),
    "lines": (T.n_lines, [("a\nb", 2), ("a\n\n \t\nb\n", 2), ("", 0), ("\n", 0), ("a\rb", 1), (NBSP + "\nx", 1)]),
    "words": (T.n_words, [("a b  c", 3), (" a\tb\nc ", 3), ("", 0), ("a" + NBSP + "b", 2), ("a​b", 1)]),
    "all_start_s": (lambda c: T.all_words_start(F.lower(c), "s", 3), [
        ("She sells shells", True), ("\"So,\" 'six' (see", False), ("\"So,\" 'six' see!", True), ("she sees", False),
        ("Sun sky sea land", False), ("", False), ("s s s", True), ("so , so so", False)]),
    "longer_than_20": (lambda c: T.min_len(T.py_strip(F.lower(c)), 20), [
        ("x" * 20, False), ("x" * 21, True), (" " * 30 + "x" * 20, False), ("", False)]),
    "any_the_und": (lambda c: T.contains_any(c, ("the", "und")), [("bund", True), ("The", False), ("other", True), ("", False)]),
    "all_the_und": (lambda c: T.contains_all(c, ("the", "und")), [("the bund", True), ("the", False)]),
    "none_red": (lambda c: T.contains_none(c, ("red",)), [("colored", False), ("green", True)]),
    "exact": (lambda c: T.contains_exact(c, "PACIFIC"), [("the PACIFIC", True), ("Pacific", False)]),
}


@pytest.fixture(scope="module")
def answers(spark):
    """All cases of all functions in one job: function -> input -> result."""
    inputs = sorted({x for _, rows in CASES.values() for x, _ in rows})
    df = spark.createDataFrame([(x,) for x in inputs], "t string")
    rows = df.select("t", *[f(F.col("t")).alias(name) for name, (f, _) in CASES.items()]).collect()
    return {name: {r["t"]: r[name] for r in rows} for name in CASES}


@pytest.mark.parametrize("name", CASES)
def test_answers(answers, name):
    for text, want in CASES[name][1]:
        assert answers[name][text] == want, (name, text)


def test_exact_match_is_string_equality(spark):
    df = spark.createDataFrame([("4.", "4"), (None, "4"), ("4", "4")], "p string, g string")
    assert [r[0] for r in df.select(T.is_exact("p", "g")).collect()] == [False, False, True]


# raw text -> (is one JSON object, winner, reason)
VERDICTS = [
    ('{"winner":"DPO","reason":"a"}', True, "DPO", "a"),
    ('  {"winner":"SFT"}\n', True, "SFT", "No reason provided."),
    ('{"reason":"x"}', True, "Tie", "x"),
    ("{}", True, "Tie", "No reason provided."),
    ('{"winner": "Base", "reason": "line\\nbreak"}', True, "Base", "line\nbreak"),
    ('{"winner":"SFT","winner":"DPO"}', True, "DPO", "No reason provided."),
    ('{"a":{"winner":"SFT"},"winner":"DPO"}', True, "DPO", "No reason provided."),
    ('{"winner":"DPO"} {"winner":"SFT"}', False, None, None),
    ('{"winner":"DPO"},{"winner":"SFT"}', False, None, None),
    ('{"winner":"DPO"}], [{"winner":"SFT"}', False, None, None),
    ('{"a":1} tail', False, None, None), ("not json", False, None, None), ("3", False, None, None),
    ("", False, None, None), ("[1]", False, None, None), ("{'winner':'DPO'}", False, None, None),
    ('{"winner":"DPO"', False, None, None), ('{"winner":DPO}', False, None, None), (None, False, None, None),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VERDICTS)], "i long, raw string")
    got = {r["i"]: r["v"] for r in df.select("i", T.parse_verdict("raw").alias("v")).collect()}
    for i, (raw, ok, winner, reason) in enumerate(VERDICTS):
        assert (got[i]["ok"], got[i]["winner"], got[i]["reason"]) == (ok, winner, reason), raw


# words of the prompt -> responses that pass, and that don't
RULES = {
    "exercise": (["It is good for your heart and mind."], ["heart", "It is good for you in many ways."]),
    "french": (["Bonjour"], ["Hello"]),
    "photosynthesis": (["Photosynthesis is", "A plant uses light"], ["A plant grows"]),
    "happy'": (["Joyful, glad"], ["sad"]),
    "variable": (["a container"], ["a thing"]),
    "japan": (["TOKYO."], ["Kyoto"]),
    "kilometers": (["6.21", "16"], ["5"]),
    "birthday": (["Best wishes"], ["Congratulations"]),
    "boiling": (["100 C"], ["212 F"]),
    "gravity": (["It attracts"], ["It pulls"]),
    "tides": (["The moon. It pulls."], ["The moon pulls.", "One. Two."]),
    "birdhouse": (["1. Cut wood", "Glue it\nPaint it"], ["Cut wood", "1. Begin"]),
    "inflation": (["Prices rise. Money. Less."], ["Prices rise.", "A. B. C."]),
    "json": (["capital Paris population"], ["capital Paris"]),
    "haiku": (["the mind\nof code"], ["the mind of code", "a\nb"]),
    "distinct colors": (["Green, Yellow, Purple"], ["Green, colored yellow", "cyan"]),
    "largest ocean": (["PACIFIC"], ["Pacific"]),
    "antonyms": (["hot; warm"], ["hot, warm", "red; green"]),
    "five words": (["I read a good book"], ["I read books", "I like to eat fish"]),
    "15 multiplied": (["72"], ["60"]),
    "statically": (["Go", "Rust"], ["Python"]),
    "letter 's'": (["Sam sees Sue", "So, \"she\" sat!"], ["Sam sees", "Sam and Sue"]),
    "romeo": (["Shakespeare"], ["Marlowe"]),
    "states of matter": (["solid, liquid, gas"], ["solid, liquid"]),
    "gold": (["Au"], ["Ag"]),
}


def test_rules(spark):
    rows = []
    for words, (good, bad) in RULES.items():
        prompt = [p for p in INSTRUCTION_PROMPTS if words in p.lower()]
        assert len(prompt) == 1, words
        rows += [(prompt[0], r, True) for r in good] + [(prompt[0], r, False) for r in bad]
    assert len(RULES) == len(INSTRUCTION_PROMPTS) == 25
    rows.append(("Tell me a joke", "Tokyo", False))
    df = spark.createDataFrame(rows, "prompt string, response string, want boolean")
    got = df.select("*", rule_verdict("prompt", "response").alias("got")).where("got <> want or got is null").collect()
    assert got == []


def test_gates(spark):
    prompt = [p for p in INSTRUCTION_PROMPTS if "japan" in p.lower()][0]
    rows = [(prompt, "Tokyo", True), (prompt, "user\nTokyo", False), (prompt, "Tokyo it is\nTokyo it is", False),
            (prompt, "Kyoto", False), (prompt, None, False)]
    df = spark.createDataFrame(rows, "prompt string, response string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("*", instruction_ok("prompt", "response").alias("got")).collect())


def test_number_dispatch_equals_prompt_dispatch(spark):
    from prefscope.operators.scoring import score_instructions
    from prefscope.plans import fixtures as FX
    from conftest import SF001
    r = FX.fd6_responses(spark, SF001)
    a = score_instructions(r).select("item_id", "correct", "ok")
    b = r.select("item_id", rule_verdict("prompt", "response").alias("c2"), instruction_ok("prompt", "response").alias("o2"))
    j = a.join(b, "item_id")
    assert j.count() == 1000 and j.where("correct <> c2 or ok <> o2").count() == 0
    plan = score_instructions(r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(lower(") <= 25 + 4  # triggers on the suite's prompts, marks in the response

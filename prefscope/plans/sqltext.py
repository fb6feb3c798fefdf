"""DuckDB SQL spellings of the text functions, used to write the oracles.

Each helper returns a SQL expression string for a SQL expression argument.
Rules that keep the engines equal: ``chr(10)`` for newline, ``||`` for
concatenation, explicit whitespace sets, ASCII digit classes. Words, patterns
and marks are written out here, independently of the operators.
"""

from __future__ import annotations

# Whitespace: the control characters, spaces and separators of Unicode that
# Python's str.isspace() is true for.
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "(" + "||".join(f"chr({c})" for c in SPACES) + ")"
WS_CHARS = "".join("\\x{%X}" % c for c in SPACES)
NL = "chr(10)"
NUMBER = r"-?[0-9][0-9,]*\.?[0-9]*"


def lit(s: str) -> str:
    """A SQL string expression for any Python string (newlines via chr)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def nonblank(x: str) -> str:
    return f"regexp_matches({x}, {rx('[^' + WS_CHARS + ']')})"


def repetition_lines(x: str) -> str:
    return (f"list_transform(list_filter(string_split({x}, {NL}), "
            f"lambda l: length({strip('l')}) > 3), lambda l: lower({strip('l')}))")


def has_repetition(x: str) -> str:
    ls = repetition_lines(x)
    return f"(len({ls}) <> len(list_distinct({ls})))"


def has_chat_collapse(x: str) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {lit(m)})" for m in ("user\n", "assistant\n", "<|im_start|>", "<|im_end|>")) + ")"


def final_number(x: str) -> str:
    anchored = f"nullif(replace(regexp_extract({x}, {rx('####[' + WS_CHARS + ']*(' + NUMBER + ')')}, 1), ',', ''), '')"
    fallback = f"regexp_extract_all(replace({x}, ',', ''), {rx(NUMBER)})[-1]"
    return f"coalesce({anchored}, {fallback})"


def gold_answer(x: str) -> str:
    return f"replace({strip(f'string_split({x}, {lit(chr(35) * 4)})[-1]')}, ',', '')"


def is_exact(pred: str, gold: str) -> str:
    return f"coalesce({pred} = {gold}, false)"


COT_RE2 = "(?i)(step[" + WS_CHARS + r"]*[0-9]|first,|then,|next,|\n[0-9]\.)"


def has_cot_marker(x: str) -> str:
    return f"regexp_matches({x}, {rx(COT_RE2)})"


def has_cot(x: str) -> str:
    return f"({has_cot_marker(x)} and not {has_repetition(x)})"


def n_sentences(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({strip(x)}, '[.!?]'), lambda s: {nonblank('s')}))"


def n_lines(x: str) -> str:
    return f"len(list_filter(string_split({x}, {NL}), lambda l: {nonblank('l')}))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {rx('[' + WS_CHARS + ']+')}), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def contains_any(x: str, needles) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def contains_all(x: str, needles) -> str:
    return "(" + " and ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def contains_none(x: str, needles) -> str:
    return f"(not {contains_any(x, needles)})"


EDGE = ".,!?\"'"


def all_words_start(x: str, letter: str, min_words: int) -> str:
    ws = f"list_transform({words(x)}, lambda w: trim(w, {lit(EDGE)}))"
    return (f"(len({ws}) >= {min_words} and "
            f"coalesce(list_bool_and(list_transform({ws}, lambda w: starts_with(w, {lit(letter)}))), true))")


def _any(*words: str) -> str:
    return contains_any("@low", words)


def _all(*words: str) -> str:
    return contains_all("@low", words)


# The 25 rules: trigger, test on @raw (the response) and @low (stripped, lower).
RULES = [
    ("exercise", f"{_any('benefit', 'health', 'weight', 'heart', 'cardio', 'mental', 'sleep', 'energy')} and length(@low) > 20"),
    ("french", _any("bonjour")),
    ("photosynthesis", f"{_any('photosynthesis')} or {_all('plant', 'light')}"),
    ("synonyms for 'happy'", _any("joyful", "content", "cheerful", "glad", "delighted", "pleased", "merry", "elated")),
    ("variable", _any("variable", "container", "value")),
    ("japan", _any("tokyo")),
    ("kilometers", _any("6.2", "6")),
    ("birthday", _any("birthday", "happy", "greet", "wish")),
    ("boiling point", _any("100")),
    ("gravity", _any("force", "attract", "gravity")),
    ("ocean tides", f"{n_sentences('@raw')} = 2 and {_any('moon', 'gravit', 'tide', 'pull')}"),
    ("birdhouse", _any("wood", "nail", "screw", "glue", "hammer", "saw", "paint") + " and "
     + _any("1", "2", "3", "4", "-", "\n")),
    ("inflation", f"{n_sentences('@raw')} = 3 and {_any('price', 'money', 'buy', 'rise', 'cost')}"),
    ("json", _all("capital", "population", "paris")),
    ("haiku", f"{n_lines('@raw')} >= 2 and {_any('ai', 'mind', 'computer', 'machine', 'think', 'code')}"),
    ("distinct colors", f"not {_any('blue', 'red')} and "
     + _any("green", "yellow", "orange", "purple", "black", "white", "pink", "brown")),
    ("largest ocean", "contains(@raw, 'PACIFIC')"),
    ("antonyms for the word 'cold'", f"contains(@raw, ';') and {_any('hot', 'warm', 'heat')}"),
    ("five words", f"{n_words('@raw')} = 5 and {_any('book', 'read', 'page', 'story', 'paper')}"),
    ("15 multiplied by 4", _any("72")),
    ("statically typed", _any("java", "c++", "c#", "rust", "go", "typescript", "swift", "kotlin", "scala")),
    ("starts with the letter 's'", all_words_start("@low", "s", 3)),
    ("romeo and juliet", _any("shakespeare")),
    ("states of matter", _all("solid", "liquid", "gas")),
    ("symbol for gold", _any("au")),
]


def rule_verdict(prompt: str, response: str) -> str:
    raw = f"coalesce({response}, '')"
    branches = " ".join(f"when contains(lower({prompt}), {lit(t)}) then coalesce({test}, false)" for t, test in RULES)
    return f"(case {branches} else false end)".replace("@raw", raw).replace("@low", strip(f"lower({raw})"))


def instruction_ok(prompt: str, response: str) -> str:
    raw = f"coalesce({response}, '')"
    return (f"({rule_verdict(prompt, raw)} and not {has_chat_collapse(raw)} "
            f"and not {has_repetition(raw)})")


def chatml_piece(role: str, content: str) -> str:
    return f"'<|im_start|>' || coalesce({role}, '') || {NL} || coalesce({content}, '') || '<|im_end|>' || {NL}"


CHAT_TAIL = lit("<|im_start|>assistant\n")

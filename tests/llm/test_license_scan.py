"""Licence recognition on full texts, references and text around them."""

import textwrap

from prefscope.llm import license_scan as L
from test_basic_ops import empty, table

MIT = ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]
BSD3 = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]
APACHE = ["apache-grant", "apache-may-not", "apache-obtain", "apache-url", "apache-unless", "apache-see"]


def full(ids, width=70, comment=""):
    text = " ".join("\n" + L.SENTENCES[i] + "\n" if i == "apache-url" else L.SENTENCES[i] for i in ids)
    blocks = ["\n".join(textwrap.wrap(block, width)) for block in text.split("\n")]
    return "\n".join((comment + line).rstrip() for line in "\n\n".join(blocks).split("\n"))


CASES = [
    (full(MIT), MIT, ["MIT"], []),
    ("The MIT License (MIT)\n\nCopyright (c) 2020 A. N. Author\n\n" + full(MIT, 40), ["mit-title", *MIT], ["MIT"], []),
    ("Some project without a full stop\n" + full(BSD3, 60, "# "), BSD3, ["BSD-3-Clause"], []),
    (full(BSD3[:3] + BSD3[4:]), BSD3[:3] + BSD3[4:], ["BSD-2-Clause"], []),
    (full(APACHE, 72, "    "), APACHE, ["Apache-2.0"], []),
    (full(["gpl-free", "gpl-terms-3", "gpl-hope", "gpl-implied", "gpl-see"]), ["gpl-free", "gpl-terms-3", "gpl-hope", "gpl-implied", "gpl-see"],
     ["GPL-3.0-or-later"], []),
    (full(["gpl-free", "gpl-terms", "gpl-later-2"]), ["gpl-free", "gpl-terms", "gpl-later-2"], ["GPL-2.0-or-later"], []),
    ("Text.\nReleased under the MIT License.\nMore text.", ["ref-mit"], ["MIT"], []),
    ("no stop before\nLicensed under CC BY-NC 4.0.\n", ["ref-cc-by-nc"], ["CC-BY-NC-4.0"], []),
    ("// SPDX-License-Identifier: Apache-2.0 */ int main() { return 0; }", ["spdx-apache"], ["Apache-2.0"], []),
    ("RELEASED   under the\n\tMIT license!  Released under the MIT License.", ["ref-mit", "ref-mit"], ["MIT"], []),
    (full(["mit-notice"]) + "\n\n" + full(APACHE), ["mit-notice", *APACHE], ["Apache-2.0"], ["mit-notice"]),
    (full(APACHE) + "\n" + full(MIT), [*APACHE, *MIT], ["MIT", "Apache-2.0"], []),
    ("Not released under the MIT License at all.", [], [], []),
    ("Unlicensed under the MIT License.", [], [], []),
    ("x " * 60_000 + ". All rights reserved.", ["reserved"], ["All-Rights-Reserved"], []),
    ("nothing here", [], [], []), ("", [], [], []), (None, [], [], []),
]


def test_scan(spark):
    rows = [(i, t, "s") for i, (t, *_) in enumerate(CASES)]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.unresolved) for r in L.scan(table(spark, rows + rows[:3])).collect()}
    for i, (_, ids, names, left) in enumerate(CASES):
        assert got[i] == (ids, names, left), i
    assert L.scan(table(spark, rows + rows[:3])).count() == len(rows) + 3
    assert L.scan(empty(spark)).collect() == []


def test_every_known_sentence_is_found_by_hint_and_rule(spark):
    import re
    assert all(re.search(L.HINT, t) for t in L.SENTENCES.values() if not t.startswith(("This program", "either", "without", "you can")))
    assert len({L.normal(t) for t in L.SENTENCES.values()}) == len(L.SENTENCES)
    named = {x.rstrip("?") for _, seq in L.RULES for x in seq.split()}
    assert named == set(L.SENTENCES)


def test_rules_take_runs_in_their_order(spark):
    rows = [(1, "a b c a b"), (2, "b c"), (3, "a c"), (4, "aa b"), (5, "")]
    rules = [("ABC", "a b c"), ("AB", "a b"), ("C", "b? c")]
    df = spark.createDataFrame(rows, "i long, s string").selectExpr("i", "filter(split(s, ' '), x -> x <> '') AS ids")
    got = {r.i: (r.x.rest, r.x.found) for r in df.select("i", L.apply_rules(df.ids, rules).alias("x")).collect()}
    assert got == {1: ("", ["ABC", "AB"]), 2: ("", ["C"]), 3: ("a,", ["C"]), 4: ("aa,b,", []), 5: ("", [])}


def test_every_known_sentence_is_found_wrapped_at_each_word(spark):
    """Each gap between two words in turn is a line end, a wider space or a
    comment sign; a mark of a sentence's end is not put inside one."""
    rows, want = [], {}
    for name, text in L.SENTENCES.items():
        words = text.split(" ")
        for i in range(1, len(words)):
            for gap in ("\n", "  ", "\n# ", "\r\n\t"):
                if not words[i - 1].endswith((".", ":", ";", "!", "?")):
                    want[len(rows)] = name
                    rows.append((len(rows), " ".join(words[:i]) + gap + " ".join(words[i:]), "s"))
    rows.append((-1, "(c) 2020 Acme. All rights\nreserved.", "s"))
    want[-1] = "reserved"
    got = {r.doc_id: list(r.sentence_ids) for r in L.scan(table(spark, rows)).collect()}
    missed = {(want[i], rows[i][1][:60]) for i in want if want[i] not in got[i]}
    assert not missed, sorted(missed)[:5]

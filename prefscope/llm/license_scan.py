"""Licence recognition by sentences.

A text is cut into sentences, each is normalised and mapped to the identifier
of the licence sentence it is (or ends with), and the sequence of identifiers
is matched against licence rules in their order: a rule takes the run of
identifiers that it matches, so a full licence text is taken before the rules
for one of its sentences alone see it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and of usual references.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-free": "This program is free software:",
    "gpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl-later-2": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "ref-mit": "Released under the MIT License.",
    "ref-mit-2": "Licensed under the MIT License.",
    "ref-apache": "Licensed under the Apache License, Version 2.0.",
    "ref-gpl3": "This work is licensed under the GNU General Public License, version 3.",
    "ref-cc-by": "Licensed under CC BY 4.0.",
    "ref-cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "ref-cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "reserved": "All rights reserved.",
}
#: Ordered rules: licence, and the identifiers that follow one another; one
#: with a question mark may be absent.
RULES = [
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is"),
    ("MIT", "mit-title? mit-grant mit-notice mit-as-is mit-liability?"),
    ("Apache-2.0", "apache-grant apache-may-not apache-obtain? apache-url? apache-unless apache-see?"),
    ("GPL-3.0-or-later", "gpl-free gpl-terms-3 gpl-hope? gpl-implied? gpl-see?"),
    ("GPL-2.0-or-later", "gpl-free gpl-terms gpl-later-2 gpl-hope? gpl-implied? gpl-see?"),
    ("CC-BY-NC-4.0", "cc-by-nc"), ("CC-BY-NC-4.0", "ref-cc-by-nc"),
    ("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-SA-4.0", "ref-cc-by-sa"),
    ("CC-BY-4.0", "cc-by"), ("CC-BY-4.0", "ref-cc-by"),
    ("Apache-2.0", "ref-apache"), ("GPL-3.0-only", "ref-gpl3"),
    ("MIT", "ref-mit"), ("MIT", "ref-mit-2"), ("MIT", "mit-title"),
    ("MIT", "spdx-mit"), ("Apache-2.0", "spdx-apache"), ("BSD-3-Clause", "spdx-bsd-3"),
    ("GPL-3.0-or-later", "spdx-gpl3-later"), ("All-Rights-Reserved", "reserved"),
]
#: A text with none of these has no known sentence; it is tried on the raw
#: text, where what stands between two words may be any noise.
HINT = (r"(?i)licen[cs]e|apache.org|permission|copyright|warrant|liab|redistribut"
        r"|free[^a-z0-9]+software|rights[^a-z0-9]+reserved")
#: Where sentences end; the mark put there; what normalising takes out.
SPDX = r"(?i)(spdx-license-identifier):[ \t]*([A-Za-z0-9.+-]+)"
END = r"([.!?;:])[ \t\n\r\f]+|\n[ \t\r\f]*\n"
MARK = "\x01"
NOISE, TAIL = r"[^a-z0-9.+\x01]+", r"[ .+]+$"


def normal(sentence: str) -> str:
    """The normal form of one sentence, as ``sentences`` makes it."""
    return re.sub(TAIL, "", re.sub(NOISE, " ", sentence.lower())).lstrip(" .+")


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order: lower case, letters, digits
    and . + only, single spaces, one in front, no punctuation at the end."""
    apart = F.regexp_replace(text, SPDX, "\n\n$1 $2\n\n")
    marked = F.regexp_replace(apart, END, f"$1{MARK}")
    parts = F.split(F.regexp_replace(F.lower(marked), NOISE, " "), MARK)
    return F.transform(parts, lambda s: F.concat(F.lit(" "), F.regexp_replace(s, TAIL, "")))


def known(sentence: Column) -> Column:
    """Identifier of the licence sentence that a normalised sentence is, or
    ends with behind words without punctuation, as a title above it; the
    longest that fits; null for others."""
    out = F.lit(None).cast("string")
    for name, text in sorted(SENTENCES.items(), key=lambda x: len(normal(x[1]))):
        out = F.when(F.endswith(sentence, F.lit(f" {normal(text)}")), F.lit(name)).otherwise(out)
    return out


def rule_pattern(sequence: str) -> str:
    """A rule as a pattern on identifiers that each end with a comma, at the
    beginning of one."""
    return r"(?<![^,])" + "".join(f"(?:{re.escape(x[:-1])},)?" if x.endswith("?") else f"{re.escape(x)},"
                              for x in sequence.split())


def apply_rules(ids: Column, rules=RULES) -> Column:
    """struct(rest, found): the rules fold over the sequence in their order;
    each takes out all runs that it matches, and names its licence once."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(seq)).alias("pattern"))
                      for name, seq in rules])

    def step(seen: Column, rule: Column) -> Column:
        left = F.regexp_replace(seen["rest"], rule["pattern"], F.lit(""))
        return F.struct(left.alias("rest"), F.when(left != seen["rest"], F.array_union(
            seen["found"], F.array(rule["name"]))).otherwise(seen["found"]).alias("found"))

    start = F.struct(F.when(F.size(ids) > 0, F.concat(F.array_join(ids, ","), F.lit(","))).otherwise(F.lit(""))
                     .alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(table, start, step)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids (licence sentences in text
    order, repeats included), licenses (in rule order, each once), unresolved
    (identifiers that no rule took).

    A null text, an empty one and one without a licence sentence have empty
    lists. Texts of any length are read whole; a row needs no other row, so
    repeated rows get equal results and nothing is shuffled. An empty table
    gives an empty result; columns besides doc_id and text are not read."""
    hinted = F.when(F.col("text").rlike(HINT), F.col("text")).otherwise(F.lit(""))
    ids = F.filter(F.transform(sentences(hinted), known), lambda x: x.isNotNull())
    rows = docs.select("doc_id", ids.alias("sentence_ids"))
    rows = rows.withColumn("_rules", F.when(F.size("sentence_ids") > 0, apply_rules(F.col("sentence_ids"))))
    return rows.select(
        "doc_id", "sentence_ids", F.coalesce("_rules.found", F.array().cast("array<string>")).alias("licenses"),
        F.filter(F.split(F.coalesce("_rules.rest", F.lit("")), ","), lambda x: x != "").alias("unresolved"))

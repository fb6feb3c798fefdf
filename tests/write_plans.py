"""Regenerate PLANS.md: physical plans of the key queries at sf0.1.

Usage: python tests/write_plans.py
"""
import os
import re
import sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from prefscope.session import local_session
import __spark_entry__ as E
spark = local_session()
q = E.queries()
notes = {
 "qa_report": "Flagship: scoring is one narrow projection; per-model partial aggregate before the only shuffle.",
 "l1_resolve_verdicts": "Verdict resolution: partial min_by per prompt before the shuffle (a hot prompt ships one row per task).",
 "f1_rule_verdict": "Rules: the rule number comes with the broadcast suite, the lowered response is staged once.",
 "i1_running_accuracy": "Running accuracy: bucket partial counts, block totals, within-block windows partitioned by (model, block); no window over a whole model.",
 "j2_seeded_sample": "Seeded sample: the wide rows up to the n-th key (found among narrow rows while the plan is built), numbered within checkpointed ranges.",
 "j5_preview": "First 10 per model: WindowGroupLimit on narrow (model, id) rows, then the rows up to each model's tenth id.",
 "c1_filter_conversations": "C1 on long rows: one partial aggregate of turns and characters per conversation (no message arrays are built to filter).",
 "k2_perplexity": "Unigram perplexity: count table broadcast behind its fitted size; per-text partial sums, then one global average.",
 "h5_identical_pct": "Identical outputs for three model pairs from one pivot (one shuffle), not three joins.",
 "g4_request_grid": "Prompt x model grid as an exploded literal array: no cartesian product.",
}
out = ["# Physical plans of key queries", "",
       "Generated with `df._jdf.queryExecution().executedPlan()` at sf0.1, local[8], AQE on (initial plans;",
       "AQE may still coalesce partitions or switch join sides at run time). Long expressions are cut.", ""]
for name, note in notes.items():
    df = q[name](spark, "/root/testdata/sf0.1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for ln in plan.splitlines():
        ln = re.sub(r"#\d+L?", "", ln)
        lines.append(ln if len(ln) <= 160 else ln[:157] + "...")
    out += [f"## {name}", "", note, "", "```", *lines, "```", ""]
open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(out))

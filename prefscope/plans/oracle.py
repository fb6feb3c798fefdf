"""DuckDB oracles: for each registered query, ANSI-style SQL over the same
parquet tables (pre-registered views), giving the same columns and types.

Words, patterns and texts that decide a result are written out here and in
``sqltext``, not taken from the operators. Only the 25 prompts, which are input
data of FD6, come from the package."""

from __future__ import annotations

from prefscope.functions.rules import INSTRUCTION_PROMPTS
from prefscope.plans import sqltext as S

IM_END = "<|im_end|>"
ERROR_REASON = "All API judge model calls failed or timed out."
DEFAULT_REASON = "No reason provided."
QA_SUFFIX = "\nSolve step by step and give the final numeric answer."
JUDGE_PROMPT = """
    You are an expert AI evaluator. Compare three responses generated by different models (Base, SFT, DPO) to the user's prompt.
    Evaluate their quality based on helpfulness, accuracy, structure, instruction following, and step-by-step reasoning quality.
    
    [USER PROMPT]:
    @prompt
    
    [BASE RESPONSE]:
    @base
    
    [SFT RESPONSE]:
    @sft
    
    [DPO RESPONSE]:
    @dpo
    
    Respond ONLY with a JSON object in this format:
    {
      "winner": "Base" | "SFT" | "DPO" | "Tie",
      "reason": "<one sentence explanation of why the winner was chosen>"
    }
    """

# ---------------------------------------------------------------------------
# Fixture CTEs (FIXTURES.md)
# ---------------------------------------------------------------------------
FD1 = """select conv_id, count(*) as n_turns, cast(sum(length(text)) as bigint) as n_chars
from conversations group by conv_id"""

FD2 = """select u.conv_id * 100 + u.turn as pair_id, u.text as prompt, a.text as chosen, b.text as rejected,
  case when u.conv_id % 11 = 0 then null else cast(u.conv_id % 10 as double) / 2 + 1 end as score_chosen,
  cast(u.turn % 4 as double) as score_rejected
from conversations u
join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
join conversations b on b.conv_id = u.conv_id and b.turn = u.turn + 3 and b.role = 'assistant'
where u.role = 'user'"""

FD3 = """select o.o_orderkey as q_id, m.model as model,
  'work shown #### ' || cast(o.o_orderkey % 97 as varchar) as answer,
  case (o.o_orderkey + m.k) % 6
    when 0 then 'Step 1: take it' || chr(10) || 'Then, #### ' || cast(o.o_orderkey % 97 as varchar)
    when 1 then 'The total is ' || cast(o.o_orderkey % 97 as varchar)
    when 2 then 'The total is ' || cast(o.o_orderkey % 97 as varchar) || '.'
    when 3 then 'no number here'
    when 4 then 'same line' || chr(10) || 'same line' || chr(10) || 'next, ' || cast(o.o_orderkey % 89 as varchar)
    else 'First, 1,200 then #### 7 and #### ' || cast(o.o_orderkey % 97 as varchar) end as response
from orders o cross join (select 'Base' as model, 0 as k union all select 'SFT', 1 union all select 'DPO', 2) m"""

FD4 = """select user_id as prompt_id, event_id as attempt,
  case when event_id % 13 = 0 then '{"winner":"DPO"} {"winner":"SFT"}'
    when event_id % 17 = 0 then '{"winner":"SFT","reason":"c","winner":"DPO"}'
    else case event_type when 'error' then 'not json'
    when 'click' then '{"winner":"DPO","reason":"a"}' when 'view' then '{"winner":"SFT","reason":"b"}'
    when 'signup' then '{"winner":"Tie"}' else '{"reason":"no winner"}' end end as raw
from events"""

FD5 = """select event_id as pair_id, -value as ref_chosen, -(value * 1.1) as ref_rejected,
  -(value * 0.9) as pol_chosen, -(value * (1 + cast(event_id % 7 as double) / 10)) as pol_rejected
from events"""

_PROMPT_VALUES = ", ".join(f"({i}, {S.lit(p)})" for i, p in enumerate(INSTRUCTION_PROMPTS))
FD6 = f"""select d.doc_id as item_id, d.doc_id % 25 as prompt_id,
  ['Base', 'SFT', 'DPO'][cast((d.doc_id // 25) % 3 as bigint) + 1] as model,
  d.text as response, p.prompt
from documents d join (values {_PROMPT_VALUES}) p(prompt_id, prompt) on p.prompt_id = d.doc_id % 25"""

MODELS_CTE = "(values ('Base', false), ('SFT', true), ('DPO', true)) m(model, is_chat)"

USER_PROMPTS = """select conv_id, turn, text as prompt, cast(conv_id % 5 as double) / 10 as temperature,
  cast(0.9 as double) as top_p, 200 + (turn % 5) * 20 as max_tokens
from conversations where role = 'user'"""

PASSING = f"""select conv_id from ({FD1}) f where n_turns between 1 and 6 and n_chars <= 2000"""


def r6(x: str) -> str:
    return f"round(cast({x} as double), 6)"


def pct(cond: str) -> str:
    return f"cast(100 as double) * avg(cast(coalesce({cond}, false) as double))"


TOKENS = "list_filter(string_split({x}, ' '), lambda w: w <> '')"


def toks(x: str) -> str:
    return TOKENS.format(x=x)


def piece(role: str, content: str) -> str:
    return "(" + S.chatml_piece(role, content) + ")"


QA_SCORED = f"""select *, {S.is_exact('pred', 'gold')} as correct from (
  select q_id, model, answer, response, {S.gold_answer('answer')} as gold,
    {S.final_number('response')} as pred, {S.has_repetition('response')} as repetition,
    {S.has_cot('response')} as cot
  from ({FD3}) x) y"""

INSTR_SCORED = f"""select *, {S.rule_verdict('prompt', 'response')} as correct,
  {S.instruction_ok('prompt', 'response')} as ok
from ({FD6}) x"""


def corpus_counts(where: str = "") -> str:
    src = "documents d"
    if where:
        src += f" where d.doc_id in (select doc_id from labels where {where})"
    return f"""select tok as token, count(*) as c from (
  select unnest({toks('d.text')}) as tok from {src}) t group by tok"""


REF_COUNTS = corpus_counts()
SFT_COUNTS = corpus_counts("quality = 1")
POL_COUNTS = corpus_counts("quality = 1 and toxic = 0")


def perplexity_sql(counts: str, texts: str = "select item_id, text from benchmark") -> str:
    """exp of the mean over texts of the mean NLL of the first 512
    tokens, texts of fewer than 2 tokens skipped; V is the reference
    vocabulary."""
    return f"""with cnt as ({counts}), ref as ({REF_COUNTS}),
nv as (select (select sum(c) from cnt) + (select count(*) from ref) as den),
tk as (select item_id, unnest(list_slice({toks('text')}, 1, 512)) as token from ({texts}) x),
per as (select item_id, avg(-ln((coalesce(cnt.c, 0) + 1.0) / nv.den)) as nll, count(*) as n
  from tk left join cnt using (token) cross join nv group by item_id)
select count(*) as n_texts, exp(avg(nll)) as perplexity from per where n >= 2"""


# One JSON object and nothing else; of a repeated key the last value.
PARSED = f"""select prompt_id, attempt, ok,
    case when ok then coalesce(regexp_extract_all(s, '"winner":"([^"]*)"', 1)[-1], 'Tie') end as winner,
    case when ok then coalesce(regexp_extract_all(s, '"reason":"([^"]*)"', 1)[-1], {S.lit(DEFAULT_REASON)}) end as reason
  from (select prompt_id, attempt, s,
      coalesce(starts_with(s, '{{') and ends_with(s, '}}'), false) and coalesce(json_valid(s), false) as ok
    from (select prompt_id, attempt, {S.strip('raw')} as s from ({FD4}) a) b) c"""

VERDICTS = f"""select o.o_orderkey as prompt_id,
  coalesce(arg_min(winner, attempt) filter (where ok), 'Error') as winner,
  coalesce(arg_min(reason, attempt) filter (where ok), {S.lit(ERROR_REASON)}) as reason,
  count(attempt) as n_attempts, min(attempt) filter (where ok) as used_attempt
from orders o left join ({PARSED}) d on d.prompt_id = o.o_orderkey
group by o.o_orderkey"""

VERDICT_COUNTS = f"""select winner, cast(sum(w) as bigint) as n from (
  select winner, 1 as w from ({VERDICTS}) v
  union all select * from (values ('Base', 0), ('SFT', 0), ('DPO', 0), ('Tie', 0), ('Error', 0)) z(winner, w)
) u group by winner"""

TASK_RESPONSES = f"""select 'qa' as task, q_id as idx, model, response from ({FD3}) q
union all select 'instructions', (item_id // 75) * 25 + item_id % 25, model, response from ({FD6}) i"""

# The sample arrays of a bundle, by their positions.
STORED_SAMPLES = f"""select * from (
  select 'qa' as task, model, response, row_number() over (partition by model order by q_id) as i from ({FD3}) q)
  where i <= 10
union all select * from (
  select 'instructions', model, response, row_number() over (partition by model order by item_id) as i from ({FD6}) r)
  where i <= 25"""

UNCONFIGURED = "No Gemini or Groq API key configured."


def by_provider(rank: str) -> str:
    """Verdicts where attempts come in the order of a provider's rank; those
    without one were never made."""
    return f"""with a as (select a.*, {rank} as rank from ({PARSED}) a),
b as (select prompt_id, winner, reason, attempt, rank, row_number() over (partition by prompt_id order by rank, attempt) as i
  from a where ok and rank is not null),
n as (select prompt_id, count(*) as n from a where rank is not null group by 1)
select o_orderkey as prompt_id, coalesce(winner, 'Error') as winner, coalesce(reason, {S.lit(ERROR_REASON)}) as reason,
  coalesce(n, 0) as n_attempts, b.attempt as used_attempt,
  case b.rank when 1 then 'first' when 2 then 'second' end as used_provider
from orders left join b on b.prompt_id = o_orderkey and i = 1 left join n on n.prompt_id = o_orderkey"""


MARGINS = f"""select pair_id, 0.05 * (pol_chosen - ref_chosen) - 0.05 * (pol_rejected - ref_rejected) as margin
from ({FD5}) f"""

SIDE_BY_SIDE = f"""select q_id, max(response) filter (where model = 'Base') as "Base",
  max(response) filter (where model = 'SFT') as "SFT", max(response) filter (where model = 'DPO') as "DPO"
from ({FD3}) r group by q_id"""

BUNDLE = f"""with
ppl as (select 'Base' as model, perplexity from ({perplexity_sql(REF_COUNTS)}) a
  union all select 'SFT', perplexity from ({perplexity_sql(SFT_COUNTS)}) b
  union all select 'DPO', perplexity from ({perplexity_sql(POL_COUNTS)}) c),
ins as (select model, {pct('ok')} as instruction_following_acc_pct,
  count(*) as n_instr_samples from ({INSTR_SCORED}) i group by model),
qa as (select model, {pct('correct')} as gsm8k_acc_pct, {pct('cot')} as cot_presence_pct from ({QA_SCORED}) q group by model),
smp as (select model, count(*) as n_gsm8k_samples,
    string_agg(cast(q_id as varchar) || '=' || coalesce(pred, '-'), ',' order by q_id) as gsm8k_sample_preds
  from (select *, row_number() over (partition by model order by q_id) as rn from ({QA_SCORED}) q) s
  where rn <= 10 group by model)
select model, perplexity, instruction_following_acc_pct, gsm8k_acc_pct, cot_presence_pct,
  n_instr_samples, n_gsm8k_samples, gsm8k_sample_preds
from ppl full join ins using (model) full join qa using (model) full join smp using (model)"""

COMPARE = f"""with b as ({BUNDLE}),
l as (select model, 'Perplexity' as metric, perplexity as value from b
  union all select model, 'Instruction-Follow Acc (%)', instruction_following_acc_pct from b
  union all select model, 'GSM8K Acc (%)', gsm8k_acc_pct from b
  union all select model, 'CoT Presence (%)', cot_presence_pct from b)
select metric, max(value) filter (where model = 'Base') as "Base", max(value) filter (where model = 'SFT') as "SFT",
  max(value) filter (where model = 'DPO') as "DPO" from l group by metric"""


def pair_side_logp(counts: str, den: str, pairs: str = FD2) -> str:
    """Completion log-prob per (pair_id, side): the completion's tokens plus
    the end token, under the given counts."""
    closed = ("case when coalesce(t[-1] = '{e}', false) then t else list_append(t, '{e}') end"
              .format(e=IM_END))
    return f"""select pair_id, side, count(*) as n, sum(ln((coalesce(cnt.c, 0) + 1.0) / {den})) as logp
from (select pair_id, side, unnest({closed}) as token from (
    select pair_id, 'chosen' as side, {toks("coalesce(chosen, '')")} as t from ({pairs}) p
    union all select pair_id, 'rejected', {toks("coalesce(rejected, '')")} from ({pairs}) p) x) y
left join ({counts}) cnt using (token) group by pair_id, side"""


REF_DEN = f"((select sum(c) from ({REF_COUNTS}) a) + (select count(*) from ({REF_COUNTS}) b))"
POL_DEN = f"((select sum(c) from ({POL_COUNTS}) a) + (select count(*) from ({REF_COUNTS}) b))"


def bigram_rows(tokens: str) -> str:
    """(ctx, token) pairs of a token list: the previous token, '<s>' first."""
    return (f"unnest(list_slice(list_prepend('<s>', {tokens}), 1, len({tokens}))) as ctx, "
            f"unnest({tokens}) as token")


BIGRAM_PPL = f"""with dt as (select {toks('text')} as t from documents),
g as (select ctx, token, count(*) as c from (select {bigram_rows('t')} from dt) x group by ctx, token),
cx as (select ctx, sum(c) as cc from g group by ctx),
v as (select count(distinct token) as v from g),
bt as (select item_id, {bigram_rows('t')} from (
  select item_id, list_slice({toks('text')}, 1, 512) as t from benchmark) b),
per as (select item_id, count(*) as n,
    avg(-ln((coalesce(g.c, 0) + 1.0) / (coalesce(cx.cc, 0) + v.v))) as nll
  from bt left join g using (ctx, token) left join cx using (ctx) cross join v group by item_id)
select count(*) as n_texts, {r6('exp(avg(nll))')} as perplexity from per where n >= 2"""


def bigram_counts(name: str, where: str = "") -> str:
    """Two tables: the counts of (ctx, token) and of ctx over some documents."""
    src = f"documents where doc_id in (select doc_id from labels where {where})" if where else "documents"
    return f"""{name}_g as (select ctx, token, count(*) as c from (
    select {bigram_rows('t')} from (select {toks('text')} as t from {src}) d) x group by ctx, token),
{name}_x as (select ctx, sum(c) as cc from {name}_g group by ctx)"""


BIGRAM_MODELS = ", ".join((bigram_counts("base"), bigram_counts("sft", "quality = 1"),
                           bigram_counts("dpo", "quality = 1 and toxic = 0")))


def bigram_logp(name: str) -> str:
    return f"ln((coalesce({name}_g.c, 0) + 1.0) / (coalesce({name}_x.cc, 0) + (select count(distinct token) from base_g)))"


def bigram_joins(*names: str) -> str:
    return " ".join(f"left join {n}_g on {n}_g.ctx = t.ctx and {n}_g.token = t.token left join {n}_x on {n}_x.ctx = t.ctx"
                    for n in names)


BIGRAM_FAMILY_PPL = f"""with {BIGRAM_MODELS},
t as (select item_id, {bigram_rows('t')} from (select item_id, list_slice({toks('text')}, 1, 512) as t from benchmark) b),
per as (select item_id, count(*) as n, avg(-{bigram_logp('base')}) as b, avg(-{bigram_logp('sft')}) as s,
    avg(-{bigram_logp('dpo')}) as d from t {bigram_joins('base', 'sft', 'dpo')} group by item_id)
select 'Base' as model, count(*) as n_texts, {r6('exp(avg(b))')} as perplexity from per where n >= 2
union all select 'SFT', count(*), {r6('exp(avg(s))')} from per where n >= 2
union all select 'DPO', count(*), {r6('exp(avg(d))')} from per where n >= 2"""

# The first completion token's context is the prompt's last.
BIGRAM_PREFERENCE = f"""with {BIGRAM_MODELS},
seq as (select pair_id, side, len(p) as skip, list_concat(p, case when coalesce(c[-1] = '{IM_END}', false) then c
    else list_append(c, '{IM_END}') end) as s
  from (select pair_id, side, {toks(piece("'user'", 'prompt') + ' || ' + S.CHAT_TAIL)} as p, {toks("coalesce(answer, '')")} as c
    from (select pair_id, prompt, 'chosen' as side, chosen as answer from ({FD2}) a
      union all select pair_id, prompt, 'rejected', rejected from ({FD2}) b) x) y),
t as (select pair_id, side, s[i] as token, s[i - 1] as ctx
  from (select pair_id, side, s, unnest(generate_series(skip + 1, len(s))) as i from seq) z),
m as (select pair_id, side, sum({bigram_logp('dpo')}) - sum({bigram_logp('base')}) as gain
  from t {bigram_joins('base', 'dpo')} group by pair_id, side),
w as (select pair_id, 0.05 * max(gain) filter (where side = 'chosen') - 0.05 * max(gain) filter (where side = 'rejected') as margin
  from m group by pair_id)
select count(*) as n_pairs, {r6('100.0 * avg(case when margin > 0 then 1.0 else 0.0 end)')} as preference_accuracy_pct,
  {r6('avg(margin)')} as mean_margin from w"""


def _running_sql() -> str:
    return f"""select model, q_id as idx, cast(h as bigint) as hits_so_far, {r6('100.0 * h / q_id')} as running_acc_pct
from (select model, q_id, coalesce(sum(cast(correct as int)) over (partition by model order by q_id
    rows between unbounded preceding and 1 preceding), 0) as h from ({QA_SCORED}) s) w
where q_id > 0 and q_id % 10 = 0"""


SAMPLED_PAIRS = f"""select *, md5('42:' || cast(pair_id as varchar)) as shuffle_key from ({FD2}) p
  where coalesce(score_chosen - score_rejected >= 1.0, true) and length(chosen) <= 1200 and length(rejected) <= 1200
  order by shuffle_key, pair_id"""

LEGACY = """select conv_id as pair_id,
    arg_min(text, turn) filter (where role = 'system') as system,
    case when conv_id % 3 = 0 then '' else arg_min(text, turn) filter (where role = 'user') end as input,
    arg_max(text, turn) filter (where role = 'user') as question,
    arg_min(text, turn) filter (where role = 'assistant') as chosen,
    arg_max(text, turn) filter (where role = 'assistant') as rejected
  from conversations group by conv_id"""


def k1_sql(pairs: str, prompt: str) -> str:
    """Both sides' completion log-probs under the reference counts, and the
    tokens of the rendered prompt; a side without text is the end token alone."""
    return f"""select s.pair_id, s.side, p.n_prompt_tokens, s.n as n_completion_tokens, {r6('s.logp')} as logp
from ({pair_side_logp(REF_COUNTS, REF_DEN, pairs)}) s
join (select pair_id, len({toks('r')}) as n_prompt_tokens from (
  select pair_id, {prompt} || {S.CHAT_TAIL} as r from ({pairs}) x) y) p using (pair_id)"""


def preference_sql(pairs: str) -> str:
    return f"""with pol as ({pair_side_logp(POL_COUNTS, POL_DEN, pairs)}),
ref as ({pair_side_logp(REF_COUNTS, REF_DEN, pairs)}),
m as (select p.pair_id,
    0.05 * (max(p.logp) filter (where p.side = 'chosen') - max(r.logp) filter (where r.side = 'chosen'))
    - 0.05 * (max(p.logp) filter (where p.side = 'rejected') - max(r.logp) filter (where r.side = 'rejected')) as margin
  from pol p join ref r on p.pair_id = r.pair_id and p.side = r.side group by p.pair_id)
select count(*) as n_pairs, {r6('100.0 * avg(case when margin > 0 then 1.0 else 0.0 end)')} as preference_accuracy_pct,
  {r6('avg(margin)')} as mean_margin from m"""


ORACLE: dict[str, str] = {
    "qa_report": f"""select model, count(*) as n, {r6(pct('correct'))} as gsm8k_acc_pct,
  {r6(pct('cot'))} as cot_presence_pct from ({QA_SCORED}) s group by model""",

    "c1_filter_conversations": f"""select conv_id, n_turns, n_chars from ({FD1}) f
where n_turns between 1 and 6 and n_chars <= 2000""",

    "c3_filter_pairs": f"""select pair_id, score_chosen, score_rejected,
  cast(length(chosen) as bigint) as chosen_chars, cast(length(rejected) as bigint) as rejected_chars
from ({FD2}) p
where coalesce(score_chosen - score_rejected >= 1.0, true) and length(chosen) <= 1200 and length(rejected) <= 1200""",

    "a1_stored_conversations": f"""select conv_id, n_turns, n_chars from ({FD1}) f
where n_turns between 1 and 6 and n_chars <= 2000""",

    "a2_stored_pairs": f"""select pair_id, 'train_prefs' as split, score_chosen, score_rejected,
  cast(length(chosen) as bigint) as chosen_chars, cast(length(rejected) as bigint) as rejected_chars
from ({FD2}) p where pair_id % 10 <> 0 and coalesce(score_chosen - score_rejected >= 1.0, true)
  and length(chosen) <= 1200 and length(rejected) <= 1200""",

    "b3_judged_csv": f"""select s.q_id as prompt_id, v.winner, v.reason, md5(s."Base") as base_md5, md5(s."SFT") as sft_md5,
  md5(s."DPO") as dpo_md5, cast(null as varchar) as broken
from ({SIDE_BY_SIDE}) s left join ({VERDICTS}) v on v.prompt_id = s.q_id
union all select null, null, null, md5('cut off'), null, null, 'x' || cast(o_orderkey as varchar) || ',cut off'
from orders where o_orderkey % 50 = 0""",

    "b4_showcase_csv": SIDE_BY_SIDE,

    "c4_filter_texts": f"""select doc_id, length({S.strip('text')}) as stripped_chars from documents
where length({S.strip('text')}) > 20""",

    "c6_funnel": f"""with a as (select count(*) as n0, count(*) filter (where n_turns >= 1) as n1,
    count(*) filter (where n_turns >= 1 and n_turns <= 6) as n2,
    count(*) filter (where n_turns >= 1 and n_turns <= 6 and n_chars <= 2000) as n3 from ({FD1}) f)
select cast(1 as bigint) as stage_no, 'has_messages' as stage, n0 as n_in, n1 as n_kept from a
union all select 2, 'max_turns', n1, n2 from a
union all select 3, 'max_chars', n2, n3 from a""",

    "c6_pair_funnel": f"""with a as (select count(*) as n0,
    count(*) filter (where coalesce(score_chosen - score_rejected >= 1.0, true)) as n1,
    count(*) filter (where coalesce(score_chosen - score_rejected >= 1.0, true)
      and length(chosen) <= 1200 and length(rejected) <= 1200) as n2 from ({FD2}) p)
select cast(1 as bigint) as stage_no, 'score_gap' as stage, n0 as n_in, n1 as n_kept from a
union all select 2, 'max_chars', n1, n2 from a""",

    "d1_last_content": """select conv_id, arg_max(role, turn) as last_role, arg_max(text, turn) as last_content,
  cast(length(arg_max(text, turn)) as bigint) as last_chars from conversations group by conv_id""",

    "d2_to_pairs_text": f"""select pair_id, cast(1 as bigint) as n_prompt, cast(1 as bigint) as n_chosen,
  cast(1 as bigint) as n_rejected, {piece("'user'", 'prompt')} as prompt_chatml,
  {piece("'assistant'", 'chosen')} as chosen_chatml, {piece("'assistant'", 'rejected')} as rejected_chatml
from ({FD2}) p""",

    "d2_to_pairs_lists": f"""with c as (select conv_id, turn, role, text,
    row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n
  from conversations),
g as (select conv_id, max(n) as n, arg_min(text, turn) as first_text,
    arg_max(role, turn) as last_role, arg_max(text, turn) as last_text,
    max(role) filter (where rn = n - 1) as prev_role, max(text) filter (where rn = n - 1) as prev_text,
    coalesce(string_agg({piece('role', 'text')}, '' order by turn), '') as all_chatml,
    coalesce(string_agg({piece('role', 'text')}, '' order by turn) filter (where rn < n), '') as but_last_chatml
  from c group by conv_id)
select conv_id as pair_id,
  cast(case when n > 1 and last_role = 'assistant' then 1 else n end as bigint) as n_chosen,
  cast(case when n - 1 > 1 and prev_role = 'assistant' then 1 else n - 1 end as bigint) as n_rejected,
  {piece("'user'", 'first_text')} as prompt_chatml,
  case when n > 1 and last_role = 'assistant' then {piece("'assistant'", 'last_text')} else all_chatml end as chosen_chatml,
  case when n - 1 > 1 and prev_role = 'assistant' then {piece("'assistant'", 'prev_text')} else but_last_chatml end as rejected_chatml
from g""",

    "d3_legacy_prompt": f"""with g as (select conv_id,
    arg_min(text, turn) filter (where role = 'system') as system,
    arg_min(text, turn) filter (where role = 'user') as first_user,
    arg_max(text, turn) filter (where role = 'user') as question
  from conversations group by conv_id),
r as (select conv_id, system, case when conv_id % 3 = 0 then '' else first_user end as input, question from g)
select conv_id, cast(case when coalesce(system, '') <> '' then 2 else 1 end as bigint) as n_messages,
  case when coalesce(system, '') <> '' then {piece("'system'", 'system')} else '' end
    || {piece("'user'", "coalesce(nullif(input, ''), question, '')")} as prompt_chatml
from r""",

    "d4_render_chatml": f"""select conv_id, string_agg({piece('role', 'text')}, '' order by turn) as chatml,
  string_agg({piece('role', 'text')}, '' order by turn) || {S.CHAT_TAIL} as chatml_prompt
from conversations group by conv_id""",

    "d5_qa_prompt": f"select item_id, text || {S.lit(QA_SUFFIX)} as prompt from benchmark",

    "d6_model_prompt": f"""select p.conv_id, p.turn, m.model,
  case when m.is_chat then {piece("'user'", 'p.prompt')} || {S.CHAT_TAIL} else p.prompt end as model_prompt
from ({USER_PROMPTS}) p cross join {MODELS_CTE}""",

    "d7_judge_prompt": "select q_id, " + S.lit(JUDGE_PROMPT).join(("replace(" * 4, "")) + "".join(
        f", '@{name}', coalesce(cast({c} as varchar), 'None'))"
        for name, c in (("prompt", "q_id"), ("base", '"Base"'), ("sft", '"SFT"'), ("dpo", '"DPO"')))
        + f" as judge_prompt from ({SIDE_BY_SIDE}) s",

    "d9_close_sequence": f"""select doc_id, len(c) as n_tokens, c[-1] as last_token from (
  select doc_id, case when coalesce(t[-1] = '{IM_END}', false) then t else list_append(t, '{IM_END}') end as c
  from (select doc_id, {toks('text')} as t from documents) a) b""",

    "d10_truncate_tokens": f"""select doc_id, len(t) as n_tokens, len(list_slice(t, 1, 512)) as n_kept,
  list_slice(t, 1, 512)[-1] as last_kept from (select doc_id, {toks('text')} as t from documents) a""",

    "e1_py_strip": f"""select doc_id, length({S.strip('text')}) as stripped_chars,
  {S.strip('text')} <> text as changed from documents""",

    "e2_has_repetition": f"""select doc_id, len({S.repetition_lines('text')}) as n_long_lines,
  {S.has_repetition('text')} as repetition from documents""",

    "e3_has_chat_collapse": f"""select conv_id, turn, model, {S.has_chat_collapse('model_prompt')} as collapse from (
  select p.conv_id, p.turn, m.model,
    case when m.is_chat then {piece("'user'", 'p.prompt')} || {S.CHAT_TAIL} else p.prompt end as model_prompt
  from ({USER_PROMPTS}) p cross join {MODELS_CTE}) g""",

    "e4_final_number": f"select q_id, model, {S.final_number('response')} as pred from ({FD3}) r",

    "e5_gold_answer": f"select q_id, model, {S.gold_answer('answer')} as gold from ({FD3}) r",

    "e6_is_exact": f"select q_id, model, pred, gold, correct from ({QA_SCORED}) s",

    "e7_has_cot": f"""select doc_id, {S.has_cot_marker('text')} as cot_marker, {S.has_cot('text')} as cot
from documents""",

    "e7_has_cot_qa": f"select q_id, model, repetition, cot from ({QA_SCORED}) s",

    "e8_n_sentences": f"select doc_id, {S.n_sentences('text')} as n_sentences from documents",

    "e9_n_lines": f"select doc_id, {S.n_lines('text')} as n_lines from documents",

    "e10_n_words": f"select doc_id, {S.n_words('text')} as n_words from documents",

    "e11_contains": f"""select doc_id, {S.contains_any('low', ('the', 'und', 'les'))} as has_any,
  {S.contains_all('low', ('le', 'la'))} as has_all, {S.contains_none('low', ('der', 'die', 'das'))} as has_none
from (select doc_id, {S.strip('lower(text)')} as low from documents) d""",

    "e12_contains_exact": """select doc_id, contains(text, 'MIT') as has_mit,
  contains(text, '#') as has_hash, contains(text, 'The') as has_the from documents""",

    "e13_all_words_start": f"""select item, {S.all_words_start('low', 's', 3)} as all_start_s,
  {S.all_words_start('low', 's', 4)} as four_start_s
from (select item, {S.strip('lower(words)')} as low from (
  select 'c' || conv_id || '-' || turn as item, role || ' "' || role || ' "' || role || '!"' as words from conversations
  union all select 'p' || p_partkey, p_type from part) w) c""",

    "e14_min_len": f"""select conv_id, turn, length({S.strip('lower(text)')}) > 20 as longer_than_20
from conversations""",

    "e15_parse_verdict": f"select prompt_id, attempt, ok, winner, reason from ({PARSED}) p",

    "f1_rule_verdict": f"""select item_id, model, prompt_id,
  {S.rule_verdict('prompt', 'response')} as correct from ({FD6}) r""",

    "f2_instruction_ok": f"""select item_id, model,
  {S.instruction_ok('prompt', 'response')} as ok from ({FD6}) r""",

    "h1_instruction_accuracy": f"""select model, count(*) as n, {r6(pct('ok'))} as instruction_following_acc_pct
from ({INSTR_SCORED}) s group by model""",

    "g1_side_by_side": SIDE_BY_SIDE,

    "g3_join_logps": f"""select p.pair_id, {r6('p.pol_chosen')} as pol_chosen, {r6('p.pol_rejected')} as pol_rejected,
  {r6('r.ref_chosen')} as ref_chosen, {r6('r.ref_rejected')} as ref_rejected
from ({FD5}) p join ({FD5}) r on p.pair_id = r.pair_id""",

    "g4_request_grid": f"""select p.conv_id, p.turn, m.model, m.is_chat, p.temperature > 0 as do_sample,
  {r6('case when p.temperature > 0 then greatest(p.temperature, cast(0.01 as double)) else cast(1.0 as double) end')} as eff_temperature,
  {r6('case when p.temperature > 0 then p.top_p else cast(1.0 as double) end')} as eff_top_p,
  cast(p.max_tokens as bigint) as max_tokens
from ({USER_PROMPTS}) p cross join {MODELS_CTE}""",

    "g6_resolve_model": f"""select p.conv_id, p.turn, m.model,
  case m.model when 'Base' then 'Base' when 'SFT' then 'SFT' when 'DPO' then 'SFT' else 'Base' end as served_model
from ({USER_PROMPTS}) p cross join {MODELS_CTE}""",

    "g6_availability": f"""select p.conv_id, p.turn, m.model,
  case when p.conv_id % 7 = 0 then 'Base'
    when m.model = 'DPO' and p.conv_id % 3 = 0 then 'DPO'
    when m.model in ('DPO', 'SFT') and p.conv_id % 2 = 0 then 'SFT' else 'Base' end as served_model
from ({USER_PROMPTS}) p cross join {MODELS_CTE}""",

    "h2_qa_accuracy": f"""select model, count(*) as n, {r6(pct('correct'))} as gsm8k_acc_pct
from ({QA_SCORED}) s group by model""",

    "h3_cot_rate": f"""select model, {r6(pct('cot'))} as cot_presence_pct from ({QA_SCORED}) s group by model""",

    "h4_metric_bundle": f"""select model, {r6('perplexity')} as perplexity,
  {r6('instruction_following_acc_pct')} as instruction_following_acc_pct, {r6('gsm8k_acc_pct')} as gsm8k_acc_pct,
  {r6('cot_presence_pct')} as cot_presence_pct, cast(n_instr_samples as bigint) as n_instr_samples,
  cast(n_gsm8k_samples as bigint) as n_gsm8k_samples, gsm8k_sample_preds from ({BUNDLE}) b""",

    "h4_instruction_samples": f"""select model, item_id, prompt, md5(response) as response_md5 from ({FD6}) x""",

    "h5_identical_by_task": " union all ".join(
        f"""select task, '{a}' as model_a, '{b}' as model_b, n_a, n_b, n_equal, n_a = n_b and n_a > 0 as comparable,
  {r6('case when n_a = n_b and n_a > 0 then 100.0 * n_equal / n_a else 0.0 end')} as identical_pct
from (select coalesce(x.task, y.task) as task, count(x.response) as n_a, count(y.response) as n_b,
    count(*) filter (where x.response = y.response) as n_equal
  from (select * from ({TASK_RESPONSES}) r where model = '{a}') x
  full join (select * from ({TASK_RESPONSES}) r where model = '{b}') y on x.task = y.task and x.idx = y.idx
  group by 1) j"""
        for a, b in (("Base", "SFT"), ("SFT", "DPO"), ("Base", "DPO"))),

    "h5_stored_bundles": " union all ".join(
        f"""select task, '{a}' as model_a, '{b}' as model_b, n_a, n_b, n_equal, n_a = n_b and n_a > 0 as comparable,
  {r6('case when n_a = n_b and n_a > 0 then 100.0 * n_equal / n_a else 0.0 end')} as identical_pct
from (select t.task, count(x.response) as n_a, count(y.response) as n_b,
    count(*) filter (where x.response = y.response) as n_equal
  from (select 'qa' as task, unnest(generate_series(1, 10)) as i union all
    select 'instructions', unnest(generate_series(1, 25))) t
  left join (select * from ({STORED_SAMPLES}) r where model = '{a}') x on x.task = t.task and x.i = t.i
  left join (select * from ({STORED_SAMPLES}) r where model = '{b}') y on y.task = t.task and y.i = t.i
  group by 1) j"""
        for a, b in (("Base", "SFT"), ("SFT", "DPO"), ("Base", "DPO"))),

    "h5_identical_pct": " union all ".join(
        f"""select '{a}' as model_a, '{b}' as model_b, n_a, n_b, n_equal, n_a = n_b and n_a > 0 as comparable,
  {r6('case when n_a = n_b and n_a > 0 then 100.0 * n_equal / n_a else 0.0 end')} as identical_pct
from (select count(x.response) as n_a, count(y.response) as n_b,
    count(*) filter (where x.response = y.response) as n_equal
  from (select q_id, response from ({FD3}) r where model = '{a}') x
  full join (select q_id, response from ({FD3}) r where model = '{b}') y on x.q_id = y.q_id) j"""
        for a, b in (("Base", "SFT"), ("SFT", "DPO"), ("Base", "DPO"))),

    "h6_verdict_counts": VERDICT_COUNTS,

    "h7_win_rates": f"""select winner, n as wins, {r6('100.0 * n / total')} as win_rate_pct from (
  select winner, n, sum(n) over () as total from ({VERDICT_COUNTS}) c
  where winner in ('Base', 'SFT', 'DPO', 'Tie')) t where total > 0""",

    "h8_preference_summary": f"""select count(*) as n_pairs,
  {r6('100.0 * avg(case when margin > 0 then 1.0 else 0.0 end)')} as preference_accuracy_pct,
  {r6('avg(margin)')} as mean_margin from ({MARGINS}) m""",

    "h9_compare": f"""select metric, {r6('"Base"')} as "Base", {r6('"SFT"')} as "SFT", {r6('"DPO"')} as "DPO"
from ({COMPARE}) c""",

    "h9_missing_bundle": f"""select metric, {r6('"Base"')} as "Base", cast(null as double) as "SFT", {r6('"DPO"')} as "DPO"
from ({COMPARE}) c""",

    "h10_relative_gain": f"""select metric, {r6('"SFT"')} as base_value, {r6('"DPO"')} as new_value,
  {r6('"DPO" - "SFT"')} as diff, {r6('case when "SFT" = 0 then null else "DPO" / "SFT" end')} as ratio
from ({COMPARE}) c""",

    "i1_running_accuracy": _running_sql(),

    "i1_running_accuracy_sparse": f"""select model, idx, cast(h as bigint) as hits_so_far,
  {r6('100.0 * h / idx')} as running_acc_pct
from (select model, row_number() over w - 1 as idx, coalesce(sum(cast(correct as int)) over (w
    rows between unbounded preceding and 1 preceding), 0) as h
  from ({QA_SCORED}) s where q_id % 5 <> 2 window w as (partition by model order by q_id)) x
where idx > 0 and idx % 10 = 0""",

    "j0_position": """select row_number() over (order by n_chars, doc_id) - 1 as position, doc_id, lang, source, n_chars,
  md5(text) as text_md5 from documents""",

    "j1_seeded_order": f"""select conv_id, shuffle_key, row_number() over (order by shuffle_key, conv_id) - 1 as position
from (select conv_id, md5('42:' || cast(conv_id as varchar)) as shuffle_key from ({PASSING}) p) k""",

    "j2_seeded_sample": f"""select pair_id, row_number() over (order by shuffle_key, pair_id) as sample_rank, shuffle_key
from ({SAMPLED_PAIRS} limit 20) s""",

    "j3_train_eval_split": f"""select conv_id, sample_rank, case when sample_rank <= 20 then 'train' else 'eval' end as split
from (select conv_id, row_number() over (order by shuffle_key, conv_id) as sample_rank
  from (select conv_id, md5('42:' || cast(conv_id as varchar)) as shuffle_key from ({PASSING}) p
    order by shuffle_key, conv_id limit 25) s) r""",

    "j4_first_n": f"""select doc_id, length(text) as n_chars from documents
where length({S.strip('text')}) > 20 order by doc_id limit 200""",

    "j5_preview": f"""select model, q_id, pred, gold, correct from (
  select *, row_number() over (partition by model order by q_id) as rn from ({QA_SCORED}) s) r where rn <= 10""",

    "k1_sequence_logp": k1_sql(FD2, piece("'user'", "prompt")),

    "k1_legacy": k1_sql(LEGACY, "case when coalesce(system, '') <> '' then " + piece("'system'", "system")
                        + " else '' end || " + piece("'user'", "coalesce(nullif(input, ''), question, '')")),

    "k2_perplexity_documents": f"""select n_texts, {r6('perplexity')} as perplexity from ({perplexity_sql(
        REF_COUNTS, "select doc_id as item_id, text from documents "
        "union all select -doc_id - 1, string_split(text, ' ')[1] from documents")}) p""",

    "k2_perplexity": f"""select n_texts, {r6('perplexity')} as perplexity from ({perplexity_sql(REF_COUNTS)}) p""",

    "k3_rewards": f"""select pair_id, {r6('0.05 * (pol_chosen - ref_chosen)')} as chosen_reward,
  {r6('0.05 * (pol_rejected - ref_rejected)')} as rejected_reward from ({FD5}) f""",

    "k4_reward_margin": f"select pair_id, {r6('margin')} as margin from ({MARGINS}) m",

    "k5_dpo_loss": f"""select count(*) as n, {r6('avg(greatest(-margin, 0) + ln(1 + exp(-abs(margin))))')} as dpo_loss
from ({MARGINS}) m""",

    "k6_fill_failed": f"""with x as (select e.event_id as pair_id, f.* exclude (pair_id),
    f.p is null or f.p % 5 = 0 as pol_failed, f.p is null or f.p % 7 = 0 as ref_failed
  from events e left join (select pair_id as p, * from ({FD5}) g
    where pair_id in (select event_id from events where event_type <> 'error')) f on f.p = e.event_id)
select pair_id, {r6('case when pol_failed then 0.0 else pol_chosen end')} as pol_chosen,
  {r6('case when pol_failed then 0.0 else pol_rejected end')} as pol_rejected,
  {r6('case when ref_failed then 0.0 else ref_chosen end')} as ref_chosen,
  {r6('case when ref_failed then 0.0 else ref_rejected end')} as ref_rejected,
  pol_failed, ref_failed, pol_failed or ref_failed as failed from x""",

    "k7_fit_ngram": f"""select token, c, {r6(f'ln((c + 1.0) / {REF_DEN})')} as logp from ({REF_COUNTS}) r""",

    "k7_ngram_preference": preference_sql(FD2),

    "h8_preference_validation": preference_sql(f"{SAMPLED_PAIRS} limit 100"),

    "k7_bigram_perplexity": BIGRAM_PPL,

    "k7_bigram_preference": BIGRAM_PREFERENCE,

    "k7_bigram_family_perplexity": BIGRAM_FAMILY_PPL,

    "l1_resolve_verdicts": VERDICTS,

    "l1_providers": by_provider("case when a.attempt % 5 = 4 then null when a.attempt % 2 = 0 then 2 else 1 end"),

    "l1_first_provider_off": by_provider("case when a.attempt % 5 <> 4 and a.attempt % 2 = 0 then 2 end"),

    "l2_no_provider": f"""select distinct o_orderkey as prompt_id, 'Tie' as winner, {S.lit(UNCONFIGURED)} as reason
from orders""",

    "l3_judged": f"""select s.q_id as prompt_id, s."Base", s."SFT", s."DPO", v.winner, v.reason
from ({SIDE_BY_SIDE}) s left join ({VERDICTS}) v on v.prompt_id = s.q_id""",

    "m2_stack_models": f"select model, q_id, response from ({FD3}) r",
}

"""Log-probability operators.

The model forward pass is outside Spark; its output comes in as a token
table ``(seq_id, pos, token, logp, is_prompt)`` or as per-pair sums. K7
re-aims the provider as an add-one n-gram model counted from a corpus table,
so K1-K6 run end to end on the given tables.

Scale notes:
* Token and gram counts are partial aggregates (``groupBy(token).count()``);
  several corpora that are row subsets of one table are counted in one pass.
* Count tables whose size in bytes (known from the fit) is, taken together,
  under ``BROADCAST_BYTES`` are broadcast: token rows are priced in place and
  summed with one aggregate; several models are chained in the same pass.
* For a larger table the token rows are reduced to distinct (keys, token) with
  a multiplicity and written once, as several passes read them. Where their
  keys are few, these alone are taken from the table, map-side. Else they are
  joined by shuffle; the most frequent keys of the scored rows, known to
  the corpus or not, are priced map-side from a broadcast table and
  their rows get spread join keys, so the shuffle join has no hot key.
* Tokens and contexts are made by generated code: arrays are split, shifted
  and zipped as a whole, without a lambda per token.
* A fit writes its tables to the folder that driver and executors share, so a
  lost executor does not cost a recount (``reliable=False`` keeps them on the
  executors).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscope.functions.chat import (IM_END, close_sequence, last_content, message,
                                      render_chatml, truncate_tokens, whitespace_tokens)
from prefscope.operators.prep import legacy_prompt_messages

# Count tables of up to this many bytes in all (a size known from the fit) are
# joined by broadcast; beyond it the hot/cold split is used.
BROADCAST_BYTES = 64_000_000
# Bytes of a broadcast row besides its key.
ROW_BYTES = 48
# At most this many keys are treated as hot (broadcast side of the split), if
# they hold more than one of HOT_SHARE rows.
HOT_SPLIT = 10_000
HOT_SHARE = 10_000
# A table of up to this many bytes per shuffle partition is joined by hash, not
# by sorting both sides.
HASH_BYTES = 48_000_000
# Rows with a hot token are spread over this many join keys in the shuffle.
HOT_SPREAD = 4096


@dataclass(frozen=True)
class UnigramModel:
    """Add-one unigram model: logp(t) = ln((c(t) + 1) / (N + V)); an unseen
    token has c = 0. ``V`` is the vocabulary size shared by all models being
    compared (the tokenizer's vocabulary), ``N`` the corpus token count."""
    counts: DataFrame  # (token, c)
    n_tokens: int
    vocab_size: int
    n_bytes: int = 0  # of ``counts``, when broadcast

    @property
    def denominator(self) -> float:
        return float(self.n_tokens + self.vocab_size)

    def logp(self, c: Column) -> Column:
        return F.ln((F.coalesce(c, F.lit(0)).cast("double") + F.lit(1.0))
                    / F.lit(self.denominator))

    def unpersist(self) -> None:
        self.counts.unpersist()


def _keep(df: DataFrame, reliable: bool) -> DataFrame:
    """Keep a table for the passes that follow. ``reliable`` writes it as
    Parquet to the shared folder (cutting the lineage: a lost executor does not
    send Spark back to recount the corpus; a pass reads only its columns);
    otherwise it is persisted (memory and disk, recomputed if lost)."""
    if reliable:
        from prefscope.session import shared_path
        path = shared_path(df.sparkSession, "kept")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return df.persist()


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c) over whitespace tokens of a corpus."""
    return (texts.select(F.explode(whitespace_tokens(text_col)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("c")))


def _key_bytes(*keys: str) -> Column:
    """Bytes that a table takes when broadcast: its keys and a fixed part a row."""
    return F.sum(sum((F.octet_length(k) for k in keys), F.lit(ROW_BYTES)))


def fit_ngram(texts: DataFrame, n: int = 1, vocab_size: int | None = None,
              text_col: str = "text", reliable: bool = True):
    """K7: fit the add-one model. ``vocab_size`` fixes the vocabulary shared
    by the compared models (pass the reference model's ``vocab_size``); by
    default the corpus's own vocabulary. ``n >= 2`` gives an ``NgramModel``.

    The counts are kept (they are read by every scoring join); the totals are
    one small aggregate job."""
    if n >= 2:
        return fit_ngram_n(texts, n, vocab_size, text_col, reliable)
    counts = _keep(token_counts(texts, text_col), reliable)
    tot = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                     _key_bytes("token").alias("b")).first()
    v = int(tot["v"]) if vocab_size is None else int(vocab_size)
    return UnigramModel(counts, int(tot["n"] or 0), v, int(tot["b"] or 0))


def fit_ngram_family(texts: DataFrame, corpora: dict[str, Column], vocab_from: str,
                     text_col: str = "text",
                     reliable: bool = True, n: int = 1) -> dict:
    """K7 for several corpora that are row subsets of one table, in one pass:
    one scan and one ``groupBy(token)`` with a conditional count per corpus
    (``corpora`` maps a model name to a row predicate). All models share the
    vocabulary size of ``vocab_from``. ``n >= 2`` gives n-gram models: one
    shuffle on (ctx, token), the contexts summed from the same table; what is
    scored under several of them looks up each gram and context once."""
    names = list(corpora)
    flags = [F.coalesce(corpora[m], F.lit(False)).alias(f"_in{i}") for i, m in enumerate(names)]
    if n >= 2:
        return _fit_ngram_family_n(texts.select(*flags, text_col), names, vocab_from, text_col, reliable, n)
    toks = texts.select(*flags, F.explode(whitespace_tokens(text_col)).alias("token"))
    wide = _keep(toks.groupBy("token").agg(
        *[F.count_if(F.col(f"_in{i}")).alias(f"c{i}") for i in range(len(names))]), reliable)
    tot = wide.agg(*[x for i in range(len(names)) for x in (
        F.sum(f"c{i}").alias(f"n{i}"), F.count_if(F.col(f"c{i}") > 0).alias(f"v{i}"))],
        _key_bytes("token").alias("b")).first()
    v = int(tot[f"v{names.index(vocab_from)}"])
    return {m: UnigramModel(wide.where(F.col(f"c{i}") > 0).select("token", F.col(f"c{i}").alias("c")),
                            int(tot[f"n{i}"] or 0), v, int(tot["b"] or 0))
            for i, m in enumerate(names)}


def _same(keyed: DataFrame, other: DataFrame, pairs) -> Column:
    out = None
    for k, j in pairs:
        t = keyed[k].eqNullSafe(other[j])
        out = t if out is None else out & t
    return out


def _lookup(keyed: DataFrame, table: DataFrame, keys: list[str], values: list[str],
            n_bytes: int, counted: DataFrame | None = None) -> DataFrame:
    """Left-join ``table`` (keys -> values, of at most ``n_bytes``) onto ``keyed``.

    A small table is broadcast. Of a larger one, the rows that
    ``keyed`` asks for are broadcast if its own keys are of such a size. Else
    the most frequent keys of ``keyed`` itself (so also keys that the table does
    not have; at most ``HOT_SPLIT``, none rarer than ``HOT_SHARE`` says) get
    their values first, from a broadcast table of that many rows; their rows
    then go through the shuffle join under one of ``HOT_SPREAD`` hashes, so no
    partition gets a hot key. The join is on the keys and, first, on their
    hash, by which rows sort fast; a table of few bytes per partition
    (``HASH_BYTES``) is hashed and nothing sorted.

    Keys are counted in ``counted``: ``keyed`` before another lookup, which
    would be computed again."""
    if n_bytes <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(table.select(*keys, *values)), keys, "left")
    counted = keyed if counted is None else counted
    size = counted.agg(F.count(F.lit(1)).alias("n"), _key_bytes(*keys).alias("b")).first()
    few = (size["b"] or 0) <= BROADCAST_BYTES
    wanted = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if not few:
        often = F.col("_n") * F.lit(HOT_SHARE) > F.lit(size["n"])
        wanted = wanted.where(often).orderBy(F.desc("_n"), *keys).limit(HOT_SPLIT)
    wanted = _keep(wanted.select(*keys), True)
    found = table.select(*keys, *values).join(F.broadcast(wanted), keys)
    if few:
        return keyed.join(F.broadcast(found), keys, "left")
    names = [f"_hk{i}" for i in range(len(keys))]
    hot = wanted.join(F.broadcast(found), keys, "left").select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(v).alias(f"_hot_{v}") for v in values],
        F.lit(True).alias("_hot"))
    tagged = keyed.join(F.broadcast(hot), _same(keyed, hot, zip(keys, names)), "left").drop(*names)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in tagged.columns]), F.lit(HOT_SPREAD))
    jk = [f"_jk{i}" for i in range(len(keys))]
    cold = table.select(F.xxhash64(*keys).alias("_jh"), *[F.col(k).alias(j) for k, j in zip(keys, jk)],
                        *[F.col(v).alias(f"_cold_{v}") for v in values])
    join_cols = [F.when(F.col("_hot"), spread).otherwise(F.xxhash64(*keys)).alias("_jh"),
                 *[F.col(k).alias(j) for k, j in zip(keys, jk)]]
    if n_bytes <= HASH_BYTES * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        cold = cold.hint("shuffle_hash")
    joined = tagged.select("*", *join_cols).join(cold, ["_jh", *jk], "left")
    return joined.select(*keyed.columns, *[
        F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values])


def _with_counts(keyed: DataFrame, model: UnigramModel, token: str = "token") -> DataFrame:
    """Attach the corpus count ``c`` (null when unseen) to rows keyed by token."""
    if model.n_tokens == 0:
        return keyed.withColumn("c", F.lit(None).cast("long"))
    return _lookup(keyed, model.counts.withColumnRenamed("token", token), [token], ["c"],
                   model.n_bytes)


# ---------------------------------------------------------------------------
# n >= 2
# ---------------------------------------------------------------------------
# Fixed value: the start-of-text symbol that pads the first contexts.
START = "<s>"


@dataclass(frozen=True)
class NgramModel:
    """Add-one n-gram model (n >= 2): logp(w | ctx) = ln((c(ctx, w) + 1) /
    (c(ctx) + V)), where ctx is the previous n - 1 tokens of the same text
    (padded with ``<s>`` at its start) and c(ctx) counts ctx followed by any
    token; an unseen context gives ln(1 / V)."""
    n: int
    grams: DataFrame     # (ctx, token, c)
    contexts: DataFrame  # (ctx, c_ctx)
    n_tokens: int
    vocab_size: int
    n_bytes: int  # of both tables, when broadcast
    family: NgramFamily | None = None
    place: int = 0  # of its counts in the family's tables

    def unpersist(self) -> None:
        self.grams.unpersist()
        self.contexts.unpersist()


@dataclass(frozen=True)
class NgramFamily:
    """The counts of several corpora side by side."""
    grams: DataFrame     # (ctx, token, c0, c1, ..): counts in the order of the models
    contexts: DataFrame  # (ctx, x0, x1, ..)
    n_bytes: int


def token_rows(df: DataFrame, keep: list[str], tokens: Column, n: int = 1) -> DataFrame:
    """(keep, pos, token[, ctx]): a row per token of the array ``tokens`` with
    its 0-based position and, for n >= 2, its previous n - 1 tokens joined by a
    space. The contexts come from n - 1 shifted copies of the token array
    zipped element-wise, so the work per text is linear in its length (slicing
    the whole array per element would be quadratic)."""
    rows = df.select(*keep, tokens.alias("_t"))
    if n < 2:
        return rows.select(*keep, F.posexplode("_t").alias("pos", "token"))
    before = [f"p{k}" for k in range(n - 1, 0, -1)]
    shifts = [F.slice(F.concat(F.array(*[F.lit(START)] * k), F.col("_t")), 1, F.size("_t")).alias(p)
              for k, p in zip(range(n - 1, 0, -1), before)]
    rows = rows.select(*keep, "_t", *shifts).select(
        *keep, F.posexplode(F.arrays_zip(*before, "_t")).alias("pos", "_z"))
    ctx = F.col("_z.p1") if n == 2 else F.concat_ws(" ", *[F.col(f"_z.{p}") for p in before])
    return rows.select(*keep, "pos", F.col("_z._t").alias("token"), ctx.alias("ctx"))


def fit_ngram_n(texts: DataFrame, n: int, vocab_size: int | None = None,
                text_col: str = "text", reliable: bool = True) -> NgramModel:
    """K7 for n >= 2: gram counts (partial aggregate per (ctx, token)) and
    context totals derived from them; both kept."""
    rows = token_rows(texts, [], whitespace_tokens(text_col), n)
    grams = _keep(rows.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("c")), reliable)
    contexts, words = _contexts(grams, {"c_ctx": "c"}, F.lit(True), reliable)
    g = grams.agg(F.sum("c").alias("n"), _key_bytes("ctx", "token").alias("b")).first()
    cx = contexts.agg(_key_bytes("ctx").alias("b")).first()
    v = words if vocab_size is None else int(vocab_size)
    return NgramModel(n, grams, contexts, int(g["n"] or 0), v, int(g["b"] or 0) + int(cx["b"] or 0))


def _contexts(grams: DataFrame, totals: dict[str, str], known: Column, reliable: bool) -> tuple[DataFrame, int]:
    """(ctx, totals), the sums of some counts over each context, and the number
    of distinct tokens of the grams that ``known`` names: one pass over the
    grams, in which each gives a row for its context and one for its token."""
    rows = grams.select(F.inline(F.array(
        F.struct(F.col("ctx").alias("word"), *[F.col(c).alias(x) for x, c in totals.items()],
                 F.lit(True).alias("is_ctx"), F.lit(False).alias("is_token")),
        F.struct(F.col("token").alias("word"), *[F.lit(0).cast("long").alias(x) for x in totals],
                 F.lit(False).alias("is_ctx"), known.alias("is_token")))))
    words = rows.groupBy("word").agg(*[F.sum(x).alias(x) for x in totals],
                                     F.max("is_ctx").alias("is_ctx"), F.max("is_token").alias("is_token"))
    words = _keep(words, True) if reliable else words
    contexts = words.where("is_ctx").select(F.col("word").alias("ctx"), *totals)
    return contexts if reliable else _keep(contexts, False), words.where("is_token").count()


def _fit_ngram_family_n(texts: DataFrame, names: list[str], vocab_from: str, text_col: str,
                        reliable: bool, n: int) -> dict[str, NgramModel]:
    flags, size = [f"_in{i}" for i in range(len(names))], range(len(names))
    rows = token_rows(texts, flags, whitespace_tokens(text_col), n)
    grams = _keep(rows.groupBy("ctx", "token").agg(*[F.count_if(f).alias(f"c{i}") for i, f in enumerate(flags)]), reliable)
    contexts, v = _contexts(grams, {f"x{i}": f"c{i}" for i in size}, F.col(f"c{names.index(vocab_from)}") > 0, reliable)
    counts = F.lit(8 * len(names))
    g = grams.agg(*[F.sum(f"c{i}").alias(f"n{i}") for i in size], _key_bytes("ctx", "token").alias("b"),
                  F.sum(counts).alias("c")).first()
    cx = contexts.agg(_key_bytes("ctx").alias("b"), F.sum(counts).alias("c")).first()
    family = NgramFamily(grams, contexts, sum(int(x[k] or 0) for x in (g, cx) for k in ("b", "c")))

    def own(table: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        return table.where(F.col(value) > 0).select(*keys, F.col(value).alias(name))

    return {m: NgramModel(n, own(grams, ["ctx", "token"], f"c{i}", "c"), own(contexts, ["ctx"], f"x{i}", "c_ctx"), int(g[f"n{i}"] or 0), v,
                          int(g["b"] or 0) + int(cx["b"] or 0), family, i) for i, m in enumerate(names)}


def _shared_family(models: dict) -> NgramFamily | None:
    """The family that all these models come from, if they do."""
    found = [m.family if isinstance(m, NgramModel) else None for m in models.values()]
    return found[0] if found and all(f is found[0] for f in found) else None


def _distinct_rows(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with their number ``_k``, written: lookups read them to
    find the frequent keys and again to join."""
    return _keep(tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")), True)


def _family_sums(tokens: DataFrame, models: dict, keys: list[str], family: NgramFamily) -> DataFrame:
    """(keys, n_tokens, logp_sum_<name> per model): every gram and context is
    looked up once for all models. Beyond the broadcast size, the rows are
    first reduced to distinct (keys, ctx, token) and written."""
    small = family.n_bytes <= BROADCAST_BYTES
    if small:
        rows = tokens.select(*keys, "ctx", "token", F.lit(1).cast("long").alias("_k"))
    else:
        rows = _distinct_rows(tokens, [*keys, "ctx", "token"])
    places = [m.place for m in models.values()]
    j = _lookup(rows, family.grams, ["ctx", "token"], [f"c{i}" for i in places], family.n_bytes)
    j = _lookup(j, family.contexts, ["ctx"], [f"x{i}" for i in places], family.n_bytes, rows)

    def count(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)).cast("double")

    return j.groupBy(*keys).agg(F.sum("_k").alias("n_tokens"), *[
        F.sum(F.col("_k").cast("double") * F.ln((count(f"c{m.place}") + F.lit(1.0))
                                                / (count(f"x{m.place}") + F.lit(float(m.vocab_size)))))
        .alias(f"logp_sum_{name}") for name, m in models.items()])


def _price_ngram(keyed: DataFrame, model: NgramModel) -> DataFrame:
    """Adds ``logp`` to rows keyed by (ctx, token)."""
    j = _lookup(keyed, model.grams, ["ctx", "token"], ["c"], model.n_bytes)
    j = _lookup(j, model.contexts, ["ctx"], ["c_ctx"], model.n_bytes, keyed)
    return j.withColumn("logp", F.ln(
        (F.coalesce(F.col("c"), F.lit(0)).cast("double") + F.lit(1.0))
        / (F.coalesce(F.col("c_ctx"), F.lit(0)).cast("double") + F.lit(float(model.vocab_size)))))


def _price(keyed: DataFrame, model) -> DataFrame:
    if isinstance(model, NgramModel):
        return _price_ngram(keyed, model)
    return _with_counts(keyed, model).withColumn("logp", model.logp(F.col("c")))


def _key_cols(model) -> list[str]:
    return ["ctx", "token"] if isinstance(model, NgramModel) else ["token"]


def _broadcastable(*models) -> bool:
    """Whether the tables of all these models together may be broadcast."""
    return sum(m.n_bytes for m in models) <= BROADCAST_BYTES


def score_tokens(tokens: DataFrame, model, keys: list[str]) -> DataFrame:
    """Per-token log-probs for a token table (``keys`` + pos + token, and
    ``ctx`` for n >= 2). The lookup is a join on the token: a broadcast one
    when the model's tables have a checked small size, else the hot/cold
    split."""
    return _price(tokens if _broadcastable(model) else _keep(tokens, True), model).drop("c", "c_ctx")


def sequence_sums(tokens: DataFrame, model, keys: list[str]) -> DataFrame:
    """(keys, n_tokens, logp_sum) without materialising per-token log-probs.
    With a broadcast lookup the token rows are priced in place and summed
    (one shuffle, partial aggregates). Else they are first reduced to distinct
    (keys, token) with a multiplicity, so the join moves fewer rows."""
    kc = _key_cols(model)
    if _broadcastable(model):
        priced = _price(tokens.select(*keys, *kc), model)
        return priced.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tokens"),
                                         F.sum("logp").alias("logp_sum"))
    return _distinct_sums(_distinct_rows(tokens, [*keys, *kc]), model, keys)


def _distinct_sums(rows: DataFrame, model, keys: list[str]) -> DataFrame:
    """``sequence_sums`` of rows with a multiplicity."""
    priced = _price(rows, model)
    return priced.groupBy(*keys).agg(
        F.sum("_k").alias("n_tokens"),
        F.sum(F.col("_k").cast("double") * F.col("logp")).alias("logp_sum"))


def sequence_sums_multi(tokens: DataFrame, models: dict, keys: list[str]) -> DataFrame:
    """(keys, n_tokens, logp_sum_<name> per model) in one pass: when every
    model is a unigram model with a broadcastable table, the token rows meet
    each count table in a chain of map-side joins and one aggregate sums all
    models; n-gram models of one fit are looked up together; otherwise each
    model is summed on its own and the results are joined on the keys (larger
    unigram models read the distinct token rows, which are made once)."""
    family = _shared_family(models)
    if family is not None:
        return _family_sums(tokens, models, keys, family)
    if all(isinstance(m, UnigramModel) for m in models.values()) and _broadcastable(*models.values()):
        t = tokens.select(*keys, "token")
        for name, m in models.items():
            t = t.join(F.broadcast(m.counts.select("token", F.col("c").alias(f"_c_{name}"))),
                       "token", "left")
        return t.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_tokens"),
            *[F.sum(m.logp(F.col(f"_c_{name}"))).alias(f"logp_sum_{name}")
              for name, m in models.items()])
    one = all(isinstance(m, UnigramModel) and not _broadcastable(m) for m in models.values())
    rows = _distinct_rows(tokens, [*keys, "token"]) if one else None
    out = None
    for name, m in models.items():
        x = (_distinct_sums(rows, m, keys) if one else sequence_sums(tokens, m, keys)).withColumnRenamed("logp_sum", f"logp_sum_{name}")
        out = x if out is None else _join_keys(out, x.drop("n_tokens"), keys)
    return out


def _join_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null (as grouping has them)."""
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(b, _same(a, b, [(k, f"_r_{k}") for k in keys])).drop(*[f"_r_{k}" for k in keys])


# K1 ------------------------------------------------------------------------
def sequence_logp(token_logps: DataFrame, keys=("seq_id",)) -> DataFrame:
    """K1: completion log-prob = sum of token log-probs outside the prompt."""
    return token_logps.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~F.col("is_prompt"), F.col("logp"))), F.lit(0.0))
        .alias("logp"),
        F.count_if(~F.col("is_prompt")).alias("n_completion_tokens"))


def completion_tokens(pairs: DataFrame, side: str, id_col: str = "pair_id",
                      end: str = IM_END, n: int = 1) -> DataFrame:
    """(pair_id, side, pos, token, is_prompt[, ctx]) for one side of each
    pair: the prompt rendered with the chat template and the generation tail
    (a text prompt is one user message; without a ``prompt`` column the legacy
    ``system`` / ``input`` / ``question`` columns, D3), masked; then the
    completion - the last message's content when the side is a message list - closed with the
    end token (D9). With ``n >= 2`` each token carries its context, which for
    the first completion tokens reaches into the prompt."""
    types = {f.name: f.dataType for f in pairs.schema.fields}
    if "prompt" not in types:
        prompt_msgs = legacy_prompt_messages(pairs)
    elif isinstance(types["prompt"], T.ArrayType):
        prompt_msgs = F.col("prompt")
    else:
        prompt_msgs = F.array(message("user", F.col("prompt").cast("string")))
    completion = (last_content(side) if isinstance(types[side], T.ArrayType)
                  else F.col(side).cast("string"))
    p = whitespace_tokens(render_chatml(prompt_msgs, True))
    c = close_sequence(whitespace_tokens(F.coalesce(completion, F.lit(""))), end)
    seqs = pairs.select(id_col, F.lit(side).alias("side"), p.alias("_p"), c.alias("_c")).select(
        id_col, "side", F.size("_p").alias("_n_prompt"), F.concat("_p", "_c").alias("_seq"))
    rows = token_rows(seqs, [id_col, "side", "_n_prompt"], F.col("_seq"), n)
    return rows.select(id_col, "side", F.col("pos").cast("long").alias("pos"), "token",
                       (F.col("pos") < F.col("_n_prompt")).alias("is_prompt"), *(["ctx"] if n >= 2 else []))


def pair_logps(pairs: DataFrame, model, id_col: str = "pair_id",
               prefix: str = "") -> DataFrame:
    """(pair_id, {prefix}chosen, {prefix}rejected): completion log-probs of
    both sides. Prompt tokens are masked, so only completion tokens are
    priced."""
    n = model.n if isinstance(model, NgramModel) else 1
    toks = completion_tokens(pairs, "chosen", id_col, n=n).unionByName(
        completion_tokens(pairs, "rejected", id_col, n=n)).where(~F.col("is_prompt"))
    sums = sequence_sums(toks, model, [id_col, "side"])
    return sums.groupBy(id_col).agg(
        F.max(F.when(F.col("side") == "chosen", F.col("logp_sum"))).alias(prefix + "chosen"),
        F.max(F.when(F.col("side") == "rejected", F.col("logp_sum"))).alias(prefix + "rejected"))


# K2 ------------------------------------------------------------------------
def perplexity(texts: DataFrame, model, id_col: str = "text_id",
               text_col: str = "text", max_len: int = 512, min_tokens: int = 2) -> DataFrame:
    """K2: per text the mean NLL of its first ``max_len`` tokens (D10),
    texts with fewer than ``min_tokens`` skipped (C5), then
    exp(mean over texts). Returns one row (n_texts, perplexity); an empty
    input gives a null perplexity."""
    toks = token_rows(texts, [id_col], truncate_tokens(whitespace_tokens(text_col), max_len),
                      model.n if isinstance(model, NgramModel) else 1)
    per_text = sequence_sums(toks, model, [id_col]).where(F.col("n_tokens") >= min_tokens)
    nll = -F.col("logp_sum") / F.col("n_tokens")
    return per_text.agg(F.count(F.lit(1)).alias("n_texts"),
                        F.exp(F.avg(nll)).alias("perplexity"))


def perplexity_multi(texts: DataFrame, models: dict, id_col: str = "text_id",
                     text_col: str = "text", max_len: int = 512,
                     min_tokens: int = 2) -> DataFrame:
    """K2 for several models over the same texts in one tokenization pass:
    rows (model, n_texts, perplexity)."""
    family = _shared_family(models)
    if family is None and any(isinstance(m, NgramModel) for m in models.values()):
        out = None
        for name, m in models.items():
            x = perplexity(texts, m, id_col, text_col, max_len, min_tokens).select(
                F.lit(name).alias("model"), "n_texts", "perplexity")
            out = x if out is None else out.unionByName(x)
        return out
    toks = token_rows(texts, [id_col], truncate_tokens(whitespace_tokens(text_col), max_len),
                      1 if family is None else next(iter(models.values())).n)
    per = sequence_sums_multi(toks, models, [id_col]).where(F.col("n_tokens") >= min_tokens)
    agg = per.agg(F.count(F.lit(1)).alias("n_texts"), *[
        F.exp(F.avg(-F.col(f"logp_sum_{name}") / F.col("n_tokens"))).alias(f"p_{name}")
        for name in models])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col("n_texts"), F.col(f"p_{name}").alias("perplexity"))
        for name in models])))


def pair_logps_multi(pairs: DataFrame, models: dict, id_col: str = "pair_id") -> DataFrame:
    """(pair_id, <name>_chosen, <name>_rejected per model): completion
    log-probs of both sides under several models in one pass: unigram models,
    or n-gram models of one fit."""
    family = _shared_family(models)
    n = 1 if family is None else next(iter(models.values())).n
    if family is None and any(isinstance(m, NgramModel) for m in models.values()):
        out = None
        for name, m in models.items():
            x = pair_logps(pairs, m, id_col, prefix=f"{name}_")
            out = x if out is None else _join_keys(out, x, [id_col])
        return out
    toks = completion_tokens(pairs, "chosen", id_col, n=n).unionByName(
        completion_tokens(pairs, "rejected", id_col, n=n)).where(~F.col("is_prompt"))
    sums = sequence_sums_multi(toks, models, [id_col, "side"])
    return sums.groupBy(id_col).agg(*[
        F.max(F.when(F.col("side") == side, F.col(f"logp_sum_{name}"))).alias(f"{name}_{side}")
        for name in models for side in ("chosen", "rejected")])


def perplexity_from_tokens(token_logps: DataFrame, keys=("seq_id",), max_len: int = 512,
                           min_tokens: int = 2) -> DataFrame:
    """K2 over a provided token log-prob table (seq_id, pos, logp)."""
    per = (token_logps.where(F.col("pos") < max_len).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"), F.avg(-F.col("logp")).alias("nll"))
           .where(F.col("n") >= min_tokens))
    return per.agg(F.count(F.lit(1)).alias("n_texts"), F.exp(F.avg("nll")).alias("perplexity"))


# G3 ------------------------------------------------------------------------
def join_logps(policy: DataFrame, reference: DataFrame, on: str = "pair_id") -> DataFrame:
    """Policy and reference log-probs per pair (equi-join on the id)."""
    return policy.join(reference, on, "inner")


# K3 / K4 -------------------------------------------------------------------
def rewards(df: DataFrame, beta: float = 0.05) -> DataFrame:
    """K3: implicit rewards beta * (policy - reference) for both sides."""
    b = F.lit(float(beta))
    return df.withColumn("chosen_reward", b * (F.col("pol_chosen") - F.col("ref_chosen"))) \
             .withColumn("rejected_reward", b * (F.col("pol_rejected") - F.col("ref_rejected")))


def reward_margin(df: DataFrame) -> DataFrame:
    """K4: margin = chosen reward - rejected reward."""
    return df.withColumn("margin", F.col("chosen_reward") - F.col("rejected_reward"))


# K5 ------------------------------------------------------------------------
def neg_log_sigmoid(m: Column) -> Column:
    """-log(sigmoid(m)) written so that it never overflows."""
    return F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def dpo_loss(margins: DataFrame) -> DataFrame:
    """K5: mean DPO loss over pairs."""
    return margins.agg(F.count(F.lit(1)).alias("n"),
                       F.avg(neg_log_sigmoid(F.col("margin"))).alias("dpo_loss"))


# K6 ------------------------------------------------------------------------
def fill_failed(pair_ids: DataFrame, logps: DataFrame, on: str = "pair_id",
                models=("pol", "ref")) -> DataFrame:
    """K6: every pair gets log-probs. A model whose scoring of a pair failed
    (no row, or a null on either side) gets 0.0 on both sides of that pair and
    ``<model>_failed``; the other model's values stay. ``failed``: any did."""
    j = pair_ids.select(on).join(logps, on, "left")
    cols, any_failed = [], F.lit(False)
    for m in models:
        failed = F.col(f"{m}_chosen").isNull() | F.col(f"{m}_rejected").isNull()
        cols += [F.when(failed, F.lit(0.0)).otherwise(F.col(c)).alias(c)
                 for c in (f"{m}_chosen", f"{m}_rejected")] + [failed.alias(f"{m}_failed")]
        any_failed = any_failed | failed
    return j.select(on, *cols, any_failed.alias("failed"))


# H8 ------------------------------------------------------------------------
def preference_summary(margins: DataFrame) -> DataFrame:
    """H8: preference accuracy (strictly positive margin) and mean margin."""
    return margins.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        (F.lit(100.0) * F.avg((F.col("margin") > 0).cast("double"))).alias("preference_accuracy_pct"),
        F.avg("margin").alias("mean_margin"))

"""Message-list and token-sequence column functions.

A conversation is ``ARRAY<STRUCT<role STRING, content STRING>>``; a token
sequence is ``ARRAY<STRING>``. Everything here is a native higher-order
function, evaluated per row inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The ChatML template used when a tokenizer has none.
# ---------------------------------------------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
GENERATION_TAIL = IM_START + "assistant\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def message(role, content) -> Column:
    """One message struct."""
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _c(content).alias("content"))


# D1 -------------------------------------------------------------------------
def last_message(messages) -> Column:
    """Last message of a list; null for an empty or null list."""
    return F.try_element_at(_c(messages), F.lit(-1))


def last_content(messages) -> Column:
    return last_message(messages).getField("content")


# D4 -------------------------------------------------------------------------
def render_chatml(messages, add_generation_prompt: bool = False) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>\\n`` per message, optionally
    followed by ``<|im_start|>assistant\\n``. A null role or content is empty:
    the message stays."""
    def filled(m, name):
        return F.coalesce(m.getField(name), F.lit(""))

    body = F.array_join(
        F.transform(_c(messages), lambda m: F.concat(
            F.lit(IM_START), filled(m, "role"), F.lit("\n"),
            filled(m, "content"), F.lit(IM_END + "\n"))),
        "")
    if add_generation_prompt:
        return F.concat(body, F.lit(GENERATION_TAIL))
    return body


# D9 -------------------------------------------------------------------------
def close_sequence(tokens, end: str = IM_END) -> Column:
    """Append ``end`` unless the sequence already ends with it."""
    t = _c(tokens)
    ends = F.coalesce(F.try_element_at(t, F.lit(-1)) == F.lit(end), F.lit(False))
    return F.when(ends, t).otherwise(F.array_append(t, F.lit(end)))


# D10 ------------------------------------------------------------------------
def truncate_tokens(tokens, n: int) -> Column:
    return F.slice(_c(tokens), 1, n)


def whitespace_tokens(text) -> Column:
    """Tokens of the stand-in tokenizer: split on single spaces, empty pieces
    dropped (FD7)."""
    return F.array_remove(F.split(_c(text), " "), "")

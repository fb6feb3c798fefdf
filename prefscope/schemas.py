
from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

CONVERSATION = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("messages", MESSAGES),
])

CONVERSATION_ROW = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])


def pair_schema(lists=(), scores: bool = True) -> T.StructType:
    """Preference pairs; the sides in ``lists`` are message lists."""
    sides = [T.StructField(c, MESSAGES if c in lists else T.StringType())
             for c in ("prompt", "chosen", "rejected")]
    gaps = [T.StructField(c, T.DoubleType()) for c in ("score_chosen", "score_rejected")]
    return T.StructType([T.StructField("pair_id", T.LongType()), *sides, *(gaps if scores else [])])


QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

INSTR_SAMPLE = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("response", T.StringType()),
])
QA_SAMPLE = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("gold", T.StringType()),
    T.StructField("pred", T.StringType()),
    T.StructField("response", T.StringType()),
])

METRIC_BUNDLE = T.StructType([
    T.StructField("perplexity", T.DoubleType()),
    T.StructField("instruction_following_acc_pct", T.DoubleType()),
    T.StructField("gsm8k_acc_pct", T.DoubleType()),
    T.StructField("cot_presence_pct", T.DoubleType()),
    T.StructField("instr_samples", T.ArrayType(INSTR_SAMPLE)),
    T.StructField("gsm8k_samples", T.ArrayType(QA_SAMPLE)),
])

PROMPT_SUITE = T.StructType([
    T.StructField("prompt_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
])

ATTEMPT = T.StructType([
    T.StructField("prompt_id", T.LongType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("raw", T.StringType()),
])

JUDGED = T.StructType([
    T.StructField("prompt_id", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("Base", "SFT", "DPO", "winner", "reason")],
])

# The labels a verdict can carry, in report order.
VERDICT_LABELS = ("Base", "SFT", "DPO", "Tie", "Error")
VALID_VERDICTS = ("Base", "SFT", "DPO", "Tie")

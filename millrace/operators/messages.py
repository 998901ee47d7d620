"""Tagging and trimming of conversation tables."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.values import strip

# Keywords of every tag, in tag order, and the default tag.
TAGS = {
    "registry": ["model", "production", "registry", "version", "accuracy", "compare", "summary"],
    "monitoring": ["monitor", "monitoring", "latency", "metric", "metrics", "today", "status"],
    "prediction": ["prediction", "predict", "explain this prediction", "latest prediction"],
    "health": ["health", "system", "status"],
    "dataset": ["dataset", "feature", "features", "data", "target", "record"],
    "training": ["training", "train", "trained", "training run", "latest training"],
    "explainability": [
        "explain", "why", "important", "feature affect", "affect eta", "feature importance",
        "contributed most", "confidence", "confidence low", "what increased", "what decreased",
    ],
    "drift": ["drift", "shift", "deviation"],
}
DEFAULT_TAG = "health"

# Trigger phrases of every intent, in matching order.
INTENTS = {
    "cancel": ["cancel", "restart", "exit", "quit", "never mind", "nevermind", "stop"],
    "greeting": ["hi", "hello", "hey", "howdy", "greetings", "good morning", "good afternoon", "good evening"],
    "help": ["help", "what can you do", "capabilities", "commands", "what do you do", "how do you work", "options"],
    "explain_prediction": [
        "explain", "explain prediction", "explain latest", "explain last", "why", "why did", "what drove", "what caused",
    ],
    "predict": [
        "predict", "make prediction", "predict eta", "estimate eta", "start prediction", "run prediction",
        "new prediction",
    ],
    "feature_importance": [
        "feature importance", "important features", "top features", "what features", "which features",
        "feature weights", "shap",
    ],
    "model_info": [
        "model", "model info", "model summary", "production model", "current model", "which model", "model version",
        "model metrics", "model performance", "compare models", "model details", "performance", "compare",
    ],
    "dataset_info": [
        "dataset", "data", "training data", "dataset info", "dataset summary", "how many records", "columns",
        "features", "target column", "summarize dataset",
    ],
}
DEFAULT_INTENT = "general_chat"
WHOLE_WORDS = {"predict"}
#: Letters of a one-word trigger that may also stand in the plural; with fewer, another word would arise ("his" from "hi").
PLURAL_FROM = 4
LOW = "__lower"


def _shortest(phrases: list[str]) -> list[str]:
    """Phrases that contain no other one: a text holds any phrase exactly if it holds one of these."""
    return [p for p in phrases if not any(q != p and q in p for q in phrases)]


def _contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in _shortest(phrases)])


def _whole_word(text: Column, words: list[str]) -> Column:
    ends = ["" if len(w) < PLURAL_FROM or w in WHOLE_WORDS else "s?" for w in words]
    return text.rlike(r"\b(" + "|".join(re.escape(w) + end for w, end in zip(words, ends, strict=True)) + r")\b")


def intent_tags(df: DataFrame, text: str) -> DataFrame:
    """Add ``tags``: every tag whose keywords occur in the message, else the default tag.

    The lower-case text is a column of its own, so it is made once per row.
    """
    low = F.col(LOW)
    found = F.array_compact(F.array(*[F.when(_contains_any(low, words), F.lit(tag)) for tag, words in TAGS.items()]))
    tags = F.when(F.size(F.col("tags")) > 0, F.col("tags")).otherwise(F.array(F.lit(DEFAULT_TAG)))
    tagged = df.withColumn(LOW, F.lower(text)).withColumn("tags", found).withColumn("tags", tags)
    return tagged.drop(LOW)


def intent_first(df: DataFrame, text: str, whole_words: bool = True) -> DataFrame:
    """Add ``intent``: the first matching intent.

    One-word triggers match whole words, also in the plural but for short ones
    and "predict", so that neither "which" nor "his" is a greeting;
    ``whole_words=False`` matches them anywhere, except the bare "predict".
    """
    low, chain = F.col(LOW), F
    for intent, phrases in INTENTS.items():
        words = [p for p in phrases if (" " not in p if whole_words else p in WHOLE_WORDS)]
        rest = [p for p in phrases if p not in words]
        tests = ([_whole_word(low, words)] if words else []) + ([_contains_any(low, rest)] if rest else [])
        chain = chain.when(reduce(or_, tests), intent)
    lowered = df.withColumn(LOW, F.lower(strip(F.col(text))))
    return lowered.withColumn("intent", chain.otherwise(DEFAULT_INTENT)).drop(LOW)


def last_n_turns(df: DataFrame, conversation: str, turn: str, n: int = 20) -> DataFrame:
    """The latest ``n`` messages of every conversation, newest ranked 1.

    Spark applies the rank limit in every task before the shuffle, so a very
    long conversation sends at most ``n`` rows per task.
    """
    latest = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return df.withColumn("recency", F.row_number().over(latest)).where(F.col("recency") <= n)

"""Conversation history and the store of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(history: DataFrame, n: int, by: str = "session_id") -> DataFrame:
    """The last n pairs (by, turn, question, answer) of each session; none for n of 0."""
    return history.withColumn("age", F.row_number().over(W.partitionBy(by).orderBy(F.desc("turn")))).where(F.col("age") <= n)


def rendered(history: DataFrame, sessions: DataFrame, by: str = "session_id", header: str = "Previous questions and answers, newest first:\n", pair: str = "Question: {question}\nAnswer: {answer}\n") -> DataFrame:
    """(by, history): the pairs of each session as text, newest first; the empty text without a pair."""
    item = F.replace(F.replace(F.lit(pair), F.lit("{question}"), F.col("question")), F.lit("{answer}"), F.col("answer"))
    text = history.withColumn("item", item).groupBy(by).agg(F.concat(F.lit(header), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "item")), asc=False), lambda x: x["item"]), "")).alias("history"))
    return sessions.select(by).distinct().join(text, by, "left").select(by, F.coalesce("history", F.lit("")).alias("history"))


def pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user's turn with the assistant's that comes next."""
    w = W.partitionBy("conv_id").orderBy("turn")
    said = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return said.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def new_configs(configs: DataFrame, known: DataFrame) -> DataFrame:
    """(config_hash, config) of configurations not yet known; the hash is the MD5 of the JSON."""
    hashed = configs.withColumn("config_hash", F.md5("config")).select("config_hash", "config").distinct()
    return hashed.join(known.select("config_hash"), "config_hash", "left_anti")


def responses(interactions: DataFrame, bridge: DataFrame, sources: DataFrame) -> DataFrame:
    """Each interaction with each of its sources."""
    return interactions.join(bridge, "interaction_id").join(sources, "source_id")


def with_feedback(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """interactions with is_positive and comment replaced where feedback (interaction_id, is_positive, comment) has them."""
    f = feedback.select("interaction_id", F.col("is_positive").alias("_p"), F.col("comment").alias("_c"), F.lit(True).alias("_f"))
    return interactions.join(f, "interaction_id", "left").withColumn("is_positive", F.when(F.col("_f"), F.col("_p")).otherwise(F.col("is_positive"))).withColumn("comment", F.when(F.col("_f"), F.col("_c")).otherwise(F.col("comment"))).drop("_p", "_c", "_f")

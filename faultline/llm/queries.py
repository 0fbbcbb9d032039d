"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    chat_format,
    collocations,
    exact_dedup,
    impact_search,
    language_id,
    line_dedup,
    mixing,
    packing,
    quality_rules,
    simhash_dedup,
    spelling,
    token_orc,
    toxicity,
)
from faultline.llm.shared import Scratch, table, text_of, word_count

#: Sites on which a line must occur before its repeats go.
MIN_SITES = 5
CAPACITY = 4_096
PACK_END, FILE_END = 1, 2
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Tools of the calls that the chat query makes from turns.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "summarise": {"text": ("string", True), "words": ("integer", False)},
}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove(table(spark, sf_dir, "documents"), F.col("source"), MIN_SITES, Scratch(spark))
    return out.select("doc_id", "source", "n_lines", "n_removed", "text")


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, vocabulary(), CAPACITY, PACK_END)
    return packing.pack(pieces, CAPACITY, Scratch(spark)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cutoffs = mixing.plan(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST, Scratch(spark))
    return mixing.times(cutoffs, rows, F.col("place"), F.col("tie")).select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_times")).alias("taken"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), Scratch(spark))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).folder}/tokens"
    token_orc.write(table(spark, sf_dir, "documents"), path, vocabulary(), FILE_END)
    return token_orc.index(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"), 5, 0)
    weights, bias = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, weights, bias).select("doc_id", held.alias("held_out"), "score", "predicted")


def call_id(turn: Column) -> Column:
    return F.concat(F.lit("c"), turn.cast("string"))


def tool_messages(turns: DataFrame) -> DataFrame:
    """Conversations as tool use: each user turn also asks a tool, after the user turn before; the answer is its result.

    Calls with a number of words divisible by 7 lack an argument and those divisible by 5 have one of another type, so
    that validation has something to find.
    """
    turns = turns.withColumn("words", word_count(text_of()))
    query = F.struct(F.col("text").alias("query"), F.col("words").alias("limit"))
    wrong = F.struct(F.col("text").alias("query"), F.col("words").cast("string").alias("limit"))
    short = F.struct(F.col("text").alias("query"))
    long_ = F.struct(F.col("text").alias("text"), F.col("words").alias("words"))

    def call(name: str, arguments: Column) -> Column:
        after = F.when(F.col("turn") >= 2, F.array(call_id(F.col("turn") - 2)))
        one = F.struct(call_id(F.col("turn")).alias("id"), F.lit(name).alias("name"), arguments.alias("arguments"), after.alias("after"))
        return F.to_json(F.struct(F.array(one).alias("tool_calls")))

    many = F.col("words") % 7 == 0
    calls = F.when(F.col("words") > 40, call("summarise", long_)).when(many, call("search", short))
    calls = calls.when(F.col("words") % 5 == 0, call("search", wrong)).otherwise(call("search", query))
    plain = turns.where("role <> 'assistant' OR role IS NULL").select("conv_id", F.col("turn") * 2, "role", "text")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn") * 2 + 1, F.lit("assistant"), calls)
    content = F.struct(call_id(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    told = turns.where("role = 'assistant'").select("conv_id", F.col("turn") * 2, F.lit("tool"), F.to_json(content))
    return plain.union(asked).union(told).toDF("conv_id", "turn", "role", "text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link(tool_messages(table(spark, sf_dir, "conversations")), SCHEMAS, Scratch(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), Scratch(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"), Scratch(spark))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", impact_search.whole_numbers().alias("x"))
    return impact_search.search(vectors, F.col("vec_id") % 20 == 0, 20, Scratch(spark))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), Scratch(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_best_fit_packing,
        op3_language_id,
        op4_source_mixing,
        op5_exact_dedup,
        op6_token_orc,
        op7_toxicity,
        op8_chat_format,
        op9_quality_rules,
        op10_simhash_dedup,
        op11_impact_search,
        op12_spelling_variants,
        op13_collocations,
    )
}

"""The thin op queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from skarn.llm import chat, decontaminate, language, license, packing, pii, quality, simhash, tokenfile, unigram
from skarn.sources.tables import table


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return tokenfile.token_files(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return unigram.token_counts(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op10_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_chat(spark, sf_dir):
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :text), (-1L, 1L, 'assistant', :text) AS t(conv_id, turn, role, text)", args={"text": chat.PROBE})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_conversations(chat.events_of_turns(turns)))


def op1_license(spark, sf_dir):
    return license.scan(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    """Both tables that have a language to find: documents and pages, told apart by kind."""
    documents = table(spark, sf_dir, "documents")
    model = language.fit(language.labelled_sample(documents))
    sources = language.evidence_of_documents(documents).unionByName(language.evidence_of_pages(table(spark, sf_dir, "pages")))
    return language.identify(sources, model)


QUERIES = {"op1_license": op1_license, "op2_quality": op2_quality, "op4_chat": op4_chat, "op6_language": op6_language, "op3_simhash": op3_simhash, "op5_packing": op5_packing, "op7_token_files": op7_token_files, "op8_decontaminate": op8_decontaminate, "op9_token_counts": op9_token_counts, "op10_pii": op10_pii}
ORACLES = {"op2_quality": quality.ORACLE, "op4_chat": chat.ORACLE, "op8_decontaminate": decontaminate.ORACLE}


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES

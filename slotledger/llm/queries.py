"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from slotledger.llm import alignment, ann, bpe, chat, html, lm, mixing, negatives, packing, quality, secrets, simhash, urls
from slotledger.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.linked(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark, sf_dir):
    return chat.digests(chat.formatted(chat.with_conflict(spark, table(spark, sf_dir, "conversations"))))


def op6_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    return lm.scored(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings")).drop("rows_met")


def op13_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_html_extraction, op3_simhash_near_dedup, op4_packing, op5_chat_formatting, op6_secret_scans, op7_lm_scoring, op8_byte_bpe, op9_nearest_neighbours, op10_url_filters, op11_source_mixing, op12_hard_negatives, op13_token_alignment)}
ORACLES = {"op5_chat_formatting": chat.ORACLE, "op10_url_filters": urls.ORACLE, "op11_source_mixing": mixing.ORACLE, "op12_hard_negatives": negatives.ORACLE}

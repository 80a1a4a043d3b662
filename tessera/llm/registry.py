"""The queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from tessera.llm import chat_format, decontamination, lm_scoring, ngram_join, packing, pii, quality_classifier, quality_rules, sharding, warc
from tessera.llm.common import table


def op4_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op1_ngram_join(spark, sf_dir):
    return ngram_join.linked(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op2_lm_scoring(spark, sf_dir):
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark, sf_dir):
    return decontamination.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark, sf_dir):
    return pii.found(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_chat_format(spark, sf_dir):
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_ngram_join, op2_lm_scoring, op3_quality_rules, op4_sharding, op5_packing, op6_quality_classifier, op7_decontamination, op8_pii, op9_warc, op10_chat_format)}


#: What the archives say of each page, by plain SQL over the pages.
OP9_WARC = """
WITH s AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM s WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM s LEFT JOIN f USING (payload_digest)
"""


#: All pairs that share a shingle, and whatever their links reach.
OP1_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 90 * (len(x.sh) + len(y.sh) - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM r JOIN both_ways ON a = r.doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(c) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, sh
"""


def oracles() -> dict:
    return {k: v for k, v in {"pipeline": corpus_pipeline.ORACLE_SQL, "op1_ngram_join": OP1_NGRAM_JOIN, "op9_warc": OP9_WARC}.items() if v}

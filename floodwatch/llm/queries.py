"""One query per operator over the whole test tables; the digest columns are derived from the operators' outputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fill_middle, html_text, language, lexical_search, ngram_trie, pii, quality, simhash, suffix_repeats, toxicity
from .common import read, short_batches

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.learn(docs, read(spark, sf_dir, "labels"), learnable=~toxicity.held_out("doc_id"))
    return toxicity.score(docs, index).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.add_component(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(fixed).alias("text"))
    return chat.format_chats(rows.unionByName(probe)).select("conv_id", *(c.alias(k) for k, c in chat.digests().items()))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.learn(docs)).drop("text")
    return found.select("doc_id", *(c.alias(k) for k, c in pii.digests().items()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "p_good")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.held_out("doc_id", 7, 2)
    scored = ngram_trie.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(c.alias(k) for k, c in decontaminate.digests().items()))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_repeats.find_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(c.alias(k) for k, c in suffix_repeats.digests().items()))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(spark, f"{TOKENIZERS}/byte_bpe_50k.json")
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    return bpe.decode(coded, vocabulary).select("doc_id", *(c.alias(k) for k, c in bpe.digests(coded).items()))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", *(c.alias(k) for k, c in fill_middle.digests().items()))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = toxicity.held_out("doc_id", 4, 2)
    model = language.learn(docs, language.load(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"), ~held)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _short(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _short(f) for f in (op1_toxicity, op2_simhash, op3_chat_formatting, op4_pii, op5_quality, op6_lm_score, op7_decontaminate, op8_suffix_dedup, op9_html_text, op10_bpe, op11_lexical_search, op12_fill_middle, op13_language)}

_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(\|start\|>|\|text\|>|\|next\|>|\|end\|>|s>|/s>|INST\]|/INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2\3', 'g')"

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DRAW = "CAST('0x' || digest[{0}:{1}] AS BIGINT)"

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op11_lexical_search": f"""
        WITH docs AS (SELECT *, CAST(len(t) AS BIGINT) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
        items AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        asked AS (SELECT qid, item_id, term, count(*) AS q FROM (SELECT qid, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
        counts AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term),
        scored AS (SELECT qid, item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
                   FROM asked JOIN counts USING (term) JOIN weights USING (term), whole GROUP BY ALL)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST) AS r FROM scored WHERE score > 0) WHERE r <= 10""",
    "op12_fill_middle": f"""
        WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                            regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
        drawn AS (SELECT *, len(u) AS n, {', '.join(f"{_DRAW.format(8 * k + 1, 8 * k + 8)} AS h{k + 1}" for k in range(4))} FROM cut),
        formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                               WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
    "op7_decontaminate": f"""
        WITH items AS (SELECT item, w, least(len(w), 10) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
        docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
            SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
        found AS (SELECT rid, item, n, i FROM places JOIN windows USING (n, s)),
        hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY rid),
        named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)""",
    "op3_chat_formatting": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        marked AS (
            SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens, length({_ESCAPED.format('text')}) + 8 AS text_chars,
                   length({_ESCAPED.format('role')}) + 17 AS open_chars
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(text_chars + CASE WHEN opens THEN open_chars - 1 ELSE 0 END)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
}

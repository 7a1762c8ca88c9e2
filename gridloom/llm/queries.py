"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, clusters, exact, fingerprints, html, langid, lines, mixing, quality, quantiles, sharding, simhash
from .common import table


def op1_document_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts: ``fingerprints.edit_pairs``, with its handling of nulls and ties."""
    return fingerprints.edit_pairs(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and class of every document: ``simhash.near_duplicates``; null texts have the fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark, sf_dir):
    """Every message of all conversations with its links and place: ``chat.conversations``; null ids and turns stay null."""
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark, sf_dir):
    """Every document without its source's boilerplate lines: ``lines.report``; null texts stay null, null sources are one."""
    return lines.report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    """Perplexity and decision for every document; trusted are those labelled good and not toxic. Null labels are not. See ``quality.classify``."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op6_exact_dedup(spark, sf_dir):
    """The row that stays for each document: ``exact.exact_dedup``. Null texts count as empty; rows that repeat an id are one document and share its decision."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op7_byte_level_bpe(spark, sf_dir):
    """Digests of every document's ids and of what they decode to: ``bpe.round_trip``; null texts count as empty."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark, sf_dir):
    """The main text of every page: ``html.extract``; null pages have the empty text."""
    return html.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark, sf_dir):
    """The language of every document, learned from those that are not held out: ``langid.identify``; null texts are ``und``. Null ids count as the empty string when documents are dealt."""
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_source_mixing(spark, sf_dir):
    """A row for each use of a document in the mix: ``mixing.report``; null languages and sources count as "(none)"."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op11_quantile_summaries(spark, sf_dir):
    """Quantiles of clicks by client and of prices by brand, of batches and of what their summaries say of the whole: ``quantiles.report``, with its handling of nulls."""
    return quantiles.report(*(table(spark, sf_dir, name) for name in ("clicks", "sale_lines", "items")))


def op12_virtual_slot_sharding(spark, sf_dir):
    """The shard of every document, sizes near equal: ``sharding.report``; null texts have eight bytes."""
    return sharding.report(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark, sf_dir):
    """Cluster and distance of every usable vector: ``clusters.report``; null, short and non-finite vectors are left out."""
    return clusters.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_simhash_near_dedup, op3_chat_formatting, op4_line_dedup, op5_quality_classifier, op6_exact_dedup, op7_byte_level_bpe, op8_html_extraction, op9_language_id, op10_source_mixing, op11_quantile_summaries, op12_virtual_slot_sharding, op13_centroid_clustering)}

SQL = {
    "op4_line_dedup": lines.SQL,
    "op6_exact_dedup": """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*)::bigint as group_size, sha256(norm) as text_sha256 from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (norm)
""",
    "op10_source_mixing": mixing.SQL,
    "op11_quantile_summaries": quantiles.SQL,
    "op13_centroid_clustering": clusters.sql(),
}

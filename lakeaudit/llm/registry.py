"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lakeaudit.llm import html_cut, jaccard_join, language_id, license_scan, line_quality, max_score, merkle_manifest, mixing, packing, quality_classifier, secret_links, sharding, vector_codes


def queries() -> dict:
    return {
        "op1_secret_links": secret_links.op1_secret_links,
        "op2_language_id": language_id.op2_language_id,
        "op3_html_cut": html_cut.op3_html_cut,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_line_quality": line_quality.op6_line_quality,
        "op7_pack_sequences": packing.op7_pack_sequences,
        "op8_max_score": max_score.op8_max_score,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
        "op13_kd_shards": sharding.op13_kd_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_links": secret_links.OP1_SQL,
        "op5_license_scan": license_scan.OP5_SQL,
        "op6_line_quality": line_quality.OP6_SQL,
        "op8_max_score": max_score.OP8_SQL,
        "op9_mix_sources": mixing.OP9_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    }

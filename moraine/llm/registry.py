"""The training-data queries and their DuckDB oracles."""

from __future__ import annotations

from moraine.llm import bpe, decontaminate, divergence, license_scan, line_dedup, mpeg_audio, ranked_search, sentencepieces, sharding, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_media_mpeg_audio": mpeg_audio.op4_media_mpeg_audio,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe_codec": bpe.op8_bpe_codec,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_rendezvous_sharding": sharding.op10_rendezvous_sharding,
    "op11_sentencepiece_codec": sentencepieces.op11_sentencepiece_codec,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op2_warc_derivatives": warc.oracle(),
    "op12_ranked_search": ranked_search.oracle(),
    "op13_source_divergence": divergence.oracle(),
}

"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from tidewire.llm import ann, decontaminate, merkle, neardup, packing, phrases, pii, quality, repeats, sharding, toxicity, urlfilter, warc

QUERIES = {
    "op1_leaks": decontaminate.op1_leaks,
    "op2_packing": packing.op2_packing,
    "op3_neighbours": ann.op3_neighbours,
    "op4_warc": warc.op4_warc,
    "op5_quality": quality.op5_quality,
    "op6_urls": urlfilter.op6_urls,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_toxicity": toxicity.op8_toxicity,
    "op10_pii": pii.op10_pii,
    "op9_shards": sharding.op9_shards,
    "op11_phrases": phrases.op11_phrases,
    "op12_repeats": repeats.op12_repeats,
    "op13_manifest": merkle.op13_manifest,
}

ORACLES = {"op4_warc": warc.OP4_SQL, "op6_urls": urlfilter.OP6_SQL, "op7_near_duplicates": neardup.OP7_SQL, "op9_shards": sharding.OP9_SQL, "op11_phrases": phrases.OP11_SQL, "op12_repeats": repeats.OP12_SQL, "op13_manifest": merkle.OP13_SQL}

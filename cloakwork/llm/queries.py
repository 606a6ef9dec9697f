"""The queries of the corpus operators, by name."""

from cloakwork.llm.decontamination import op7_benchmark_hits
from cloakwork.llm.fingerprints import op4_scaled_sketch
from cloakwork.llm.language_id import op5_language_evidence
from cloakwork.llm.licenses import op6_license_digests
from cloakwork.llm.mixing import op3_source_mix
from cloakwork.llm.near_dedup import op2_hyperminhash_groups
from cloakwork.llm.oracles import ORACLES
from cloakwork.llm.quality import op9_pairwise_quality
from cloakwork.llm.secrets import op1_secret_automaton
from cloakwork.llm.sharding import op8_interleaved_shards
from cloakwork.llm.url_filters import op10_url_rules

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_automaton,
        op2_hyperminhash_groups,
        op3_source_mix,
        op4_scaled_sketch,
        op5_language_evidence,
        op6_license_digests,
        op7_benchmark_hits,
        op8_interleaved_shards,
        op9_pairwise_quality,
        op10_url_rules,
    )
}

__all__ = ["ORACLES", "QUERIES"]

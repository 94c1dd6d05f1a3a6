"""The registered queries of this subpackage and their DuckDB SQL."""

from . import alignment, decontamination, langid, mixing, negatives, packing, pii, sharding, simhash, substrings, topk, toxicity, urls

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_language": langid.op2_language,
    "op3_packing": packing.op3_packing,
    "op4_url_vocabulary": urls.op4_url_vocabulary,
    "op5_external_shuffle": sharding.op5_external_shuffle,
    "op6_simhash": simhash.op6_simhash,
    "op7_pseudonyms": pii.op7_pseudonyms,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_trees": substrings.op10_suffix_trees,
    "op11_mixing": mixing.op11_mixing,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op1_top_k": topk.OP1_SQL, "op11_mixing": mixing.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}

"""The registered queries of the llm operators."""

from __future__ import annotations

from gatehouse.llm import alignment, chat, fingerprints, hosts, infill, mixing, neardup, packing, pii, quality, suffixes, toxicity, vectors
from gatehouse.llm.oracles import ORACLES

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_minhash": neardup.op5_minhash,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_chat": chat.op9_chat,
    "op10_vectors": vectors.op10_vectors,
    "op11_infill": infill.op11_infill,
    "op12_alignment": alignment.op12_alignment,
    "op13_hosts": hosts.op13_hosts,
}

#: Sketches, models, tokenizers and packing are beyond SQL; those queries are tested against brute force in tests/llm.
__all__ = ["ORACLES", "QUERIES"]

"""Registered queries of this package, and their SQL where SQL can express them."""

from semspark.llm.bpe_codec import op7_bpe_codec
from semspark.llm.chat import OP8_SQL, op8_chat
from semspark.llm.decontaminate import OP9_SQL, op9_decontaminate
from semspark.llm.negatives import OP11_SQL, op11_hard_negatives
from semspark.llm.packing import op12_packing
from semspark.llm.quality import op5_quality
from semspark.llm.shingles import OP3_SQL, op3_shingles
from semspark.llm.substrings import OP2_SQL, op2_substrings
from semspark.llm.token_counts import op6_token_counts
from semspark.llm.toxicity import op1_toxicity
from semspark.llm.variants import op13_variants
from semspark.llm.vectors import OP4_SQL, op4_vectors
from semspark.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substrings": op2_substrings,
    "op3_shingles": op3_shingles,
    "op4_vectors": op4_vectors,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_chat": op8_chat,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_variants": op13_variants,
}

SQL = {
    "op2_substrings": OP2_SQL,
    "op3_shingles": OP3_SQL,
    "op4_vectors": OP4_SQL,
    "op8_chat": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
}

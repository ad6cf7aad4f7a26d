"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from cladeframe.llm import bpe, chat, collocations, exact_dedup, line_dedup, minhash_dedup, mixing, packing, quality, repair, simple8b, substring, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_simple8b": simple8b.op3_simple8b,
    "op4_substring": substring.op4_substring,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_warc": warc.op7_warc,
    "op8_best_fit": packing.op8_best_fit,
    "op9_chat": chat.op9_chat,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_repair": repair.op11_repair,
    "op12_mixing": mixing.op12_mixing,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_substring": substring.ORACLE,
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_chat": chat.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_repair": repair.ORACLE,
    "op13_collocations": collocations.ORACLE,
}

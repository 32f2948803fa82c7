"""The numbered queries over the documents and embeddings tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from folioscope.llm.bpe import op10_bpe
from folioscope.llm.decontaminate import op8_decontaminate
from folioscope.llm.lines import OP4_SQL, op4_lines
from folioscope.llm.media import op1_mpeg_audio
from folioscope.llm.quality import op7_quality
from folioscope.llm.ranked import op11_ranked_search
from folioscope.llm.shards import op5_shards
from folioscope.llm.simhash import op2_simhash
from folioscope.llm.substrings import op3_substrings
from folioscope.llm.suffixes import op6_suffixes
from folioscope.llm.tokens import op9_token_files
from folioscope.llm.vectors import op13_near_vectors
from folioscope.llm.whitening import op12_whitening

QUERIES = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_lines": op4_lines,
    "op5_shards": op5_shards,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_ranked_search": op11_ranked_search,
    "op12_whitening": op12_whitening,
    "op13_near_vectors": op13_near_vectors,
}

ORACLES: dict[str, str] = {
    "op4_lines": OP4_SQL,
}

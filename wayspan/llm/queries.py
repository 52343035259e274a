"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wayspan.llm.chat import ORACLE as OP2_SQL
from wayspan.llm.chat import op2_reply_trees
from wayspan.llm.decontamination import ORACLE as OP6_SQL
from wayspan.llm.decontamination import op6_suffix_decontamination
from wayspan.llm.divergence import ORACLE as OP11_SQL
from wayspan.llm.divergence import op11_source_divergence
from wayspan.llm.licenses import op1_license_scan
from wayspan.llm.lines import ORACLE as OP12_SQL
from wayspan.llm.lines import op12_line_dedup
from wayspan.llm.mixing import op4_raked_mixture
from wayspan.llm.neardup import op10_hyperminhash
from wayspan.llm.personal import op9_skip_chain
from wayspan.llm.quality import ORACLE as OP8_SQL
from wayspan.llm.quality import op8_mcd_quality
from wayspan.llm.sharding import op5_jump_hash
from wayspan.llm.suffixes import op7_longest_previous_factor
from wayspan.llm.vectorcodes import ORACLE as OP13_SQL
from wayspan.llm.vectorcodes import op13_vector_codes
from wayspan.llm.warc import op3_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_reply_trees": op2_reply_trees,
    "op3_warc": op3_warc,
    "op4_raked_mixture": op4_raked_mixture,
    "op5_jump_hash": op5_jump_hash,
    "op6_suffix_decontamination": op6_suffix_decontamination,
    "op7_longest_previous_factor": op7_longest_previous_factor,
    "op8_mcd_quality": op8_mcd_quality,
    "op9_skip_chain": op9_skip_chain,
    "op10_hyperminhash": op10_hyperminhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_reply_trees": OP2_SQL,
    "op6_suffix_decontamination": OP6_SQL,
    "op8_mcd_quality": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}

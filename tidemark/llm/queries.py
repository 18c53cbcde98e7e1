"""The queries of this subpackage, by name; SQL is given where DuckDB can express the whole result."""

from __future__ import annotations

from .html_extraction import OP12_SQL, op12_html_extraction
from .lexical_search import OP11_SQL, op11_lexical_search
from .mixing import op8_mixing
from .mpeg_audio import op7_mpeg_audio
from .packing import op6_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_crf import op5_quality_crf
from .quality_rules import op10_quality_rules
from .secret_scan import op2_secret_scan
from .simhash_dedup import op9_simhash_dedup
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_crf": op5_quality_crf,
    "op6_packing": op6_packing,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_mixing": op8_mixing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_html_extraction": op12_html_extraction,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The first ten are not wholly expressible: models, automata, XXH64, media bytes, seeded draws.
ORACLE_SQL: dict[str, str] = {"op11_lexical_search": OP11_SQL, "op12_html_extraction": OP12_SQL, "op13_prefix_trie": OP13_SQL}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from evidra.llm import sql
from evidra.llm.anagrams import op12_spelling_variants
from evidra.llm.fingerprints import op9_fingerprints
from evidra.llm.html_text import op2_html_text
from evidra.llm.jaccard import op5_jaccard
from evidra.llm.neighbours import op10_nearest
from evidra.llm.packing import op8_packing
from evidra.llm.perplexity import op11_quality_rules
from evidra.llm.pieces import op6_pieces
from evidra.llm.prefix_trie import op13_prefix_trie
from evidra.llm.quality import op4_quality
from evidra.llm.secrets import op1_secret_scan
from evidra.llm.sharding import op3_sharding
from evidra.llm.warc import op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_html_text, op3_sharding, op4_quality, op5_jaccard, op6_pieces, op7_warc, op8_packing, op9_fingerprints, op10_nearest,
        op11_quality_rules, op12_spelling_variants, op13_prefix_trie,
    )
}
SQL: dict[str, str] = sql.ORACLES

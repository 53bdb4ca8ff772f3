"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from packetloom.llm.hardnegatives import OP12_SQL, op12_hard_negatives
from packetloom.llm.hilbert import op1_nearest
from packetloom.llm.language import op8_language
from packetloom.llm.media import op2_media
from packetloom.llm.oneperm import op11_fingerprints
from packetloom.llm.packing import op10_pack
from packetloom.llm.pii import op3_pii
from packetloom.llm.piececount import op7_token_counts
from packetloom.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from packetloom.llm.simhash import op4_simhash
from packetloom.llm.toxicity import op5_toxicity
from packetloom.llm.urls import OP9_SQL, op9_url_filter
from packetloom.llm.wordbpe import op6_bpe_codec

QUERIES = {
    f.__name__: f
    for f in (op1_nearest, op2_media, op3_pii, op4_simhash, op5_toxicity, op6_bpe_codec, op7_token_counts, op8_language, op9_url_filter, op10_pack, op11_fingerprints, op12_hard_negatives, op13_prefix_trie)
}
SQL: dict[str, str] = {"op9_url_filter": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}

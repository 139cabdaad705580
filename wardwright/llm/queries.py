"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from wardwright.llm import cover_tree, phrases, url_filter, warc
from wardwright.llm.alignment import op13_tokenizer_alignment
from wardwright.llm.bpe import op10_byte_bpe
from wardwright.llm.decontaminate import op1_decontamination
from wardwright.llm.embeddings import op8_embedding_forest
from wardwright.llm.langid import op4_language_id
from wardwright.llm.secret_scan import op3_secret_scan
from wardwright.llm.sharding import op6_histogram_shards
from wardwright.llm.simhash import op7_simhash
from wardwright.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_simhash": op7_simhash,
    "op8_embedding_forest": op8_embedding_forest,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_toivonen_phrases": phrases.op11_toivonen_phrases,
    "op12_cover_tree_topk": cover_tree.op12_cover_tree_topk,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
#: The others are models, iterations or decoders that SQL does not express; tests hold them against brute force.
SQL = {"op2_url_filter": url_filter.SQL, "op5_warc": warc.SQL, "op11_toivonen_phrases": phrases.SQL, "op12_cover_tree_topk": cover_tree.SQL}

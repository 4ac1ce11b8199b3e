"""The queries of this subpackage and the SQL that some of them can be held against."""

from .chat import OP3_SQL, op3_chat_format
from .embeddings import OP2_SQL, op2_near_vectors
from .fingerprints import EDITED_DIGESTS_SQL, edited_digests, op12_fingerprints
from .html_main import op6_html_extraction
from .jaccard import OP5_SQL, op5_jaccard_join
from .media import MEDIA_DIGESTS_SQL, media_digests, op7_media
from .packing import op8_best_fit_packing
from .pieces import op4_sentencepiece
from .quality import op9_quality
from .repair import op13_conversation_repair
from .runs import op11_periodic_runs
from .substring import OP1_SQL, op1_substring_dedup
from .urls import URL_RULES_SQL, op10_url_filter, url_rules

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_vectors": op2_near_vectors,
    "op3_chat_format": op3_chat_format,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_media": op7_media,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fingerprints": op12_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
    "media_digests": media_digests,
    "url_rules": url_rules,
    "edited_digests": edited_digests,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op2_near_vectors": OP2_SQL, "op3_chat_format": OP3_SQL, "op5_jaccard_join": OP5_SQL, "media_digests": MEDIA_DIGESTS_SQL, "url_rules": URL_RULES_SQL, "edited_digests": EDITED_DIGESTS_SQL}

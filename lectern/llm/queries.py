"""Queries of this package and their SQL, by name."""

from .decontaminate import OP1_SQL, op1_decontamination
from .fingerprint import op9_fingerprint
from .langid import op8_language_id
from .linededup import op7_line_dedup
from .mixing import op6_mixing
from .quality import op2_quality
from .secrets import OP4_SQL, op4_secrets
from .simhash import op10_simhash
from .urlfilter import OP3_SQL, op3_url_filter
from .warc import OP5_SQL, op5_warc

QUERIES = {"op6_mixing": op6_mixing, "op5_warc": op5_warc, "op4_secrets": op4_secrets, "op3_url_filter": op3_url_filter, "op9_fingerprint": op9_fingerprint, "op8_language_id": op8_language_id, "op2_quality": op2_quality, "op7_line_dedup": op7_line_dedup, "op10_simhash": op10_simhash, "op1_decontamination": op1_decontamination}
SQL = {"op5_warc": OP5_SQL, "op4_secrets": OP4_SQL, "op3_url_filter": OP3_SQL, "op1_decontamination": OP1_SQL}

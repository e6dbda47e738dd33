"""All registered queries of this subpackage."""

from lexspan.llm import bag_minhash, chat_format, cross_polytope, filter_audit, language_id, mixing, pieces, pii, quality_network, quality_rules, secret_scan, source_audit, warc_index  # noqa: F401
from lexspan.llm.common import ORACLES, QUERIES  # noqa: F401

"""All registered queries of this package."""
from roamlog.llm import additive, bpe, decontaminate, hmm, html, interactions, licenses, minhash, quality, secrets, suffixes, tokenids, treap  # noqa: F401
from roamlog.llm.common import ORACLES, QUERIES  # noqa: F401

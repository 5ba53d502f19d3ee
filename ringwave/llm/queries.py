"""Imports every operator so that its query is registered."""
from ringwave.llm import chat, decontaminate, fingerprint, language, licences, mixing, packing, phrases, pii, simhash, substrings, toxicity, trie  # noqa: F401
from ringwave.llm.registry import ORACLE, QUERIES  # noqa: F401

"""All registered queries of the subpackage."""

from __future__ import annotations

from impressa.llm.registry import QUERIES


def load_all():
    # importing the modules registers their queries
    from impressa.llm import collocations, context_mix, decontaminate, ftrl_quality, merkle_manifest, mincut_html, mixture, quality_rules, setsketch, subword_toxicity, suffix_dedup, surrogates, tokens  # noqa: F401
    return QUERIES

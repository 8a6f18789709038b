"""Engine settings: defaults, the production profile and files that overlay them."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

#: The default profile.
DEFAULTS: dict[str, Any] = {
    "max_candidates": 120, "score_floor": 0.4, "base_links_per_page": 3, "max_links_per_page": 12, "max_anchors_per_target": 2, "title_bm25_norm": 8.0, "body_bm25_norm": 12.0,
    "quality_wordcount_norm": 800.0, "max_inlinks": 50.0, "max_click_depth": 6.0, "freshness_half_life_days": 90.0, "product_wordcount_min": 250, "allow_cross_language": False,
    "weights": {
        "f_title_bm25": 1.4, "f_body_bm25": 1.1, "f_semantic": 1.2, "f_entity_overlap": 1.5, "f_tag_overlap": 0.9, "f_taxonomy_distance": 0.7,
        "f_authority": 0.8, "f_click_depth": 0.7, "f_conversion_intent": 0.6, "f_freshness": 0.4, "f_lang_match": 0.5, "f_quality": 0.8,
    },
    "penalties": {"f_duplicate_risk": 2.5, "f_lang_mismatch": 1.0},
}
#: The production profile's differences.
PRODUCTION: dict[str, Any] = {
    "score_floor": 0.45, "quality_wordcount_norm": 900.0, "max_inlinks": 80.0,
    "weights": {
        "f_title_bm25": 1.6, "f_body_bm25": 1.2, "f_semantic": 1.1, "f_entity_overlap": 1.7, "f_tag_overlap": 0.9, "f_taxonomy_distance": 0.7,
        "f_authority": 0.8, "f_click_depth": 0.8, "f_conversion_intent": 0.6, "f_freshness": 0.5, "f_lang_match": 0.6, "f_quality": 0.9,
    },
    "penalties": {"f_duplicate_risk": 2.4, "f_lang_mismatch": 1.2},
}


def overlay(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; mappings merge key by key, at any depth."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def settings(over: dict[str, Any] | None = None, **values: Any) -> dict[str, Any]:
    return overlay(overlay(DEFAULTS, over or {}), values)


def load_settings(path: str, **values: Any) -> dict[str, Any]:
    """Settings of a YAML file over the defaults; ``values`` come last."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f) or {}, **values)

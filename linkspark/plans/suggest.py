"""The link-suggestion plan: relevance, guardrails, features, anchors and choice."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators import relevance as R
from linkspark.operators.blocks import FACTS, coded, field_alone
from linkspark.operators.corpus import prepared, with_defaults
from linkspark.operators.selection import greedy_links, link_metrics
from linkspark.plans.config import settings
from linkspark.workspace import materialise

AS_OF = "2025-01-01T00:00:00Z"

#: Of evaluated pairs what choice, roles, diagnostics and their readers want, besides the source's words and the target's url.
KEPT = "src tgt rank recall score reason anchors placement risk_flags role".split()


def evaluate(sources: DataFrame, corpus: DataFrame, config: dict[str, Any], as_of: str = AS_OF) -> DataFrame:
    """Candidate pairs of prepared pages that have an anchor and pass every gate,
    with score, reason, anchors, flags, placement and role."""
    pairs = R.linkable(sources, corpus, config).where(R.guardrails(config))
    pairs = R.scored(pairs, config, as_of).where(F.col("score") >= float(config["score_floor"]))
    pairs = pairs.withColumn("risk_flags", R.risk_flags(config)).where(~(F.array_contains("risk_flags", "lang_mismatch") & (F.col("f_semantic") < 0.18)))
    return pairs.withColumns({"placement": R.placement(), "role": R.role()})


def ready(pages: DataFrame, texts: bool = True) -> DataFrame:
    """Raw pages as scoring and choice read them, written once; without ``texts`` nothing of their size."""
    made = coded(prepared(with_defaults(pages))).drop("title_tokens", "body_tokens")
    return materialise(made if texts else made.drop("text"), "pages")


def ready_field(pages: DataFrame, field: str) -> DataFrame:
    """:func:`ready` with what scoring reads of titles or texts (``body``) alone."""
    return materialise(field_alone(coded(prepared(with_defaults(pages))), field).select(*FACTS, "is_review", "is_guide", "is_product", "open"), field)


def batch(sources: DataFrame, corpus: DataFrame | None = None, config: dict[str, Any] | None = None, as_of: str = AS_OF) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(links, evaluated, sources, corpus)`` of raw page tables; without ``corpus`` the sources are it."""
    config = config or settings()
    target = ready(sources if corpus is None else corpus)
    own = target if corpus is None else ready(sources)
    evaluated = materialise(evaluate(own, target, config, as_of).select(*KEPT, F.struct("s.n_words").alias("s"), F.struct("t.url").alias("t")), "evaluated")
    return greedy_links(evaluated, config), evaluated, own, target


def suggest_links(sources: DataFrame, corpus: DataFrame | None = None, config: dict[str, Any] | None = None, as_of: str = AS_OF) -> DataFrame:
    """Ranked links of each source page into the corpus."""
    return batch(sources, corpus, config, as_of)[0]


def dry_run(pages: DataFrame, config: dict[str, Any] | None = None, as_of: str = AS_OF) -> DataFrame:
    """One row of diagnostics for linking a corpus with itself."""
    return link_metrics(*batch(pages, None, config, as_of))

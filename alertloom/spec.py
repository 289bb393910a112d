"""Column roles, expected schema and default parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

# --- Fixed values: they decide the results and must stay as they are. -------

EXPECTED_COLUMNS = """
decision.decision decision.last_action decision.options decision.reviewer_comments
hit.Organization hit.account_number hit.beneficiary hit.bic_code hit.city hit.country
hit.fuzzy_match_score hit.hit_id hit.hit_type hit.is_pep hit.matching_text hit.matching_type
hit.mt_type hit.priority hit.review_comments hit.review_decision hit.score hit.sender
hit.severity hit.state hit.tag hit.watchlist_text message_id
mt103.account_number mt103.beneficiary mt103.bic_code mt103.city mt103.country mt103.dob
mt103.hits_count_103 mt103.mt_type mt103.national_id mt103.organization mt103.origin
mt103.passport mt103.reference mt103.sanction_list mt103.sender mt103.state mt103.street
mt103.synonyms.city mt103.synonyms.country mt103.synonyms.name mt103.synonyms.organization
mt103.transaction_reference_number mt103.transaction_type
mt202.amount
mt202.beneficiary_institution.address.city mt202.beneficiary_institution.address.country
mt202.beneficiary_institution.address.street mt202.beneficiary_institution.bic
mt202.beneficiary_institution.name
mt202.charges mt202.currency mt202.hits_count_202 mt202.instruction_code
mt202.intermediary_institution.bic mt202.intermediary_institution.name mt202.mt_type
mt202.ordering_institution.address.city mt202.ordering_institution.address.country
mt202.ordering_institution.address.street mt202.ordering_institution.bic
mt202.ordering_institution.name
mt202.related_reference mt202.sender_to_receiver_info mt202.transaction_reference_number
mt202.value_date
""".split()

HIT_TARGETS = ("hit.review_decision", "hit.review_comments")
MESSAGE_TARGETS = ("decision.last_action", "decision.reviewer_comments")
TEXT_COLUMNS = (
    "hit.matching_text",
    "hit.watchlist_text",
    "mt103.sanction_list",
    "hit.review_comments",
    "decision.reviewer_comments",
)
CATEGORICAL_COLUMNS = (
    "hit.is_pep",
    "hit.hit_type",
    "hit.matching_type",
    "hit.priority",
    "hit.severity",
    "hit.country",
    "hit.mt_type",
    "mt103.country",
    "mt103.transaction_type",
    "mt202.currency",
    "mt202.instruction_code",
    "hit.review_decision",
    "decision.last_action",
)
NUMERIC_COLUMNS = (
    "hit.score",
    "hit.fuzzy_match_score",
    "mt202.amount",
    "mt103.hits_count_103",
    "mt202.hits_count_202",
    "mt202.charges",
)
BASE_REQUIRED = (
    "hit.matching_text",
    "hit.score",
    "hit.hit_type",
    "hit.matching_type",
    "hit.mt_type",
)

# Cell values the CSV reader takes for null.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Whole values that cleaning takes for "nothing".
NULL_WORDS = ("nan", "NaN", "null", "NULL", "None")
# Characters stripped from both ends of a value: Unicode white space.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
YES_WORDS = ("Yes", "True", "Y", "1")
NO_WORDS = ("No", "False", "N", "0")
UNKNOWN_WORDS = ("nan", "NaN", "null", "NULL")
RISK_LEVELS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
ZERO_MARKERS = ("amount", "count", "score")
ID_MARKER = "id"

F1_THRESHOLD = 0.75
ACCURACY_THRESHOLD = 0.70
TOP_COMMENTS = 100

# --- End of fixed values. ---------------------------------------------------


def flat(name: str) -> str:
    """Dotted input name -> name Spark ML and plain column references accept."""
    return name.replace(".", "__")


def _flat_all(names: Sequence[str]) -> tuple[str, ...]:
    return tuple(flat(n) for n in names)


@dataclass(frozen=True)
class TextParams:
    """Vectoriser settings of one text column."""

    max_features: int = 500
    ngrams: tuple[int, int] = (1, 2)
    min_df: int = 2
    max_df: float = 0.9
    sublinear: bool = False


@dataclass(frozen=True)
class ModelParams:
    """Classifier settings. `kind` is 'boosted' or 'forest', whatever the number of classes.

    `alpha`, `ridge` and `gamma` regularise boosting; `min_weight` is the least curvature on a side of its splits.
    """

    kind: str = "boosted"
    rounds: int = 100
    depth: int = 4
    step: float = 0.1
    subsample: float = 0.8
    column_share: float = 0.8
    min_rows_per_leaf: int = 3
    alpha: float = 0.1
    ridge: float = 1.0
    gamma: float = 0.1
    min_weight: float = 3.0
    seed: int = 42
    parallelism: int = 4


@dataclass(frozen=True)
class FeatureSpec:
    """Which column plays which role. Every operator is generic over this."""

    text: tuple[str, ...]
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    hit_targets: tuple[str, ...]
    message_targets: tuple[str, ...]
    order: tuple[str, ...]
    message_key: str = "message_id"
    expected: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    primary_text: TextParams = TextParams(max_features=2000, sublinear=True)
    other_text: TextParams = TextParams()
    fallback_text: TextParams = TextParams(max_features=200, ngrams=(1, 1))
    model: ModelParams = ModelParams()
    # Settings of single targets, by name; the others use `model`.
    target_models: tuple[tuple[str, ModelParams], ...] = ()

    @property
    def targets(self) -> tuple[str, ...]:
        return self.hit_targets + self.message_targets

    def level_of(self, target: str) -> str:
        return "hit" if target in self.hit_targets else "message"

    def targets_of(self, level: str) -> tuple[str, ...]:
        if level == "hit":
            return self.hit_targets
        if level == "message":
            return self.message_targets
        if level == "both":
            return self.targets
        raise ValueError(f"level must be hit, message or both, not {level!r}")

    def model_params(self, target: str) -> ModelParams:
        return dict(self.target_models).get(target, self.model)

    def text_params(self, column: str) -> TextParams:
        return self.primary_text if self.text and column == self.text[0] else self.other_text

    def with_(self, **changes) -> "FeatureSpec":
        return replace(self, **changes)


ALERTS = FeatureSpec(
    text=_flat_all(TEXT_COLUMNS),
    categorical=_flat_all(CATEGORICAL_COLUMNS),
    numeric=_flat_all(NUMERIC_COLUMNS),
    hit_targets=_flat_all(HIT_TARGETS),
    message_targets=_flat_all(MESSAGE_TARGETS),
    order=("hit__hit_id",),
    # Comments have a class for each of up to a hundred texts.
    target_models=(
        ("hit__review_comments", ModelParams(kind="forest")),
        ("decision__reviewer_comments", ModelParams(kind="forest")),
    ),
    expected=_flat_all(EXPECTED_COLUMNS),
    required=_flat_all(BASE_REQUIRED),
)

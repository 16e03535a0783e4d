"""Frozen settings shared by the operators. Nothing here touches data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Name fragments that give a column its role, matched in lower case.
ROLE_FRAGMENTS = {
    "suggestion": ("suggest", "insight_suggest", "recommend"),
    "action": ("action", "call", "email", "insight"),
    "outcome": ("trx", "nbrx", "outcome", "script"),
    "time": ("date", "week", "month", "time"),
    "hcp": ("hcp", "customer", "npi"),
    "rep": ("rep", "territory", "salesperson"),
}

# Key and label of each data check, and the sentences of their details.
CHECKS = {
    "parseable_time_column": "Parseable time column",
    "stable_hcp_rep_ids": "Stable HCP/Rep IDs",
    "numeric_convertible_suggestion_action_outcome": "Numeric-convertible suggestions/actions/outcomes",
    "grain_consistency": "Grain consistency",
    "temporal_depth_for_lags": "Enough temporal depth for lags/rolling/adstock",
}
CHECK_DETAILS = {
    "time": "{} rows parse to datetime.",
    "ids": "All rows have HCP and Rep IDs.",
    "no_ids": "Missing HCP/Rep IDs detected.",
    "numeric": "{} metric values are numeric-convertible.",
    "no_rows": "No rows to check.",
    "grain": "No duplicate HCP/Rep/time grain rows.",
    "no_grain": "Duplicate grain rows found.",
    "months": "Detected {} unique months.",
}

# Thresholds of the data checks and the exploratory profile.
MIN_PARSEABLE_TIME = 0.95
MIN_NUMERIC_SHARE = 0.9
MIN_MONTHS = 6
Z_LIMIT = 3.0
LOW_TREATED_ROWS = 10

# Covariates left out per (suggestion type, action type).
COVARIATES_TO_DROP = {
    ("npp", "ho_email"): ("covariate_path_b_hcp_total_ho_emails_last_8_weeks",),
    ("email", "email"): ("covariate_path_b_hcp_total_irep_emails_last_8_weeks",),
    ("call", "email"): ("covariate_path_b_hcp_total_irep_emails_last_8_weeks",),
    ("insight", "email"): ("covariate_path_b_hcp_total_irep_emails_last_8_weeks",),
    ("all", "email"): ("covariate_path_b_hcp_total_irep_emails_last_8_weeks",),
}

# Covariates that describe the rep and lose meaning once reps are collapsed.
REP_LEVEL_COVARIATES = (
    "covariate_path_A_rep_region",
    "covariate_path_A_bus_sales_force",
    "covariate_path_A_rep_gender",
    "covariate_path_A_rep_district",
    "covariate_path_A_sample_mgnt_ind",
    "covariate_path_A_territory_no",
    "covariate_path_A_category_descr",
)

# Feature name patterns per model, and the labels the models are trained on.
FEATURE_PATTERNS = {
    "PathA_PropensityModel": (r"^confound_path_a_.*",),
    "PathB_PropensityModel": (r"^confound_path_b_.*",),
    "PathA_TreatmentEffectModel": (
        r"^covariate_path_a_(?!.*_triggered_emails_ho_npp$).*",
        r"^propensity_score_path_a_suggestion_count$",
        r"^percent_other_hcps_suggested(_adstock)?$",
        r"^suggestion_count(_adstock)?$",
    ),
    "PathB_TreatmentEffectModel": (
        r"^covariate_path_b_.*",
        r"^propensity_score_path_b_action_count$",
        r"^action_count(_adstock)?$",
        r"^suggestion_count(_adstock)?$",
    ),
}
MODEL_LABELS = {
    "PathA_PropensityModel": "suggestion_count",
    "PathB_PropensityModel": "action_count",
    "PathA_TreatmentEffectModel": "action_count",
    "PathB_TreatmentEffectModel": "outcome_count",
}
MODEL_SEED = 7117
ACTION_ARM_SEED = 42
OUTCOME_ARM_SEED = 11

REP, CUSTOMER, WEEK = "rep_id", "customer_id", "week_end_date"
TYPE_TRIPLE = ("suggestion_type", "action_type", "outcome_type")
PATH_A_KEYS = (REP, CUSTOMER, WEEK)
PATH_B_KEYS = (CUSTOMER, WEEK)
OUTCOME_TYPES = ("nbrx", "trx")

PROTECTED_COLUMNS = (
    WEEK,
    REP,
    CUSTOMER,
    "suggestion_type",
    "suggestion_count",
    "suggestion_count_adstock",
    "action_type",
    "action_count",
    "outcome_type",
    "outcome_count",
    "percent_other_hcps_suggested",
    "percent_other_hcps_suggested_adstock",
)


@dataclass(frozen=True)
class Roles:
    """Which column of a wide panel plays which part."""

    suggestions: tuple[str, ...]
    actions: tuple[str, ...]
    outcomes: tuple[str, ...]
    time: str
    hcp: str
    rep: str

    @property
    def metrics(self) -> tuple[str, ...]:
        return self.suggestions + self.actions + self.outcomes


@dataclass(frozen=True)
class AdstockSpec:
    """Geometric carry-over of one measure: ``decay ** k`` for ``k = 0..steps`` weeks back."""

    decay_rate: float
    adstock_steps: int
    type: str = "exponential"

    def __post_init__(self) -> None:
        if self.type != "exponential":
            raise ValueError(f"Unsupported adstock type: {self.type}")


# Default carry-over per measure.
DEFAULT_ADSTOCK = {
    "suggestion_count": AdstockSpec(0.3, 4),
    "percent_other_hcps_suggested": AdstockSpec(0.3, 4),
    "action_count": AdstockSpec(0.69, 4),
}


@dataclass(frozen=True)
class ModelConfig:
    """One model run on the long panel."""

    suggestion_type: str
    action_type: str
    outcome_type: str
    propensity_column: str
    model_type: str
    model_id: str = ""
    run_id: str = ""
    start_date: str | None = None
    end_date: str | None = None
    dependent_model_id: str | None = None
    adstock_params: dict[str, AdstockSpec] | None = field(default=None)

    def __post_init__(self) -> None:
        if self.model_type not in FEATURE_PATTERNS:
            raise ValueError(f"Unknown model type: {self.model_type}")

    def to_dict(self) -> dict:
        return asdict(self)

"""Stage tables and cohort marts, composed from the operators."""

from cohortline.plans.degree import build_degree_start, build_degree_success, build_attrition
from cohortline.plans.leads import build_account, build_app
from cohortline.plans.marts import build_cohort_account, build_cohort_inquiry
from cohortline.plans.onramp import build_inquiry, build_onramp
from cohortline.plans.recommend import build_recommend
from cohortline.plans.survey import build_background, build_background_long, build_skill_conf

__all__ = [
    "build_account", "build_app", "build_attrition", "build_background", "build_background_long", "build_cohort_account",
    "build_cohort_inquiry", "build_degree_start", "build_degree_success", "build_inquiry", "build_onramp", "build_recommend",
    "build_skill_conf",
]

"""Fixed values of the two applicant surveys.

Question wordings and statements must equal the stored text.  ``{school}`` in a
wording stands for the institution's short name and is filled in by the caller.
"""

from __future__ import annotations

# Background question wording to question id.
BACKGROUND_QUESTIONS = {
    "Are you proficient in English?": "english_proficient",
    "Are you a salaried employee?": "salaried_employee",
    "Are you at least 14 years of age?": "age14",
    "Are you 14 years of age or older?": "age14",
    "Are you at least 16 years of age?": "age16",
    "Are you at least 18 years of age?": "age18",
    "Are you 18 years of age or older?": "age18",
    "Did you have a high school diploma or an equivalency?": "hs_diploma",
    "Do you have a high school diploma or an equivalency?": "hs_diploma",
    "Do you have a high school diploma or equivalent?": "hs_diploma",
    "Do you have an RN License?": "rn_license",
    "Do you plan to have an RN License prior to completing Enrollment?": "rn_license_plan",
    "Did you earn an Associates, Bachelor's, or higher Degree?": "assoc_degree_plus",
    "Did you earn an Associates, Bachelor's, or higher degree?": "assoc_degree_plus",
    "Did you earn an Associates, Bachelor's or higher degree?": "assoc_degree_plus",
    "Do you have an Associates, Bachelors or higher degree?": "assoc_degree_plus",
    "Have you earned an Associates, Bachelors, or higher degree?": "assoc_degree_plus",
    "Have you earned an Associates, Bachelor's or higher degree?": "assoc_degree_plus",
    "Did you earn a Bachelor's Degree?": "bachelor_degree",
    "Did you earn a Bachelor's degree?": "bachelor_degree",
    "Did you earn a Bachelor's Degree or higher?": "bachelor_degree_plus",
    "Did you earn a Bachelor's, or higher Degree?": "bachelor_degree_plus",
    "Did you earn a Bachelor's degree or a higher degree?": "bachelor_degree_plus",
    "Do you have a Bachelor's Degree or higher from an accredited institution?": "bachelor_degree_plus",
    "Did you earn a Bachelor's degree or higher in a STEM field?": "bachelor_stem",
    "Did you earn a Bachelor's degree or higher in a STEM, Business, or similar quantitative emphasis?": "bachelor_stem",
    "Did you earn a Bachelors degree or higher in a STEM, Business, or similar quantitative emphasis": "bachelor_stem",
    "Did you earn a Bachelors degree or higher in a STEM field?": "bachelor_stem",
    "Did you earn a bachelor's or higher degree in a STEM program?": "bachelor_stem",
    "Do you have Bachelors degree or higher in Accounting?": "bachelor_accounting",
    "Do you have a bachelor's degree AND do you satisfy any one of the following criteria?\n- Have you completed previous IT course work at a 300 level or higher?\n- Do you have a current and verifiable industry recognized certification such as; Cisco, CompTIA, AWS, EC-Council, or other industry recognized certification that may transfer in to your program at {school}?\n- Do you have verifiable professional experience, greater than two years, in implementing, managing, or responding to security measures and incidents?": "bachelor_or_cert_or_2years",
    "Do you satisfy EITHER of the following criteria?\n - Do you have a current and verifiable industry recognized certification such as; Cisco, CompTIA, AWS, EC-Council, or other industry recognized certification that may transfer in to your program at {school}?\n - Have you completed previous IT course work at a 300 level or higher?": "cert_or_2years",
    "Do you satisfy all of the following criteria?\n - Did you complete college level coursework with a minimum of 2.75 GPA or higher?\n - Did you successfully complete a pre-calculus, calculus, or higher than calculus math course from an accedited post-secondary academic institution? (earned an Associates or higher)": "bscs_req",
    "Do you have an active certification in data analytics, data science or data engineering": "cert_data",
    "Do you have verifiable, hands-on experience in statistics and computer programming?": "exp_stats_prog",
    "Did you successfully complete a pre-calculus, calculus, or higher than Calculus math course from an accredited post-secondary academic institution?": "precalculus",
    "Do you have more than two years of verifiable of work experience in a data analytics, data science, data engineering or database  administration role?": "work_exp_data",
    "Do you have verifiable professional experience, greater than two years, in implementing, managing, or responding to security measures and incidents?": "work_exp_infosec",
    "Do you have previous work experience involving IT or computer networking?": "work_exp_it",
    "Do you have previous work experience in cybersecurity?": "work_exp_cyber",
    "Do you have previous work experience involving computer programming?": "work_exp_programming",
    "Do you have more than two years of verifiable, hands-on experience in programming (SQL, Python, R) or statistics?": "work_exp_prog_stat",
    "Do you have previous work experience involving computer programming or analytics?": "work_exp_prog_stat",
    "Do you possess a transferable IT Certifications from this list?": "transfer_it_cert",
    "Did you earn a high school GPA of 2.5 or higher?": "hsgpa25_plus",
    "Did you graduate from high school with a GPA higher than 2.5?": "hsgpa25_plus",
    "Did you graduate from high school with a GPA higher than 2.75?": "hsgpa275_plus",
    "Did you graduate from high school with a GPA higher than 3.0?": "hsgpa3_plus",
    "Do you graduate from high school is a GPA higher than 3.0?": "hsgpa3_plus",
    "Did you earn a high school GPA of 3.0 or higher AND a B grade or better in a high school honors, IB, or AP level advanced mathematics course?": "hsgpa3_with_b_math",
    "Do you satisfy all of the following criteria?\n- Do you have a high school diploma or an equivalency?\n- Did you earn a high school GPA of 3.0 or higher? \n- Did you successfully complete a high school honors, IB, or AP level advanced mathematics course with a B or better?": "hsgpa3_hs_diploma_ap_math",
    "Was your cumulative college GPA 2.0 or higher?": "college_gpa20_plus",
    "Was your college cumulative GPA 2.0 or higher?": "college_gpa20_plus",
    "Was your cumulative college GPA higher than 2.0?": "college_gpa20_plus",
    "Was your cumulative college GPA higher than 2.5?": "college_gpa25_plus",
    "Have you attended some college with a cumulative GPA of 2.75 or higher OR Have you never attended college but have a high school diploma or an equivalency with a GPA higher than 3.0?": "gpa275_or_hsgpa30",
    "Was your cumulative GPA higher than 2.5?": "gpa25_plus",
    "Was your cumulative GPA 2.5 or higher?": "gpa25_plus",
    "Are you able to commit to 20 hours per week to study?": "commit_20hours",
    "Do you feel comfortable with your current math skills?": "math_skill_comfort",
    "Have you completed a teacher preparation program or alternate route to licensure?": "teacher_prep",
    "Are you currently a contracted Teacher of Record?": "teacher_of_record",
    "Do you hold, or have you held, any type of teaching license including restricted, temporary, or emergency?": "teaching_license",
}

# Background answers that become columns of the wide table.
BACKGROUND_COLUMNS = [
    "hs_diploma",
    "assoc_degree_plus",
    "bachelor_degree",
    "bachelor_degree_plus",
    "college_gpa20_plus",
    "college_gpa25_plus",
    "gpa25_plus",
    "hsgpa25_plus",
]

# The skill survey and its four statements, in rule-key order.
SKILL_SURVEY = "Skillset Confidence"
SKILL_STATEMENTS = {
    "I'm comfortable with advanced math concepts.": "Math",
    "It is easy for me to combine information from different places and write clear arguments.": "Writing",
    "I was successful in achieving my goals with my most recent educational experience.": "Resilience",
    "My long term career goals are clearly defined.": "Career",
}

# Program codes per recommendation group.
HEALTH_PROFESSIONS = ["BSHHS", "BSHIM", "BSPH", "BSNT", "BSHW"]
PSYCHOLOGY = ["BSPSY"]
HEALTH_SCIENCE = ["BSHS"]
ELEMENTARY_SPECIAL_ED = ["BAESELED", "BAELED", "BAESSPMM", "BASPMM", "BAESSPEE", "BASPEE"]
MATH_SCIENCE_ED = ["BAESMEMG", "BSMEMG", "BAESMES", "BSMES", "BAESSEMG", "BSSEMG", "BSSESB", "BAESSESB", "BAESSESC", "BSSESC", "BAESSESE", "BSSESE", "BAESSESP", "BSSESP"]
BUSINESS_COLLEGE = "BU"
CYBERSECURITY = ["BSCSIA"]
COMPUTER_SCIENCE = ["BSCS"]
DATA_ANALYTICS = ["BSDA"]
CLOUD_PREFIX = "BSCC"
CLOUD_IT = ["BSIT", "MSITMUG"]
NETWORK_PREFIX = "BSNES"
SOFTWARE_PREFIX = "BSSWE"


def background_questions(school: str) -> dict[str, str]:
    """Question wording to id with the institution's name filled in."""
    return {text.replace("{school}", school): code for text, code in BACKGROUND_QUESTIONS.items()}

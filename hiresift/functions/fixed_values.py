"""Fixed values that decide results: word lists, weights, patterns and wording.

Everything in this module is data that must stay as it is for scores, parsed
records, prompts and reports to come out right.  Nothing here is computed from
the input.
"""

# --- skill lexicon, by category, in reporting order ---------------------------
SKILL_CATEGORIES = {
    "Programming": [
        "python", "java", "javascript", "typescript", "c++", "c#", "ruby", "go",
        "rust", "kotlin", "swift", "php", "scala",
    ],
    "Web": [
        "react", "angular", "vue.js", "node.js", "django", "flask", "fastapi",
        "next.js", "express.js", "html", "css", "graphql", "tailwind", "bootstrap",
        "webpack",
    ],
    "AI/ML": [
        "tensorflow", "pytorch", "scikit-learn", "langchain", "nlp",
        "computer vision", "deep learning", "machine learning", "transformers", "rag",
        "keras", "opencv", "pandas", "numpy", "hugging face", "llm", "spacy",
    ],
    "Cloud": [
        "aws", "azure", "gcp", "docker", "kubernetes", "mlops", "terraform",
        "serverless", "lambda", "cloudformation",
    ],
    "Databases": [
        "sql", "postgresql", "mongodb", "redis", "mysql", "sqlite", "elasticsearch",
        "dynamodb", "cassandra",
    ],
    "Tools": [
        "git", "jenkins", "ci/cd", "agile", "scrum", "tableau", "jwt", "oauth",
        "microservices", "rest api", "linux", "bash", "jira", "figma", "postman",
    ],
}

# --- section headers and the spellings they are known by ------------------------
SECTION_ALIASES = {
    "experience": [
        "professional experience", "experience", "work experience", "employment history",
        "career history", "relevant experience", "employment", "work history",
        "career experience",
    ],
    "education": [
        "education", "academic background", "academic qualifications",
        "education & training",
    ],
    "certifications": [
        "certifications", "certification", "licenses & certifications",
        "certificates", "professional certifications", "credentials", "licenses",
    ],
    "projects": [
        "projects", "key projects", "notable projects", "selected projects",
        "personal projects", "side projects", "portfolio", "technical projects",
        "open source contributions",
    ],
}
BULLETS = ["- ", "• "]

# --- placeholders for absent contact details ------------------------------------
UNKNOWN_NAME = "Unknown"
NOT_FOUND = "Not found"

# --- scoring ----------------------------------------------------------------------
WEIGHTS = {
    "skills": "0.35",
    "experience": "0.30",
    "education": "0.15",
    "certifications": "0.10",
    "projects": "0.10",
}
DEGREE_TIERS = [
    (100.0, ["phd", "ph.d", "doctorate"]),
    (85.0, ["m.s.", "master", "m.tech"]),
    (60.0, ["b.s.", "bachelor", "b.tech"]),
]
OTHER_DEGREE_SCORE = 30.0
POINTS_PER_CERTIFICATION = 25.0
POINTS_PER_PROJECT = 33.0

# --- workflow -----------------------------------------------------------------------
STATUSES = ["New", "Shortlisted", "Interview", "Rejected"]
SCORE_BANDS = [(80.0, "high"), (60.0, "mid")]
LOWEST_BAND = "low"

# --- page layout --------------------------------------------------------------------
LINE_TOLERANCE = 3
COLUMN_GAP = 15

# --- typographic characters and their plain forms -----------------------------------
PLAIN_CHARACTERS = {
    "—": "-",
    "–": "-",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "…": "...",
}

# --- wording of the relevance requests (item types are part of the wording) ----------
AI_CATEGORIES = {
    "skills": "technical skills",
    "experience": "professional experience",
    "certifications": "certifications",
    "projects": "projects",
}
RELEVANCE_SYSTEM = (
    "You are a strict technical recruiter scoring how relevant a candidate's "
    "{item_type} are to a specific job posting. "
    "Reply with ONLY a JSON object, no other text, no markdown fences: "
    '{"score": <integer 0-100>, "reason": "<one short sentence>"}. '
    "Score based on genuine relevance to the job, not just quantity — "
    "irrelevant items should score low even if there are several of them."
)
RELEVANCE_USER = (
    "Job description:\n{job_description}\n\n"
    "Candidate's {item_type}:\n{items}\n\n"
    "Rate relevance 0-100."
)

# --- wording of the chat, interview and e-mail requests -------------------------------
CHAT_SYSTEM_HEAD = (
    "You are an HR assistant helping recruiters evaluate job candidates. "
    "You have access to the following candidate ranking data:\n\n"
)
CHAT_SYSTEM_TAIL = (
    "\n\n"
    "Answer questions about these candidates clearly and concisely, "
    "referencing specific scores and skills where relevant. "
    "Be honest about each candidate's strengths and weaknesses."
)
CHAT_APOLOGY = "Sorry, I ran into an error contacting the AI assistant: "
INTERVIEW_PROMPT = (
    "Generate 5 targeted interview questions for {name}, "
    "based on their matched skills ({matched}) "
    "and missing skills ({missing}) "
    "relative to this role. Focus on probing their strengths and "
    "clarifying their gaps."
)
EMAIL_PROMPTS = {
    "Rejected": "Write a brief, kind, professional rejection email to {name} for this role.",
    "Shortlisted": "Write a brief, warm, professional email to {name} inviting them to interview for this role.",
    "Interview": "Write a brief, warm, professional email to {name} inviting them to interview for this role.",
    None: "Write a brief, professional email to {name} acknowledging their application is under review.",
}
QUICK_QUESTIONS = {
    "Who is the best candidate?": "Who is the best candidate and why?",
    "Compare the candidates": "Compare all the candidates in detail.",
    "Who has more experience?": "Which candidate has the most relevant experience?",
    "Recommend the top candidate": "Give a final recommendation on who to hire.",
}
REPORT_TITLE = "Candidate Ranking Report"
REPORT_FILE_PREFIX = "hiring_report_"

# --- English stop words: the list Spark ML ships as its default -----------------------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()

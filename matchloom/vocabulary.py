"""Default vocabularies.

These are the default contents of the dictionary tables.  Each one can be
replaced by a table read with :func:`matchloom.sources.dims.load_dictionary`.
"""

# ---------------------------------------------------------------- fixed values
TITLE_PATTERNS = {
    "backend": [
        "backend engineer", "backend developer", "back end engineer", "back-end developer",
        "server side engineer", "api engineer", "java developer", "python developer",
        "golang developer", "node developer", "node.js developer", "django developer",
        "rails developer", "php developer", ".net developer", "dotnet developer",
        "microservices engineer", "platform engineer backend",
    ],
    "frontend": [
        "frontend engineer", "frontend developer", "front end engineer",
        "front-end developer", "ui developer", "ui engineer", "react developer",
        "angular developer", "vue developer", "javascript developer", "web developer",
        "ux engineer",
    ],
    "fullstack": [
        "full stack developer", "full stack engineer", "fullstack developer",
        "fullstack engineer", "mern developer", "mean stack developer",
        "mern stack developer",
    ],
    "mobile": [
        "android developer", "ios developer", "mobile developer", "mobile engineer",
        "android engineer", "ios engineer", "react native developer", "flutter developer",
    ],
    "ml_engineer": [
        "machine learning engineer", "ml engineer", "mle", "applied scientist",
        "applied ml engineer", "ai engineer", "artificial intelligence engineer",
        "deep learning engineer", "computer vision engineer", "nlp engineer",
        "research engineer machine learning", "mlops engineer", "machine learning intern",
        "computer vision intern", "ml intern",
    ],
    "data_engineer": [
        "data engineer", "big data engineer", "etl developer", "etl engineer",
        "analytics engineer", "data platform engineer", "data infrastructure engineer",
        "hadoop developer", "spark developer", "data warehouse engineer", "bi developer",
    ],
    "data_analyst": [
        "data analyst", "business analyst", "product analyst",
        "business intelligence analyst", "bi analyst", "reporting analyst",
        "insights analyst", "marketing analyst", "operations analyst", "mis executive",
    ],
    "data_scientist": [
        "data scientist", "decision scientist", "quantitative analyst", "statistician",
        "data science intern", "research scientist",
    ],
    "devops_sre": [
        "devops engineer", "site reliability engineer", "sre", "platform engineer",
        "infrastructure engineer", "cloud engineer", "systems engineer",
        "build and release engineer", "kubernetes engineer", "cloud architect",
    ],
    "qa": [
        "qa engineer", "qa automation engineer", "quality assurance engineer",
        "test engineer", "automation test engineer", "sdet",
        "software development engineer in test", "manual tester", "qa analyst",
    ],
    "engineering_manager": [
        "engineering manager", "engineering director", "director of engineering",
        "head of engineering", "vp engineering", "vice president engineering",
        "senior engineering manager", "technical program manager engineering", "cto",
    ],
    "non_engineering": [
        "hr executive", "hr manager", "human resources", "talent acquisition", "recruiter",
        "technical recruiter", "program manager", "project manager", "product manager",
        "founder", "co-founder", "ceo", "coo", "chief executive officer",
        "sales executive", "account manager", "marketing manager", "content writer",
        "graphic designer", "ui ux designer", "customer success manager",
        "operations manager", "mechanical engineer", "civil engineer",
        "electrical engineer", "production engineer", "quality engineer manufacturing",
        "teacher", "lecturer", "accountant",
    ],
}

AMBIGUOUS_TITLES = [
    "engineer", "developer", "programmer", "software engineer", "software developer",
    "software development engineer", "sde", "senior software engineer",
    "member of technical staff", "mts", "associate engineer",
    "associate software engineer", "graduate engineer trainee", "technical consultant",
    "consultant", "associate consultant", "technology analyst", "systems analyst",
    "programmer analyst", "technical architect", "solution architect", "architect",
    "staff engineer", "principal engineer", "lead engineer", "technical lead",
    "design engineer", "research assistant", "research associate", "software intern",
    "intern", "trainee", "analyst", "specialist",
]

CONTEXT_TERMS = {
    "backend": {
        "django": 2.0, "fastapi": 2.0, "flask": 1.5, "spring boot": 2.0, "spring": 1.0,
        "hibernate": 1.5, "microservices": 1.5, "rest api": 1.0, "rest apis": 1.0,
        "grpc": 1.0, "celery": 1.5, "postgresql": 1.0, "mysql": 1.0, "mongodb": 1.0,
        "redis": 1.0, "kafka": 1.0, "node.js": 1.5, "express.js": 1.5, "ledger": 1.5,
        "payments": 1.0, "billing": 1.0, "serverless": 1.5, "lambda": 1.0,
        "aws lambda": 1.5, "dynamodb": 1.5, "sqs": 1.0, "api gateway": 1.0, "boto3": 1.5,
        "step functions": 1.5, "java": 1.0, "golang": 1.0, "php": 1.0, "wallet": 1.5,
        "refunds": 1.0, "rps": 1.0, "qps": 1.0,
    },
    "frontend": {
        "react": 2.0, "angular": 2.0, "vue": 2.0, "next.js": 2.0, "redux": 1.5,
        "tailwind css": 1.5, "webpack": 1.5, "jest": 1.0, "css": 1.5, "html": 1.0,
        "typescript": 1.0, "accessibility": 1.5, "lcp": 1.5, "onboarding flow": 1.0,
        "graphql": 0.5, "storybook": 1.5, "design system": 1.5,
    },
    "fullstack": {"mern": 2.0, "mean stack": 2.0, "full stack": 2.0, "fullstack": 2.0},
    "mobile": {
        "android": 2.0, "ios": 2.0, "kotlin": 1.5, "swift": 1.5, "flutter": 2.0,
        "react native": 2.0, "jetpack compose": 2.0,
    },
    "ml_engineer": {
        "pytorch": 2.0, "tensorflow": 2.0, "transformers": 1.5, "huggingface": 1.5,
        "hugging face": 1.5, "langchain": 1.5, "rag": 1.5, "embeddings": 1.5,
        "reranker": 2.0, "cross-encoder": 2.0, "ndcg": 1.5, "faiss": 1.5,
        "triton inference server": 2.0, "onnx": 1.5, "tensorrt": 2.0,
        "quantization": 1.5, "quantized": 1.5, "opencv": 2.0, "jetson": 1.5,
        "recommender": 1.5, "ranking": 1.0, "perception": 1.5, "fine-tuned": 1.5,
        "detector": 1.5, "feature store": 1.5, "llm": 1.5, "mlflow": 1.0,
    },
    "data_engineer": {
        "airflow": 2.0, "dag": 1.5, "dags": 1.5, "spark": 2.0, "pyspark": 2.0,
        "databricks": 2.0, "dbt": 2.0, "snowflake": 1.5, "bigquery": 1.5,
        "redshift": 1.5, "delta lake": 2.0, "lakehouse": 2.0, "glue": 1.5,
        "dataflow": 1.5, "etl": 1.5, "pipeline": 1.0, "pipelines": 1.0, "batch": 1.0,
        "iceberg": 1.5, "trino": 1.5, "warehouse": 1.0, "ingestion": 1.5,
        "repartitioning": 1.5,
    },
    "data_analyst": {
        "power bi": 2.0, "tableau": 2.0, "looker": 1.5, "excel": 1.0, "dashboards": 1.5,
        "dashboard": 1.5, "reporting": 1.5, "amplitude": 2.0, "mixpanel": 2.0,
        "a/b testing": 1.5, "ad-hoc sql": 1.5, "readout": 1.0, "experiments": 1.0,
    },
    "data_scientist": {
        "forecasting": 1.5, "regression": 1.0, "hypothesis": 1.0, "statistics": 1.0,
        "scikit-learn": 1.5, "sklearn": 1.5, "statsmodels": 1.5, "causal": 1.5,
        "clustering": 1.0, "analytics": 0.5,
    },
    "devops_sre": {
        "kubernetes": 2.0, "terraform": 2.0, "prometheus": 2.0, "grafana": 1.5,
        "ansible": 2.0, "jenkins": 1.5, "ci/cd": 1.5, "docker": 0.5, "helm": 2.0,
        "deploy time": 2.0, "developer platform": 2.0, "incident": 1.5, "on-call": 1.5,
        "observability": 2.0, "linux": 1.0, "sre": 2.0,
    },
    "qa": {
        "selenium": 2.0, "cypress": 2.0, "appium": 2.0, "test automation": 2.0,
        "test cases": 1.5, "postman": 1.0, "manual testing": 2.0, "api testing": 1.5,
        "regression suite": 2.0, "jira": 0.5,
    },
    "engineering_manager": {
        "people management": 2.0, "hiring": 1.5, "roadmap": 1.5, "roadmapping": 1.5,
        "managed": 1.5, "direct reports": 2.0, "performance reviews": 2.0, "team of": 1.5,
    },
    "non_engineering": {
        "autocad": 3.0, "solidworks": 3.0, "catia": 3.0, "ansys": 3.0, "ptc creo": 3.0,
        "gd&t": 3.0, "cnc": 2.0, "recruitment": 2.0, "talent acquisition": 2.0,
        "naukri": 2.0, "linkedin recruiter": 2.0, "onboarding": 1.0,
        "growth hacking": 2.0, "public speaking": 1.5, "fundraising": 2.0,
        "go-to-market": 2.0, "sales": 1.5, "video editing": 2.0, "photoshop": 2.0,
        "canva": 2.0, "content writing": 2.0, "tolerance stack": 3.0,
        "manufacturing": 2.0, "sheet metal": 3.0, "chassis": 2.0,
    },
}

SKILL_ALIASES = {
    "react": ["react.js", "reactjs", "react js", "react 18"],
    "react native": ["reactnative", "react-native"],
    "next.js": ["nextjs", "next js", "next"],
    "node.js": ["nodejs", "node js", "node"],
    "express.js": ["expressjs", "express js", "express"],
    "vue.js": ["vuejs", "vue js", "vue"],
    "javascript": ["js", "ecmascript", "es6", "vanilla javascript"],
    "typescript": ["ts"],
    "postgresql": ["postgres", "psql", "postgre sql", "pgsql"],
    "mongodb": ["mongo", "mongo db"],
    "mysql": ["my sql"],
    "kubernetes": ["k8s", "k8"],
    "docker": ["containerisation", "containerization"],
    "aws": ["amazon web services"],
    "gcp": ["google cloud platform", "google cloud"],
    "azure": ["microsoft azure"],
    "ci/cd": ["cicd", "ci cd", "continuous integration", "continuous delivery", "ci-cd"],
    "machine learning": ["ml"],
    "deep learning": ["dl"],
    "artificial intelligence": ["ai"],
    "natural language processing": ["nlp"],
    "computer vision": ["cv"],
    "scikit-learn": ["sklearn", "scikit learn", "scikitlearn"],
    "pytorch": ["torch", "py torch"],
    "tensorflow": ["tensor flow", "tf"],
    "sentence-transformers": ["sentence transformers", "sbert"],
    "hugging face": ["huggingface", "hf"],
    "spark": ["apache spark", "pyspark", "spark sql"],
    "airflow": ["apache airflow", "apache-airflow"],
    "kafka": ["apache kafka"],
    "excel": ["ms excel", "microsoft excel", "advanced excel"],
    "ms word": ["microsoft word"],
    "ms powerpoint": ["microsoft powerpoint", "powerpoint", "ppt"],
    "power bi": ["powerbi", "microsoft power bi"],
    "sql": ["structured query language"],
    "rest apis": ["rest api", "restful apis", "restful api", "rest"],
    "system design": ["systems design", "hld", "low level design"],
    "a/b testing": ["ab testing", "a b testing", "split testing"],
    "llm": ["large language models", "llms"],
    "rag": ["retrieval augmented generation"],
    "vector databases": ["vector database", "vector db", "vectordb"],
    "dynamodb": ["amazon dynamodb", "dynamo db"],
    "aws lambda": ["lambda"],
    "bigquery": ["google bigquery", "big query"],
    "data visualization": ["data visualisation", "dataviz"],
    "people management": ["team management"],
}

# A skill listed under two families counts for the first one.
SKILL_FAMILIES = {
    "ml_engineer": [
        "machine learning", "deep learning", "pytorch", "tensorflow", "keras",
        "transformers", "hugging face", "sentence-transformers", "scikit-learn",
        "natural language processing", "computer vision", "opencv", "tensorrt", "onnx",
        "quantization", "llm", "rag", "langchain", "langgraph", "mlflow", "mlops", "faiss",
        "pinecone", "pgvector", "vector databases", "openai api", "prompt engineering",
        "llm evaluation", "feature store", "triton inference server",
        "artificial intelligence", "data science", "ray",
    ],
    "data_engineer": [
        "spark", "airflow", "snowflake", "dbt", "databricks", "delta lake",
        "azure data factory", "aws glue", "bigquery", "dataflow", "kafka", "iceberg",
        "trino", "hadoop", "big data", "data modeling", "scala", "terraform",
    ],
    "data_analyst": [
        "power bi", "tableau", "looker", "amplitude", "mixpanel", "a/b testing", "excel",
        "data visualization", "statistics", "mis",
    ],
    "data_scientist": ["pandas", "numpy", "matplotlib", "statistics", "forecasting", "r"],
    "backend": [
        "django", "fastapi", "flask", "spring boot", "hibernate", "celery", "node.js",
        "express.js", "microservices", "rest apis", "postgresql", "mysql", "mongodb",
        "redis", "dynamodb", "sqs", "api gateway", "boto3", "step functions",
        "aws lambda", "grpc", "go", "java", "php",
    ],
    "frontend": [
        "react", "angular", "vue.js", "next.js", "redux", "tailwind css", "webpack", "jest",
        "html", "css", "accessibility", "graphql", "typescript", "javascript",
    ],
    "mobile": ["android", "ios", "kotlin", "swift", "flutter", "react native",
               "jetpack compose"],
    "devops_sre": [
        "kubernetes", "docker", "prometheus", "grafana", "ansible", "jenkins", "ci/cd",
        "helm", "linux", "cloudformation", "observability",
    ],
    "qa": ["selenium", "cypress", "appium", "postman", "api testing", "manual testing",
           "pytest", "junit"],
    "engineering_manager": ["people management", "hiring", "roadmapping"],
    "non_engineering": [
        "autocad", "solidworks", "catia", "ansys", "recruitment", "talent acquisition",
        "naukri", "linkedin recruiter", "onboarding", "growth hacking", "public speaking",
        "product management", "blockchain", "leadership", "communication skills",
        "teamwork", "video editing", "photoshop", "canva", "content writing", "ms word",
        "ms powerpoint",
    ],
}
CLAIMED_FAMILY_MIN_SKILLS = 2

OFF_DOMAIN_SKILLS = [
    "video editing", "photoshop", "canva", "content writing", "communication skills",
    "teamwork", "leadership", "public speaking", "ms word", "ms powerpoint", "autocad",
    "solidworks", "catia", "ansys", "recruitment", "talent acquisition", "naukri",
    "linkedin recruiter", "onboarding", "growth hacking", "blockchain",
    "product management", "roadmapping", "hiring", "marketing", "sales",
]
# ------------------------------------------------------------ end fixed values


def alias_map(aliases=None) -> dict[str, str]:
    """Variant to canonical name."""
    aliases = SKILL_ALIASES if aliases is None else aliases
    return {variant: name for name, variants in aliases.items() for variant in variants}


def skill_family_map(families=None) -> dict[str, str]:
    families = SKILL_FAMILIES if families is None else families
    out: dict[str, str] = {}
    for family, skills in families.items():
        for skill in skills:
            out.setdefault(skill, family)
    return out


def pattern_rows(patterns=None) -> list[tuple[str, str]]:
    """(pattern, family), longest pattern first, declaration order within a length."""
    patterns = TITLE_PATTERNS if patterns is None else patterns
    rows = [(pattern, family) for family, items in patterns.items() for pattern in items]
    return sorted(rows, key=lambda row: -len(row[0]))


def context_rows(terms=None) -> list[tuple[str, str, float]]:
    terms = CONTEXT_TERMS if terms is None else terms
    return [(family, term, weight) for family, items in terms.items()
            for term, weight in items.items()]

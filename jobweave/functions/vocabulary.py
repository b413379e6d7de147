"""Word lists and tables that results depend on."""

# The technology keywords that are recognised in texts.
TECH_KEYWORDS = (
    "python", "java", "javascript", "typescript", "golang", "rust", "kotlin",
    "react", "vue", "angular", "next.js", "nuxt", "svelte",
    "spring", "spring boot", "django", "flask", "fastapi", "node.js", "express",
    "mysql", "postgresql", "postgres", "mongodb", "redis", "elasticsearch", "oracle",
    "docker", "kubernetes", "k8s", "aws", "gcp", "azure",
    "git", "github", "gitlab", "jenkins", "ci/cd",
    "rest", "restful", "graphql", "grpc",
    "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy",
    "kafka", "rabbitmq", "airflow", "spark", "hadoop",
)

# Free-form skill names and their standard forms.
SKILL_ALIASES = {
    "spring framework": "spring",
    "spring-boot": "spring boot",
    "springboot": "spring boot",
    "react.js": "react",
    "reactjs": "react",
    "react native": "react",
    "vue.js": "vue",
    "vuejs": "vue",
    "nextjs": "next.js",
    "next js": "next.js",
    "node": "node.js",
    "nodejs": "node.js",
    "k8s": "kubernetes",
    "postgres": "postgresql",
    "scikit learn": "scikit-learn",
    "sklearn": "scikit-learn",
    "tf": "tensorflow",
    "amazon web services": "aws",
    "google cloud": "gcp",
    "google cloud platform": "gcp",
}

# Job categories in order of precedence, and what names them.
JOB_CATEGORIES = (
    ("IT/개발", ("개발자", "개발", "프론트엔드", "백엔드", "풀스택", "데이터엔지니어", "데이터분석", "데이터사이언", "머신러닝", "딥러닝", "정보보안", "보안", "클라우드", "인프라", "엔지니어", "프로그래", "소프트웨어", "ai", "ml", "it", "devops", "se", "qa", "sw", "engineer")),
    ("R&D", ("연구", "기술연구", "r&d", "rd")),
    ("디자인", ("디자인", "ux", "ui")),
    ("마케팅", ("마케팅", "콘텐츠", "광고", "브랜드")),
    ("영업", ("영업",)),
    ("인사", ("인사", "노무", "채용", "hr")),
    ("재무/회계", ("재무", "회계", "감사", "세무", "재경")),
    ("기획", ("기획", "전략", "pm", "po")),
    ("경영지원", ("경영지원", "총무", "비서")),
    ("고객", ("고객", "상담", "a/s", "cs")),
    ("물류/SCM", ("물류", "구매", "유통", "scm")),
    ("법무", ("법무", "특허")),
    ("교육", ("교육", "훈련")),
    ("사무/행정", ("사무", "행정")),
    ("제조/기계", ("기계", "전자", "전기", "화학", "제조", "생산", "품질", "설비", "반도체", "양산")),
    ("건설/건축", ("건설", "건축", "토목", "시공", "플랜트")),
    ("금융", ("금융", "은행", "투자", "자산운용", "여신", "외환")),
)
UNCATEGORIZED, OTHER = "미분류", "기타"
IT_CATEGORIES = ("IT/개발", "R&D")

# Characters that can follow a Korean name as particles, and the range of Korean letters.
PARTICLES = "은는이가을를와과의도만에로으야서"
HANGUL = "ㄱ-㆏가-힯"

# Fixed value: named-entity groups that count as qualifications.
QUALIFICATION_GROUPS = ("CVL", "OGG_EDUCATION", "QT")

# Fixed value: the prompt for implied skills.
IMPLIED_PROMPT = """당신은 채용공고를 분석하여 명시되지 않은 암묵적 요구 역량을 추론하는 전문가입니다.

아래 채용공고와 명시된 요구사항을 바탕으로:
1. 실무 맥락상 필연적으로 요구될 기술/역량을 단계별로 추론하세요.
2. 회사가 공고에 적지 않았지만 합격자는 당연히 알고 있어야 할 역량에 초점을 맞추세요.
3. 추론이 끝나면 마지막 줄에 JSON 배열로 암묵적 역량만 출력하세요.

## 채용공고
{job_text}

## 명시된 요구사항
{explicit_skills}

출력 형식(마지막 줄):
IMPLICIT: ["역량1", "역량2", ...]
"""
NO_SKILLS = "(없음)"

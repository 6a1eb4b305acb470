"""The default dictionaries. Every operator takes others as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Skill:
    key: str
    category: str
    weight: float
    aliases: tuple[str, ...]


def read_skills(table: str) -> list[Skill]:
    """Lines of: key | category | base weight | alias, alias, ..."""
    out = []
    for line in table.strip().splitlines():
        key, category, weight, aliases = (x.strip() for x in line.split("|"))
        out.append(Skill(key, category, float(weight), tuple(a.strip() for a in aliases.split(","))))
    return out


# Skills, their categories, base weights and aliases, in the order that results have.
SKILLS = read_skills("""
javascript | language | 1.1 | javascript, js, ecmascript
typescript | language | 1.1 | typescript, ts
python | language | 1.1 | python, py
java | language | 1.0 | java
kotlin | language | 1.0 | kotlin
swift | language | 1.0 | swift
r | language | 0.9 | r language, r programming
matlab | language | 0.9 | matlab
c | language | 0.9 | c programming, language c, c/c++
c++ | language | 1.0 | c++, cpp, c/c++, c ++
c# | language | 1.0 | c#, c sharp
go | language | 1.0 | golang, go
rust | language | 1.0 | rust
sql | database | 1.1 | sql, structured query language, tsql, relational database, relational databases, sql database
postgresql | database | 1.0 | postgresql, postgres, postgres sql
mysql | database | 0.95 | mysql
mongodb | database | 0.95 | mongodb, mongo db
firebase | database | 0.9 | firebase, firestore
dynamodb | database | 0.9 | dynamodb
elasticsearch | database | 0.9 | elasticsearch, elastic search
postgis | database | 0.95 | postgis
redis | database | 0.95 | redis
supabase | database | 0.95 | supabase
html | frontend | 0.8 | html, html5
css | frontend | 0.8 | css, css3, sass, scss
tailwind css | frontend | 0.95 | tailwind, tailwind css
react | frontend | 1.1 | react, reactjs, react.js
recharts | frontend | 0.9 | recharts
d3.js | frontend | 0.9 | d3, d3.js, data-driven documents
vue | frontend | 1.0 | vue, vuejs, vue.js
angular | frontend | 1.0 | angular
next.js | frontend | 1.0 | next.js, nextjs
react native | frontend | 1.0 | react native
svelte | frontend | 0.95 | svelte, sveltekit
vite | frontend | 0.9 | vite
hono | backend | 0.9 | hono
node.js | backend | 1.1 | node.js, nodejs, node, node js
express | backend | 0.9 | express, express.js, expressjs
nestjs | backend | 0.95 | nestjs, nest.js, nest js
django | backend | 1.0 | django
flask | backend | 0.9 | flask
fastapi | backend | 1.0 | fastapi, fast api
ruby on rails | backend | 0.9 | ruby on rails, rails
laravel | backend | 0.9 | laravel
.net | backend | 0.95 | .net, dotnet, asp.net, aspnet
spring | backend | 1.0 | spring, spring boot
graphql | backend | 1.0 | graphql
rest api | backend | 0.72 | rest api, restful api, restful apis
authentication | backend | 0.85 | authentication, auth, oauth, jwt, secure api access
state management | frontend | 0.85 | state management, redux, context api
event handling | frontend | 0.75 | event handling, event-driven
async programming | backend | 0.8 | asynchronous, async/await, asynchronous data flows
openai api | ai | 1.0 | openai, openai api, openai apis, llm api, llm apis
networkx | data | 0.9 | networkx
git | tool | 0.9 | git, github, gitlab, bitbucket
docker | tool | 1.0 | docker, containerization, containers
kubernetes | tool | 1.0 | kubernetes, k8s
prisma | tool | 0.9 | prisma
postman | tool | 0.85 | postman
drupal | tool | 0.85 | drupal, drupal 8
fusion 360 | tool | 0.8 | fusion 360
figma | tool | 0.85 | figma
jira | tool | 0.8 | jira
linux | tool | 0.9 | linux, unix
aws | cloud | 1.0 | aws, amazon web services
gcp | cloud | 1.0 | gcp, google cloud
azure | cloud | 1.0 | azure, microsoft azure
terraform | devops | 1.0 | terraform
ci/cd | devops | 0.9 | ci/cd, continuous integration, continuous delivery, jenkins, github actions
pandas | data | 1.0 | pandas
numpy | data | 1.0 | numpy
scikit-learn | data | 1.0 | scikit-learn, sklearn
tensorflow | ml | 1.0 | tensorflow, tf
pytorch | ml | 1.0 | pytorch
llm | ml | 0.95 | llm, large language model, large language models, llm api, llm apis, prompt engineering, anthropic
spark | data | 1.0 | spark, apache spark, pyspark
hadoop | data | 0.9 | hadoop
tableau | analytics | 0.9 | tableau
power bi | analytics | 0.9 | power bi, powerbi
excel | analytics | 0.8 | excel, microsoft excel
ms office | tool | 0.75 | ms office, microsoft office, powerpoint, word
etl | data | 0.9 | etl, data pipeline, pipelines
data analysis | analytics | 0.9 | data analysis, analytical, analytics
machine learning | ml | 1.0 | machine learning, ml model, modeling
nlp | ml | 0.9 | nlp, natural language processing
computer vision | ml | 0.9 | computer vision, cv
product management | role | 1.0 | product management, product manager, pm
software engineering | role | 1.0 | software engineer, software engineering, swe, software developer
firmware | role | 0.9 | firmware, embedded firmware
embedded systems | role | 0.95 | embedded systems, embedded, ecu
data analyst | role | 1.0 | data analyst, business analyst, analytics intern
data scientist | role | 1.0 | data scientist, data science
backend engineering | role | 1.0 | backend, back-end, server-side, backend framework
frontend engineering | role | 1.0 | frontend, front-end, ui engineering, frontend basics
full stack | role | 1.0 | full stack, full-stack
mobile development | role | 0.9 | android, ios, react native, swift, kotlin, mobile
testing | tool | 0.8 | unit test, integration test, qa, jest, cypress
can/lin | tool | 0.85 | can/lin, can lin, can bus, lin bus
accessibility | tool | 0.9 | accessibility, wcag, aria
agile | process | 0.7 | agile, scrum, kanban
communication | soft-skill | 0.5 | communication, presentation, stakeholder
leadership | soft-skill | 0.5 | leadership, mentor, ownership
problem solving | soft-skill | 0.6 | problem solving, critical thinking, analytical thinking
finance | domain | 0.8 | finance, financial analysis, valuation
marketing | domain | 0.8 | marketing, seo, content strategy
cybersecurity | domain | 0.9 | cybersecurity, security, infosec
""")

# A skill counts as present where one of these is (one way only).
EQUIVALENTS = {
    "llm": ["openai api", "machine learning", "nlp"],
    "openai api": ["llm"],
    "sql": ["postgresql", "mysql", "mongodb"],
    "backend engineering": ["fastapi", "node.js", "express", "flask", "django", "nestjs", "rest api"],
    "frontend engineering": ["react", "next.js", "vue", "angular", "tailwind css", "html", "css"],
    "ci/cd": ["git", "github actions"],
    "authentication": ["oauth", "jwt"],
}

# Factors of a category's weight; others have 1.
CATEGORY_FACTORS = {"soft-skill": 0.55, "process": 0.5, "domain": 0.75}
UNTECHNICAL = ("soft-skill", "process")

# What a query for a role also looks for.
ROLE_SYNONYMS = {
    "software engineer": ["swe", "software developer", "developer", "engineering", "programmer", "backend", "frontend", "full stack"],
    "software developer": ["software engineer", "developer", "swe", "backend", "frontend", "full stack"],
    "data analyst": ["business analyst", "analytics", "sql", "tableau", "power bi", "data"],
    "data engineer": ["etl", "data pipeline", "data engineering", "spark", "sql", "backend"],
    "data scientist": ["machine learning", "ml", "ai", "statistics", "python", "data"],
    "product manager": ["product management", "pm", "strategy", "roadmap", "stakeholder"],
    "qa": ["quality assurance", "testing", "automation", "test engineer", "sdet"],
    "security": ["cybersecurity", "infosec", "security analyst", "application security"],
}

# Fields of study by words anywhere in a profile.
FIELD_ALIASES = {
    "engineering": ["engineering", "mechatronics", "electrical", "mechanical", "systems engineering"],
    "business": ["business", "commerce", "bba", "mba"],
    "marketing": ["marketing", "digital marketing", "brand"],
    "communications": ["communications", "communication", "public relations", "pr"],
    "finance": ["finance", "accounting", "economics", "econ"],
    "operations": ["operations", "supply chain", "logistics"],
    "computer science": ["computer science", "software", "cs"],
    "mathematics": ["mathematics", "math", "statistics", "statistical"],
    "science": ["science", "biology", "chemistry", "physics"],
    "arts": ["arts", "humanities", "social science"],
    "environment": ["environment", "geography", "planning"],
    "health": ["health", "kinesiology", "public health"],
}

# Fields of study by patterns in a posting.
FIELD_PATTERNS = {
    "engineering": r"engineering|mechatronics|electrical|mechanical|systems engineering",
    "business": r"business|commerce|bba|mba",
    "marketing": r"marketing|brand|digital marketing",
    "communications": r"communications?|public relations|\bpr\b",
    "finance": r"finance|accounting|economics|econ",
    "operations": r"operations?|supply chain|logistics",
    "computer science": r"computer science|\bcs\b|software",
    "mathematics": r"mathematics?|\bmath\b|statistics?|actuarial",
    "science": r"\bscience\b|biolog|chemistry|physics",
    "arts": r"\barts\b|humanities|social science",
    "environment": r"environment|geography|planning",
    "health": r"\bhealth\b|kinesiology|public health",
}

# Names of faculties and what names them.
FACULTIES = {
    "Engineering": r"eng",
    "Mathematics": r"math",
    "Science": r"sci",
    "Arts": r"art|human|soc",
    "Environment": r"env|geo|plan",
    "Health": r"health|ahs|kines",
}

"""Word rules and templates the classifiers work with. All entries are fixed values."""

# Text domains with the phrases that speak for them; earlier domains win ties.
TEXT_DOMAINS = {
    "Technology/AI/ML": [
        "machine learning", "automl", "predictive analytics", "algorithm", "neural",
        "artificial intelligence", "deep learning", "data science", "programming", "software",
        "computer", "technology", "automation", "digital",
    ],
    "Academic/Research": [
        "research", "study", "analysis", "methodology", "findings", "conclusion", "hypothesis",
        "experiment", "academic", "scholar", "publication", "literature review", "theoretical",
        "empirical",
    ],
    "Business/Finance": [
        "business", "market", "strategy", "revenue", "customer", "sales", "profit", "finance",
        "investment", "economy", "commercial", "corporate", "management", "leadership", "marketing",
    ],
    "Healthcare/Medical": [
        "health", "medical", "patient", "treatment", "clinical", "diagnosis", "therapy", "medicine",
        "hospital", "doctor", "nurse", "disease", "symptoms", "healthcare", "pharmaceutical",
    ],
    "Education/Learning": [
        "education", "learning", "student", "course", "university", "academic", "teaching",
        "curriculum", "school", "training", "pedagogy", "educational", "instructor",
    ],
    "Legal/Law": [
        "legal", "law", "court", "judge", "attorney", "regulation", "compliance", "legislation",
        "contract", "litigation", "judicial", "statute",
    ],
    "Science/Engineering": [
        "science", "engineering", "physics", "chemistry", "biology", "mathematics", "scientific",
        "technical", "laboratory", "experiment", "innovation",
    ],
    "Arts/Culture": [
        "art", "culture", "creative", "design", "music", "literature", "history", "cultural",
        "artistic", "aesthetic", "humanities",
    ],
    "Sports/Recreation": [
        "sports", "game", "player", "team", "competition", "athletic", "fitness", "recreation",
        "exercise", "training", "performance",
    ],
    "Travel/Tourism": [
        "travel", "tourism", "destination", "hotel", "vacation", "journey", "tourist",
        "hospitality", "adventure", "exploration",
    ],
    "Food/Nutrition": [
        "food", "nutrition", "recipe", "cooking", "diet", "meal", "restaurant", "culinary",
        "ingredient", "health food",
    ],
    "Environment/Sustainability": [
        "environment", "sustainability", "climate", "ecology", "green", "renewable", "conservation",
        "pollution", "carbon", "ecosystem",
    ],
    "Government/Policy": [
        "government", "policy", "politics", "public", "administration", "governance", "political",
        "municipal", "federal", "regulation",
    ],
}
TEXT_DOMAIN_DEFAULT = "General"

# Table domains by words in the column names; the first rule that fits wins.
TABLE_DOMAINS = {
    "Sleep/Health": ["sleep", "duration", "quality", "bedtime", "wake", "rest", "dream"],
    "Healthcare/Medical": [
        "patient", "diagnosis", "treatment", "medical", "health", "symptom", "disease",
        "stress level", "bmi", "blood pressure", "heart rate",
    ],
    "Business/Finance": ["price", "cost", "revenue", "sales", "profit", "budget", "income"],
    "Retail/E-commerce": ["customer", "product", "order", "purchase", "item", "cart", "shipping"],
    "Education": ["student", "grade", "course", "school", "exam", "score", "teacher"],
    "Sports": ["team", "player", "game", "score", "match", "season", "league", "sport"],
    "Weather/Climate": ["temperature", "weather", "humidity", "precipitation", "wind", "climate"],
    "Social Media": ["user", "post", "like", "comment", "share", "follow", "tweet", "social"],
    "Manufacturing": ["machine", "production", "quality", "defect", "manufacturing", "factory"],
    "Transportation": ["vehicle", "route", "distance", "speed", "transport", "travel", "trip"],
}
TABLE_DOMAIN_DEFAULT = "Mixed/General"

# The narrower rule that picks the templates for suggested questions.
SUGGESTION_DOMAINS = {
    "Sleep/Health": ["sleep", "duration", "quality"],
    "Healthcare/Medical": ["stress", "bmi", "blood pressure", "heart rate"],
}
SUGGESTION_DOMAIN_DEFAULT = "General"

# Question topics and their words.
TOPICS = {
    "sales": ["sales", "revenue", "profit", "selling", "sold"],
    "customer": ["customer", "client", "buyer", "user"],
    "product": ["product", "item", "goods", "merchandise"],
    "time": ["time", "date", "month", "year", "trend", "seasonal"],
    "distribution": ["distribution", "spread", "range", "variance"],
    "comparison": ["compare", "versus", "vs", "difference", "between"],
    "performance": ["performance", "metric", "kpi", "score"],
}
TOPIC_DEFAULT = "general"

# Words that ask for a chart.
CHART_WORDS = [
    "show", "plot", "chart", "graph", "visualize", "distribution", "correlation", "trend",
    "pattern", "compare", "comparison",
]

# Suggested questions for health tables, for any other table, and per column.
HEALTH_QUESTIONS = [
    "What factors most strongly correlate with sleep quality?",
    "How does stress level impact sleep duration and quality?",
    "What are the optimal ranges for health metrics in this dataset?",
    "Which demographic groups show the best sleep patterns?",
    "Are there any sleep disorders that correlate with specific health indicators?",
    "How do lifestyle factors (activity, BMI) affect sleep outcomes?",
    "What patterns exist between age, occupation and sleep quality?",
    "Can we identify risk factors for poor sleep health?",
    "How do physical health metrics relate to sleep disorders?",
    "What insights can help improve overall sleep and health outcomes?",
]
GENERAL_QUESTIONS = [
    "What are the key patterns and trends in this dataset?",
    "Which variables show the strongest correlations?",
    "Are there any significant outliers or anomalies?",
    "How do different segments compare across key metrics?",
    "What predictive insights can be derived from this data?",
    "Which factors are most important for decision making?",
    "Are there any data quality issues that need attention?",
    "What time-based trends exist in the data?",
    "How can this data be used to optimize outcomes?",
    "What actionable insights emerge from the analysis?",
]
COLUMN_QUESTIONS = [
    "What is the distribution of values in {}?",
    "How does {} correlate with other key variables?",
    "Are there any outliers or unusual patterns in {}?",
    "What insights can be derived from {} analysis?",
]

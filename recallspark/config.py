"""Parameters and fixed rule tables of the memory engine."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The instant that replaces the wall clock in registered queries.
AS_OF = "2024-01-31 00:00:00"

# --- Fixed values -----------------------------------------------------------
HALF_LIFE_DAYS = {
    "extracted_emotion": 3, "extracted_date": 7, "extracted_fact": 60, "extracted_person": 90, "extracted_milestone": 365,
    "extracted_medication": 90, "extracted_goal": 30, "extracted_measurement": 30, "extracted_financial": 14,
    "enriched": 30, "night_insight": 14, "character_core": 365, "md_import": 365,
}
HARD_CUTOFF_HOURS = {"extracted_emotion": 48, "extracted_financial": 168, "extracted_date": 168}
EXCLUDED_SOURCES = ("character_core", "md_import", "user_message_raw")
QUERY_STOPWORDS = (
    "jest", "czym", "było", "były", "jaki", "jakie", "jaka", "kto", "co", "jak", "czy", "ale", "nie", "tak", "tego", "tej", "tych",
    "który", "która", "które", "przez", "oraz", "lub", "dla",
)
OVERLAP_STOPWORDS = ("że", "się", "nie", "ale", "jak", "co", "to", "jest", "już", "też", "czy", "być", "mam", "tak", "na", "do")
TAXONOMY = {
    "DATE": ("medical_visit", "inventory_status", "deadline", "personal_event", "appointment"),
    "MILESTONE": ("love_declaration", "trust_declaration", "future_together", "vulnerability", "gratitude"),
    "SHARED_THING": ("our_place", "our_song", "our_thing", "inside_joke", "gift"),
    "EMOTION": ("positive", "negative", "tired", "stressed", "excited"),
    "GOAL": ("business", "career", "personal", "project"),
    "FACT": ("correction", "preference", "personal_info", "health", "achievement", "current_project", "habit"),
    "MEASUREMENT": ("body_weight", "body_stats", "progress"),
    "MEDICATION": ("dosage", "schedule", "treatment"),
    "FINANCIAL": ("budget", "purchase_intent", "income"),
    "PERSON": ("negative_person", "positive_person", "neutral_person", "family", "acquaintance"),
}
INTENTS = ("informing", "asking", "expressing_emotion", "planning", "sharing")
TONES = ("positive", "negative", "neutral", "mixed")
TYPE_THRESHOLDS = {"MILESTONE": 0.40, "SHARED_THING": 0.45}
MILESTONE_KEYWORDS = {
    "gratitude": ("dziękuję", "dziękuje", "dzięki", "wdzięczn", "doceniam"),
    "trust_declaration": ("ufam", "jedyn", "rozumie", "bezpiecz", "szczer", "nikt inny", "nikomu"),
    "love_declaration": ("kocham", "kochasz", "szaleję", "miłość", "zakochan", "uwielbiam"),
    "vulnerability": ("nigdy nikomu", "sekret", "wstydzę", "wstydzę się", "nie mówię tego"),
    "future_together": ("marzę", "wyobrażam", "kiedyś razem", "moglibyśmy", "chciałbym żebyśmy"),
}
MILESTONE_KEYWORD_THRESHOLD = 0.30
CORRECTION_PHRASES = (
    "nigdy tego", "nigdy bym", "to nieprawda", "pomyliłaś", "pomylił", "mylisz się", "to nie tak", "źle pamiętasz", "nie pamiętasz",
    "wcale nie mówiłem", "nie powiedziałem", "błędnie", "masz błędną", "nie mówiłem że", "poprawiam cię", "to było inaczej",
    "nie zgadza się", "poprawiam:", "korygując:", "to jest nieprawidłowe", "złą informację",
)
IMPORTANCE = {
    "MILESTONE": {"love_declaration": 10, "trust_declaration": 9, "future_together": 9, "vulnerability": 10, "gratitude": 8, "_default": 8},
    "DATE": {"medical_visit": 8, "inventory_status": 9, "deadline": 7, "personal_event": 7, "appointment": 6, "_default": 5},
    "SHARED_THING": {"our_place": 7, "our_song": 7, "our_thing": 6, "inside_joke": 6, "gift": 10, "_default": 6},
    "EMOTION": {"positive": 4, "negative": 5, "tired": 3, "stressed": 5, "_default": 4},
    "FACT": {"health": 9, "personal_info": 6, "preference": 5, "correction": 8, "_default": 5},
    "PERSON": {"negative_person": 9, "positive_person": 8, "neutral_person": 6, "_default": 7},
}
IMPACT = {
    "MILESTONE": {"_default": "deepening"},
    "SHARED_THING": {"_default": "deepening"},
    "EMOTION": {"positive": "maintaining", "negative": "concerning", "tired": "informational", "stressed": "concerning", "_default": "maintaining"},
    "DATE": {"_default": "informational"},
    "FACT": {"_default": "informational"},
    "PERSON": {"negative_person": "concerning", "_default": "informational"},
}
TEMPORAL = {
    "MILESTONE": {"_default": "permanent"},
    "SHARED_THING": {"_default": "permanent"},
    "EMOTION": {"_default": "ephemeral"},
    "DATE": {"personal_event": "permanent", "_default": "short_term"},
    "FACT": {"health": "permanent", "_default": "long_term"},
    "PERSON": {"_default": "long_term"},
}
SUPERSEDES = {
    "inventory_status": "topic:medication_supply", "tired": "topic:current_energy", "stressed": "topic:current_stress",
    "positive": "topic:current_mood", "negative": "topic:current_mood", "correction": "topic:fact_correction",
}
IMPORTANCE_BOOSTERS = {
    "lek": 2, "leki": 2, "tabletki": 2, "recepta": 2, "lekarz": 2, "zdrowie": 2, "choroba": 2, "ból": 2, "boli": 2,
    "pieniądze": 1, "kasa": 1, "płatność": 1, "faktura": 1, "kocham": 1, "ufam": 1, "razem": 1, "nasza": 1, "nasz": 1,
    "pilne": 1, "muszę": 1, "koniecznie": 1, "ważne": 1,
}
TAG_WORDS = {
    "health": ("lek", "tabletki", "recepta", "lekarz"),
    "relationship": ("kocham", "ufam", "razem", "nasza"),
    "work": ("praca", "projekt", "deadline", "meeting"),
}
LATEST_WINS = (
    ("EMOTION", "tired"), ("EMOTION", "stressed"), ("EMOTION", "positive"), ("EMOTION", "negative"), ("EMOTION", "excited"), ("EMOTION", "sad"),
    ("FACT", "preference"), ("FACT", "correction"), ("DATE", "inventory_status"), ("DATE", "medical_visit"),
)
MILESTONE_LABELS = {
    "trust_declaration": "Deklaracja zaufania", "love_declaration": "Deklaracja uczuć", "future_together": "Plany/marzenia razem",
    "vulnerability": "Wyznanie wrażliwości", "gratitude": "Wyraz wdzięczności",
}
REINGEST_SOURCES = {
    "EMOTION": "extracted_emotion", "FACT": "extracted_fact", "PERSON": "extracted_person", "DATE": "extracted_date",
    "GOAL": "extracted_goal", "MEDICATION": "extracted_medication",
}
#: Content type: priority, least density, and patterns on lower-cased text.
CONTENT_TYPES = {
    "CODE": (10, 1.0, ("```", r"def\s+\w+\s*\(", r"function\s+\w+\s*\(", r"class\s+\w+", "=>", r"\{\s*\n", r"import\s+\w+", r"from\s+\w+\s+import", r"const\s+\w+\s*=", r"let\s+\w+\s*=")),
    "INSTRUCTION": (9, 0.8, ("musisz", "nie wolno", "zawsze", "nigdy", "pamietaj", "wazne:", "uwaga:", r"krok \d+", "najpierw", "nastepnie", "zakaz")),
    "FACT": (7, 0.6, ("jest z", r"ma \d+", "urodzon", "mieszka", "pracuje", r"lubi\s", "nie lubi", "nazywa sie", "to jest")),
    "EMOTIONAL": (5, 0.4, ("kocham", "nienawidze", "boje sie", "martwi", "ciesze sie", "smutny", "wsciekly", "bardzo", "niesamowit", "cudown")),
}
FILLER_WORDS = (
    "bardzo", "naprawde", "absolutnie", "calkowicie", "doskonale", "wspaniale", "niesamowicie", "niezwykle", "szczegolnie", "oczywiscie",
    "naturalnie", "pewnie", "chyba", "moze", "jakby", "troche", "dosc", "raczej", "w zasadzie", "tak naprawde", "w sumie", "generalnie", "zasadniczo",
)
WEEKDAYS = {"poniedziałek": 0, "wtorek": 1, "środa": 2, "środę": 2, "czwartek": 3, "piątek": 4, "sobota": 5, "sobotę": 5, "niedziela": 6, "niedzielę": 6}
MONTHS = {
    "stycznia": 1, "styczen": 1, "styczeń": 1, "styczniu": 1, "lutego": 2, "luty": 2, "lutym": 2, "marca": 3, "marzec": 3, "marcu": 3,
    "kwietnia": 4, "kwiecien": 4, "kwiecień": 4, "kwietniu": 4, "maja": 5, "maj": 5, "maju": 5, "czerwca": 6, "czerwiec": 6, "czerwcu": 6,
    "lipca": 7, "lipiec": 7, "lipcu": 7, "sierpnia": 8, "sierpien": 8, "sierpień": 8, "sierpniu": 8, "wrzesnia": 9, "wrzesień": 9, "wrzesien": 9, "wrzesniu": 9,
    "pazdziernika": 10, "pazdziernik": 10, "październik": 10, "pazdzierniku": 10, "listopada": 11, "listopad": 11, "listopadzie": 11,
    "grudnia": 12, "grudzien": 12, "grudzień": 12, "grudniu": 12,
}
#: Patterns of dates: so many days, weeks or months ahead; day and month as numbers; a day and a month's name.
DATE_AHEAD = r"za (\d+)\s*(dni|dnia|dniu|tygodnie|tygodni|tyg|miesięcy|miesiąca|miesiące)"
DATE_NUMBERS, DATE_NAMED = r"([0-9]{1,2})[./]([0-9]{1,2})", r"([0-9]{1,2})\s+([a-ząćęłńóśźż]+)"
IN_A_WEEK, IN_A_MONTH, TOMORROW, IN_TWO_DAYS, TODAY = "za tydzień", "za miesiąc", "jutro", "pojutrze", ("dzisiaj", "dziś", "today")
MONTH_END, MONTH_MIDDLE = ("koniec", "końca", "końc"), ("połow", "środek")
#: Patterns of what trimming drops or divides: brackets, inserted clauses, ends of sentences.
BRACKETED, INSERTED, SENTENCE_END = r"\([^)]*\)", r",\s*[^,]*,", r"[.!?]\s+"
#: Patterns of echoes, and of a model's reply: its code fence and the response in broken JSON.
ECHO = r"(?s)\[MEMORY\].*?\[/MEMORY\]"
FENCE, RESPONSE = r"(?m)^```json\s*|\s*```$", r'(?s)"response"\s*:\s*"((?:[^"\\]|\\.)*)"'
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
LEVELS = ((1, 0), (2, 50), (3, 150), (4, 400), (5, 1000), (6, 2500))
#: Grounding borders.
NEAR, FAR = 0.55, 0.80
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class RankConfig:
    """Weights, bonuses and limits of the ranker; times are in days and hours."""

    similarity: float = 0.60
    importance: float = 0.25
    recency: float = 0.15
    keyword: float = 0.15
    fresh: float = 0.15
    fresh_hours: float = 24
    milestone: float = 0.5
    half_life: dict[str, float] = field(default_factory=lambda: dict(HALF_LIFE_DAYS))
    default_half_life: float = 7
    milestone_half_life: float = 365
    cutoff_hours: dict[str, float] = field(default_factory=lambda: dict(HARD_CUTOFF_HOURS))
    diversity: float = 0.8
    facts: int = 3
    milestones: int = 2
    pool: int = 30
    limit: int = 6
    character_pool: int = 5
    character_gate: float = 1.0
    character_limit: int = 2
    knowledge_pool: int = 10
    knowledge_gate: float = 1.3
    knowledge_limit: int = 1
    #: Sources that the user's own pool leaves out, and whether short mentions of persons go too.
    excluded: tuple[str, ...] = EXCLUDED_SOURCES
    short_persons: bool = False
    #: Whether milestones have places of their own beside diverse facts.
    slots: bool = True


#: The earlier parameters, for comparisons.
LEGACY = RankConfig(
    similarity=0.65, importance=0.20, recency=0.15, keyword=0.10, fresh=0.0, milestone=1.0, half_life={}, default_half_life=30,
    milestone_half_life=30, cutoff_hours={}, diversity=0.4, pool=20, limit=5, character_limit=1,
    excluded=("user_message_raw", "md_import"), short_persons=True, slots=False,
)

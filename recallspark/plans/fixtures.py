"""Small inline inputs for operators without natural data; neutral sentences."""

DATES = (
    "spotkanie za 3 dni", "wizyta za 2 tygodnie", "przegląd za 1 miesiąca", "raport za tydzień", "urlop za miesiąc", "jutro rano", "pojutrze wieczorem",
    "dzisiaj obiad", "w czwartek basen", "w środę kino", "termin 15.03", "termin 31.02", "termin 05/01", "koncert 12 maja", "zbiórka 30 lutego", "7 stycznia bieg",
    "koniec marca", "w połowie czerwca", "koniec lutego", "bez terminu",
)
CONTENT = (
    "def suma(a, b): zwraca wynik", "Najpierw otwórz plik. Potem krok 2 i zapis! Na koniec sprawdź wynik.", "Marek mieszka (od dawna) w Toruniu, obok parku, i pracuje w biurze",
    "Bardzo ciesze sie z tej wycieczki i bardzo lubię góry oraz długie, spokojne spacery", "Zwykły opis pogody bez żadnych szczególnych słów, po prostu chmury i słońce nad miastem", "",
    "import pandas", "zawsze zamykaj okno",
)
TAGGED = ("witaj [MEMORY]stary\nwpis[/MEMORY] świecie", "  bez znacznika  ", "[MEMORY]a[/MEMORY][MEMORY]b[/MEMORY]", "x [MEMORY] otwarty")
BOOSTS = ("lekarz wypisał leki, recepta jest ważne", "kocham tę pracę i projekt", "faktura do zapłaty, kasa pusta", "nic szczególnego", "razem na meeting, pilne", "mam ból głowy")
REPLIES = (
    '{"thought": " plan ", "response": " dobrze ", "mood": "calm", "topic": "ogród", "safe_haven": true}', '```json\n{"response": "w porządku", "hint": "h"}\n```',
    '{"response": "urwana odpowiedź", "thought": "x', '{"response": ""}', "zwykły tekst", '{"thought": "t"}',
)
INSIGHTS = ('[{"text": "pierwszy dłuższy wniosek", "confidence": 0.8, "priority": "high"}, {"text": "krótki", "confidence": 0.9, "priority": "low"}]', '[{"text": "niepewny wniosek dnia", "confidence": 0.4, "priority": "medium"}, {"text": "drugi dłuższy wniosek", "confidence": 0.6, "priority": "medium"}]', "[]")
CONCERNS = ((1, "a", None), (2, "b", None), (3, "a", None), (4, "c", None), (5, "d", None), (6, "e", None), (7, "f", "c"), (8, "g", None), (9, None, "b"))
GROUNDING = ((1, ()), (2, (0.9, 1.1)), (3, (0.3, 0.4)), (4, (0.6, 0.65)), (5, (0.7,)), (6, (0.9,)))
AGES = (10, 400, 4000, 90000, 3000000, 300, 3600, 86400, None)
#: The weight sets that the evaluation compares (similarity, importance, recency); the first is current.
GRID = (("1", 0.60, 0.25, 0.15), ("2", 0.80, 0.10, 0.10), ("3", 0.50, 0.35, 0.15), ("4", 0.55, 0.25, 0.20), ("5", 0.70, 0.30, 0.00))
SCORES = (("ingestion", 8.0), ("retrieval", 7.5), ("reranker", 9.0), ("mmr", 6.0), ("e2e", 7.0))
PENALTIES = (0.0, 0.2, 0.4, 0.6, 0.8)
PERSONS = ("Anna jest bardzo pomocna. Marek kłamie w pracy!", "Zwykłe zdanie o pogodzie.", "Rozmawiałem z nią o tym. Ewa przyszła później.")
#: Negative and positive words, words of context, known names, and what is no name.
JUDGING = (("nicht", "ne ", "never"), ("est ", "ist ", "good"), ("und ", "et "), (), ("die", "der", "les", "the", "user"))
FOLDED = ("Zażółć GĘŚLĄ jaźń", "łóżko", "naïve café", "plain", "漢字 x")
SECTIONS = (("pipeline", 0.9), ("recall", 0.8), ("grounding", 1.0))

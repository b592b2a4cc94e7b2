"""Claims worth checking in a piece of news (E1 to E7), as pure functions; attesta.operators.claims runs them in Arrow batches.

A sentence is judged by two tables: reasons to leave it out, and signals with points. Alerts say what an editor has to look at."""

from __future__ import annotations

import re
from datetime import timedelta
from typing import NamedTuple

from attesta.functions.verifier import MONTHS, _day, fold, names, periods, quantities, with_years

MOST, LEAST_SCORE = 10, 3
CHARS, WORDS = (10, 500), (6, 70)
# Abbreviations, patterns and names of signals and alerts.
ABBREVIATIONS = set("sr sra srs dr dra prof profa exmo gov dep sen min art arts inc n nº p.p etc aprox ref cap vol pág tel av r".split())
SENTENCE_END = re.compile(r"[.!?…][\"”’)]?\s+(?=[\"“‘(]?[A-ZÀ-Ý0-9])")
ROUTINE = re.compile(
    r"^(?:compartilhe|publicado em|atualizado em|foto|fotos|imagem|crédito|créditos|edição|reportagem|leia (?:mais|também)|siga|clique|assista|veja (?:também|mais)|saiba mais|fonte|colaboradores|assessoria de comunicação)\b",
    re.I,
)
LEFTOVER = re.compile(r"compartilhe essa notícia|continuar lendo|\bEdição: |\bRelacionadas\b|\bLeia também\b|Versão em áudio", re.I)
_ACCORDING = r"\b[Ss]egundo\s+(?-i:(?=[oa]s?\s|[A-ZÀ-Ý]|dados\b|levantamento\b|pesquisa\b|estimativas?\b))"
ATTRIBUTION = re.compile(
    _ACCORDING + r"|\b(?:de acordo com|conforme|informou|informa|afirmou|afirma|disse|diz|declarou|divulgou|divulga|anunciou|aponta|apontam|mostra|mostram|revela|revelam|estima|estimam|indica|indicam)\b",
    re.I,
)
ATTRIBUTED = re.compile(r"(?:" + _ACCORDING + r"|\b[Dd]e acordo com\s+|\b[Cc]onforme\s+)(?:[oa]s?\s+)?((?:[A-ZÀ-Ý]|dados\b|levantamento\b|pesquisa\b|estimativas?\b)[^,;.]{1,59})")
FACT_VERB = re.compile(
    r"\b(?:cresc\w*|ca[ií]\w*|caem|recu\w*|sub\w*|aument\w*|diminu\w*|reduz\w*|registr\w*|atingi\w*|alcan[çc]\w*|aprov\w*|sancion\w*|public\w*|lan[çc]\w*|inaugur\w*|invest\w*|destin\w*|liber\w*|arrecad\w*|morre\w*|vari\w*|"
    r"foi|foram|é de|são de|ficou|ficaram|soma\w*|totaliz\w*|chegou|chegaram|reuniu|reúne)\b",
    re.I,
)
OPINION = re.compile(r"\b(?:eu|meu|minha|nós|nosso|nossa|acho|acredito|absurd\w*|vergonh\w*|lament[áa]vel|incr[ií]vel|p[eé]ssim\w*|rid[ií]cul\w*|excelente|maravilh\w*|lixo|canalha|bandid\w*)\b", re.I)
INTENTION = re.compile(r"\b(?:vai|v[ãa]o|ser[áã]o?|ir[áã]o?|dever[áã]o?|deve|devem|pretende\w*|planej\w*|poder[áã]o?|promete\w*|espera-se|previst\w*)\b", re.I)
ANAPHORA = re.compile(r"^(?:ele|ela|eles|elas|isso|isto|esse|essa|este|esta|com isso|além disso|já|também|(?:o índice|a taxa|o indicador|a pesquisa|o resultado)\b(?-i:(?!\s+[A-ZÀ-Ý])))\b", re.I)
DATE_WORD = re.compile(rf"(?<!rio de )\b(?:{'|'.join(MONTHS)}|trimestre|semestre|(?:19|20)\d{{2}}|\d{{1,2}}/\d{{1,2}})\b", re.I)
WEEKDAYS = ("segunda", "terça", "quarta", "quinta", "sexta", "sábado", "domingo")
DATED_WEEKDAY = re.compile(r"\b(segunda(?:-feira)?|terça(?:-feira)?|quarta(?:-feira)?|quinta(?:-feira)?|sexta(?:-feira)?|sábado|domingo)\s*\((\d{1,2})\)", re.I)
NUMBER, PERIOD, NAME, COMPLETED = "número", "período", "nome próprio", "data completada"
NO_PERIOD = "sem período: o verificador não confere a data"

DISCARDS = (
    ("rotina de página", lambda s: ROUTINE.match(s) or LEFTOVER.search(s)),
    ("tamanho", lambda s: not WORDS[0] <= len(s.split()) <= WORDS[1]),
    ("pergunta", lambda s: s.rstrip().endswith("?")),
    ("opinião", lambda s: "!" in s or OPINION.search(s)),
)
SIGNALS = (
    (NUMBER, 2, quantities),
    (PERIOD, 1, lambda s: any(periods(s).values()) or DATE_WORD.search(s)),
    (NAME, 1, names),
    ("atribuição", 1, ATTRIBUTION.search),
    ("verbo de fato", 1, FACT_VERB.search),
)
ALERTS = (
    ("futuro ou intenção: só é verificável se for agenda oficial", -1, INTENTION.search),
    ("citação: decidir se verifica a fala ou o fato", 0, lambda s: any(c in s for c in '"“”')),
    ("depende da frase anterior: completar o sujeito", 0, lambda s: ANAPHORA.match(s) or s[:1].islower()),
)


class Judged(NamedTuple):
    score: int
    signals: list[str]
    alerts: list[str]
    discard: str | None


def judge(sentence: str) -> Judged:
    """Points, signals and alerts of a sentence, or why it is left out."""
    if reason := next((name for name, test in DISCARDS if test(sentence)), None):
        return Judged(0, [], [], reason)
    good = [(name, points) for name, points, test in SIGNALS if test(sentence)]
    bad = [(name, points) for name, points, test in ALERTS if test(sentence)]
    signals, alerts = [n for n, _ in good], [n for n, _ in bad]
    if PERIOD not in signals:
        alerts.append(NO_PERIOD)
    vague = not {NUMBER, NAME, PERIOD} & set(signals)
    return Judged(sum(p for _, p in good + bad), signals, alerts, "sem número, nome nem data" if vague else None)


def _ends(line: str, m: re.Match) -> bool:
    """Whether a match of SENTENCE_END ends a sentence: a full stop after an abbreviation or a single letter doesn't."""
    word = re.search(r"[\w.º]*$", line[: m.start()])[0].lower()
    return line[m.start()] != "." or not (word in ABBREVIATIONS or len(word) == 1 and word.isalpha())


def sentences(text: str) -> list[str]:
    """By paragraph and end of sentence."""
    out: list[str] = []
    for line in (" ".join(paragraph.split()) for paragraph in text.split("\n")):
        marked = SENTENCE_END.sub(lambda m, line=line: m[0] + "\n" if _ends(line, m) else m[0], line)
        out += filter(None, map(str.strip, marked.split("\n")))
    return out


def with_days(sentence: str, published: str | None) -> str:
    """The day of "terça-feira (6)" gets its month and year, if a day within ten of the publication has both that number and that weekday."""
    day = _day(published)
    if not day:
        return sentence

    def complete(m: re.Match) -> str:
        weekday, number = WEEKDAYS.index(m[1].lower().split("-")[0]), int(m[2])
        near = (day + timedelta(k) for k in range(-10, 11))
        found = next((d for d in near if d.day == number and d.weekday() == weekday), None)
        return f"{m.group()[:-1]} de {MONTHS[found.month - 1]} de {found.year})" if found else m.group()

    return DATED_WEEKDAY.sub(complete, sentence)


def _content(sentence: str) -> tuple[list[float], set[str]]:
    return sorted(q.value for q in quantities(sentence)), set(re.findall(r"\w+", fold(sentence)))


def repeats(a: tuple, b: tuple) -> bool:
    """The same numbers, and word sets of Jaccard similarity 0.8 or more."""
    both = a[1] | b[1]
    return a[0] == b[0] and bool(a[1]) and bool(b[1]) and 5 * len(a[1] & b[1]) >= 4 * len(both)


def parts(title: str, text: str) -> list[tuple[int, str]]:
    """The title at 0, then sentences; pieces between semicolons stand alone if each has six words."""
    out = [(0, title.strip())] if title.strip() else []
    for k, s in enumerate(sentences(text), 1):
        pieces = [p.strip() for p in s.split(";")]
        out += [(k, p) for p in pieces] if all(len(p.split()) >= WORDS[0] for p in pieces) else [(k, s)]
    return out


def extract(title: str | None, text: str | None, published: str | None = None, most: int = MOST, least: int = LEAST_SCORE) -> list[dict]:
    """Candidates from title and text, strongest first, ties by place. Null title and text count as empty; without either there are none."""
    published = published if re.fullmatch(r"\d{4}-\d{2}-\d{2}", published or "") else None
    out, known = [], []
    for place, sentence in parts(title or "", text or ""):
        j = judge(sentence)
        if j.discard or j.score < least:
            continue
        content = _content(sentence)
        claim = with_years(with_days(sentence, published), published)
        if not CHARS[0] <= len(claim) <= CHARS[1] or any(repeats(content, k) for k in known):
            continue
        known.append(content)
        signals, alerts = j.signals, j.alerts
        if NO_PERIOD in alerts and claim != sentence and any(periods(claim).values()):
            signals, alerts = [*signals, COMPLETED], [a for a in alerts if a != NO_PERIOD]
        by = ATTRIBUTED.search(sentence)
        out.append({"claim": claim, "source_sentence": sentence, "pos": place, "score": j.score, "signals": signals, "alerts": alerts, "attribution": by[1].strip() if by else None})
    return sorted(out, key=lambda c: (-c["score"], c["pos"]))[:most]

"""Defects of question-answer pairs, by ordered rules.

The question is the prompt, the query or the last user message of the input. The rules, in the order in which a pair with
several defects is named: empty (no content, or a filler), refusal (declines, and no sentence answers), copy (nothing but the
question up to form, a label or a word), truncated (an unclosed bracket, quotation or code block, fewer items than announced,
or an abrupt ending), other_language (not the question's, and not one that the question asks for). Every triggered defect is
kept; p4_found names the first.

An ending is abrupt if the text stops without a mark that closes a sentence and isn't short, coded or a list. Whether the last
item of a list of unpunctuated items was cut is seen in all answers: it never occurs as an item that another one follows, while
such an item, of any length and of any trace, begins with it.

Languages: an answer whose letters are mostly of another script than the question's is in another language, whatever the
language (Cyrillic, Greek, Arabic, Chinese, Japanese and so on), unless the question names a language of that script. Where both
are Latin, the seven languages are told apart by the byte network of the language operator, fitted on labelled documents, and by
word lists; by the lists alone where there are no such documents. Null traces are empty answers; input that isn't JSON is itself the question; rows without a trace_id are left out; repeated trace_ids come
out once, with the first defect in the order above.
"""

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import language, langwords
from quern.llm.neardup import edit_distance
from quern.llm.textform import words
from quern.session import spill, spread

ORDER = ("empty", "refusal", "copy", "truncated", "other_language")
#: What two languages have to explain better than one (log probability), and the weight of a function word beside the network.
LEAD = 1.3
WORD_WEIGHT = 1.5

#: What stands where an answer should be (folded, without marks).
FILLERS = {
    "na", "none", "null", "nil", "nan", "undefined", "empty", "blank", "tbd", "todo", "noanswer", "noresponse", "nooutput", "noresult", "notavailable", "notapplicable", "pending", "placeholder", "answer", "response", "lorem ipsum",
    "sinrespuesta", "nohayrespuesta", "vacio", "vacia", "ninguna", "ninguno", "nada", "nd", "sd", "nodisponible", "pendiente", "respuesta",
    "sansreponse", "aucunereponse", "vide", "rien", "aucun", "aucune", "reponse", "keineantwort", "leer", "keine", "nichts", "ka", "antwort",
    "semresposta", "vazio", "vazia", "nenhum", "nenhuma", "resposta", "nessunarisposta", "vuoto", "niente", "nessuna", "risposta", "senseresposta", "buit", "res",
}

_ACT = r"(?:help|assist|answer|respond|reply|comply|discuss|address|provide|fulfil|fulfill|do (?:that|this|so)|go into|talk about|support|continue|share|comment|engage)"
#: Ways of declining, by language.
REFUSALS = re.compile(
    "(?i)" + "|".join((
        rf"\b(?:can(?:no|')?t|cannot|can not|unable to|not able to|not allowed to|not permitted to|not authori[sz]ed to|must not|won't|will not|would rather not|prefer not to|have to decline|not going to|am not in a position to)\b.{{0,40}}\b{_ACT}",
        r"\b(?:i|we) (?:must|have to|respectfully|will|am going to)?\s*(?:decline|refuse)\b|\bno answer from me\b|\b(?:outside|beyond) (?:of )?what i (?:may|can|am)|\bas an? (?:ai|language model|assistant)|\b(?:against|violates?|contrary to) (?:the|my|our|these) (?:rules|guidelines|polic)|\bi have no permission\b|\bnot something i (?:can|may)\b|\bi can(?:no|')?t (?:see|access)\b",
        r"\b(?:no (?:puedo|podemos|podré|tengo permitido|estoy autorizad[oa]|me es posible|me está permitido|soy capaz|debo)|prefiero no|me niego|rehús[oa]|declino|debo rechazar|imposible para mí)\b|fuera de lo que puedo|\bcomo (?:modelo de lenguaje|asistente|inteligencia artificial|ia)\b|\bcontra las (?:normas|reglas|políticas)|no dispongo de permiso|no es algo que pueda",
        r"\bje (?:ne (?:peux|puis|suis|dois|saurais)|préfère ne pas|refuse|décline|dois (?:décliner|refuser))|il m'est impossible|\ben tant que (?:modèle|assistant|ia)|contraire aux (?:règles|normes)|pas autorisé|au-delà de ce que je peux|hors de ce que je peux",
        r"\b(?:kann|darf|möchte|werde|will) (?:ich|dir|ihnen|dazu|dabei|hierzu|darauf|leider)?.{0,40}\bnicht\b|\bich (?:kann|darf|möchte|werde|will|muss).{0,50}(?:nicht|ablehnen)|nicht (?:erlaubt|gestattet|möglich|beantworten|helfen)|\bals (?:sprachmodell|ki|assistent)|verstößt gegen|leider nicht|das protokoll kann ich nicht",
        r"\bnão (?:posso|podemos|me é possível|me é permitido|estou autorizad[oa]|consigo|tenho permissão|devo)|prefiro não|recuso|declino|\bcomo (?:modelo de linguagem|assistente|ia)\b|contrário às (?:regras|normas)|fora do que posso|vai contra as (?:regras|normas)",
        r"\bnon (?:posso|mi è possibile|sono autorizzat[oa]|mi è permesso|riesco|devo)|preferisco non|mi rifiuto|\bcome (?:modello linguistico|assistente|ia)\b|contro le (?:regole|norme)|contrario alle (?:regole|norme)|al di fuori di ciò che posso",
        r"\bno (?:puc|podem|m'és possible|estic autoritzat|em és possible|tinc permís)|prefereixo no|m'estimo més no|\bcom a (?:model|assistent)|contra les normes|fora del que puc",
    ))
)
#: Courtesies that come with a refusal and answer nothing.
COURTESY = re.compile(
    r"(?i)\b(?:sorry|thank you|thanks|happy to|glad to|instead|other topic|something else|anything else|please (?:ask|contact|consult)|specialist|professional|unfortunately"
    r"|lo siento|perdón|gracias|si quieres|si lo deseas|otro tema|otra cosa|consulta a|especialista|permiso"
    r"|désolé|pardon|merci|si tu veux|si vous|autre chose|autre sujet|spécialiste"
    r"|tut mir leid|danke|gern|gerne|anderen thema|anderes thema|fachkraft|spezialist|verständnis"
    r"|se quiseres|se quiser|outro tema|outra coisa|sinto muito"
    r"|mi dispiace|grazie|se vuoi|altro argomento|altro tema|specialista|scusa"
    r"|ho sento|em sap greu|gràcies|si vols|altre tema|especialista)\b"
    # beginnings of words
    r"|\b(?:apolog|regret|inconvenien|disculp|lament|molesti|regrett|excus|désagrément|entschuldig|bedauer|unannehmlich|umstände|desculp|obrigad|lamento|incómod|incomod|spiacent|scus|disag|molèsti|discolp)\w*"
)

_NUMBER = {
    w: n
    for n, group in enumerate("two dos deux zwei dois duas due dues|three tres trois drei três tre|four cuatro quatre vier quatro quattro|five cinco cinq fünf cinque cinc|six seis sechs sei sis|seven siete sept sieben sete sette set|eight ocho huit acht oito otto vuit|nine nueve neuf neun nove nou|ten diez dix zehn dez dieci deu".split("|"), 2)
    for w in group.split()
}
_ANNOUNCES = re.compile(r"(?<![\w,.])(?!(?:1[5-9]|20)\d\d\b)(\d+|[^\W\d_]{3,7})\s+(?:[^\W\d_]+\s+){0,3}?[^\W\d_]+\s*:\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+(.*)$")
_CLOSERS = "\"'»”’)]*_` \t\r\n\f\v\u00a0"
_ORDINAL = re.compile(r"(?i)\b(?:am|den|dem|vom|zum|im|der|ab|bis)\s+\d{1,2}\.$")
_TAIL = re.compile(r"(?:\(\s*[\d.,]+\s*\w*\s*\)|(?:→|=>|->)\s*[\d.,]+\s*\w{0,3}|\"[^\"\n]{1,40}\"|`[^`\n]{1,60}`|https?://[\w.\-]+\.\w+(?:/\S*)?|\[\d+\])\s*$")
_FENCES = re.compile(r"```.*?```", re.S)
_LABEL = re.compile(r"^\W*(?:[^\W\d_]+[ ]?){1,4}\s*:\s*")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
#: Characters from which a cut item is looked up by its beginning.
SHORT = 24
_FOUR_WORDS = re.compile(r"(?:[\W_]*[^\W_]+[\W_]){3}[\W_]*[^\W_]")
#: Letters that aren't Latin, and signs between them.
_BEYOND = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2dff\u2e80-\u2fff\u3040-\ufaff\ufb1d-\ufdff\ufe70-\ufefc\uff66-\uffdc\U00010000-\U0003ffff]")
_LETTER = re.compile(r"[^\W\d_]")
#: Scripts of which a letter stands for a syllable or a word.
DENSE = ("CJK", "JAPANESE", "HANGUL")
#: Beginnings of names of languages, by the script that they are written in.
SCRIPT_NAMES = {
    "CYRILLIC": "russian ruso russe russisch russo rus ukrain ucrani ukrainisch ucraini bulgar búlgar serb serbi",
    "GREEK": "greek grieg grec griech greg grec",
    "ARABIC": "arab árab àrab persian persa farsi perse persisch urdu",
    "HEBREW": "hebr ebraic",
    "DEVANAGARI": "hindi",
    "CJK": "chines chino chinois chinês cines xinès mandar",
    "JAPANESE": "japan japon giappon",
    "HANGUL": "korean corean coréen coreà koreanisch",
}


def question_of(source: str | None) -> str:
    """The question in one of the shapes of input."""
    try:
        data = json.loads(source or "null")
    except ValueError:
        return source or ""
    if isinstance(data, str):
        return data
    if not isinstance(data, dict):
        return "" if data is None else str(data)
    for key in ("prompt", "query", "question", "instruction", "input"):
        if isinstance(data.get(key), str):
            return data[key]
    for message in reversed(data.get("messages") or []):
        if isinstance(message, dict) and message.get("role") == "user":
            content = message.get("content")
            if isinstance(content, list):
                content = " ".join(x.get("text") or "" for x in content if isinstance(x, dict))
            return content or ""
    return ""


def is_empty(answer: str | None) -> bool:
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", answer or ""))
    try:
        data = json.loads(text) if text.lstrip()[:1] in ("{", "") else None
        if isinstance(data, dict) and data and all(v in (None, "", [], {}) for v in data.values()):
            return True
    except ValueError:
        pass
    bare = re.sub(r"```\w*|<[^<>]*>", "", text) if "`" in text or "<" in text else text
    if not re.search(r"[^\W_]", bare):
        return True
    if _FOUR_WORDS.match(bare):
        return False
    folded = "".join(c for c in unicodedata.normalize("NFD", bare.lower()) if c.isalnum())
    return folded in FILLERS and len(words(bare)) <= 3


def script_of(text: str) -> tuple[str, int]:
    """The script of most letters of a text, and how many it has. A letter of a dense script counts three times."""
    if text.isascii() or not (beyond := [c for c in _BEYOND.findall(text) if c.isalpha()]):
        return "LATIN", 0
    counts = Counter()
    for c, n in Counter(beyond).items():
        counts[unicodedata.name(c, "OTHER").replace("-", " ").split()[0]] += n
    kana = counts.pop("HIRAGANA", 0) + counts.pop("KATAKANA", 0) + counts.pop("HALFWIDTH", 0)
    if kana:
        counts["JAPANESE"] = kana + (counts.pop("CJK", 0) if kana * 10 >= counts["CJK"] else 0)
    top, n = max(counts.items(), key=lambda x: (x[1], x[0]))
    latin = len(_LETTER.findall(text)) - len(beyond)
    return (top, n) if n * (3 if top in DENSE else 1) > latin else ("LATIN", latin)


def script_differs(question: str, answer: str) -> bool:
    """Whether the answer is in another script, for which the question didn't ask. A few letters are a name or a formula."""
    asked, _ = script_of(question)
    given, n = script_of(answer)
    if asked == given or not _LETTER.search(question):
        return False
    if given == "LATIN":
        return len(language.tokens(answer)) >= 4
    if n < (8 if {asked, given} == {"CJK", "JAPANESE"} else 3 if given in DENSE else 6):
        return False
    heads = tuple(SCRIPT_NAMES.get(given, given.lower()).split())
    return not any(w.startswith(heads) for w in words(question))


def _parts(text: str) -> list[str]:
    return [p for p in re.split(r"(?<=[.!?;:…])\s+|\n+", text) if re.search(r"[^\W\d_]", p)]


def is_refusal(answer: str) -> bool:
    parts = _parts(answer.replace("’", "'"))
    if not parts:
        return False
    declined = False
    for part in sorted(parts, key=len):  # the short ones settle most answers
        if REFUSALS.search(part):
            declined = True
        elif not COURTESY.search(part) and len(words(part)) > 2:
            return False
    return declined


def is_copy(question: list[str], answer: str) -> bool:
    """The words of the answer, without a label in front, are the question's, all of them or its last sentences, but for one."""
    if not question:
        return False
    for text in (answer, _LABEL.sub("", answer, count=1)):
        own = words(text)
        while len(own) > len(question) and own[: len(question)] == question:  # more than once
            own = own[len(question) :]
        if not own or len(own) > len(question) + 3:
            continue
        allowed = 1 if len(own) < 40 else 2
        if abs(len(own) - len(question)) <= allowed and edit_distance(own, question) <= allowed:
            return True
        if len(own) >= 5 and len(own) < len(question) and edit_distance(own, question[-len(own) :]) <= 1:
            return True
    return False


def _unclosed(text: str) -> bool:
    prose = _FENCES.sub(" ", text)
    if "```" in prose or prose.count("`") % 2:
        return True
    prose = re.sub(r"`[^`]*`|(?m:^\s*\d{1,3}\))|[:;]-?[()]", " ", prose)
    for a, b in ("()", "[]", "{}", "“”", "«»", "„“"):
        if a != b and prose.rfind(a) > prose.rfind(b) and prose.count(a) > prose.count(b):
            return True
    quotes = prose.count('"')
    return bool(quotes % 2 and re.search(r'(?:^|[\s(])"[^"]*$', prose))


def _ends(text: str) -> bool:
    """Whether the last sign that isn't a closing one ends a sentence."""
    return text.rstrip(_CLOSERS)[-1:] in tuple(".!?。！？")


def truncation(answer: str, function_words: set[str]) -> tuple[bool, str | None]:
    """(whether it breaks off; else its last list item, if only other answers can tell)."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFC", answer)).strip()
    try:
        if text[:1] in "{[\"" or len(text) < 40:
            json.loads(text)
            return False, None
    except ValueError:
        pass
    if _unclosed(text):
        return True, None
    lines = [line for line in text.split("\n") if line.strip()]
    for i, line in enumerate(lines):
        if line.rstrip().endswith(":") and (m := _ANNOUNCES.search(line)):
            n = int(m[1]) if m[1].isdigit() else _NUMBER.get(m[1].lower(), 0)
            items = 0
            for follower in lines[i + 1 :]:
                if not _ITEM.match(follower):
                    break
                items += 1
            if n >= 2 and items < n and (items or i == len(lines) - 1):
                return True, None
    last = lines[-1].strip() if lines else ""
    if last.endswith("```"):
        return False, None
    bare = re.sub(r"[^\w\s.,;:!?…\-–()\[\]{}\"'`»”’*/%€$→=<>@#&+]+\s*$", "", last).rstrip()  # signs such as a tick
    if not bare:
        return False, None
    item = _ITEM.match(bare + " ")
    if re.search(r"^[-*•–]$|\s[-–]$|[,;:(\[{/→]$", bare):
        return True, None
    if re.search(r"(?:…|\.\.\.)[\"'»”)]*$", bare):
        return len(words(bare)) > 1, None
    if _ORDINAL.search(bare):
        return True, None
    if _ends(bare):
        return False, None
    if m := _TAIL.search(bare):
        ahead = bare[: m.start()].rstrip()
        if not ahead or _ends(ahead) or item and not item[1].replace(m[0].strip(), "").strip():
            return False, None
        if not re.search(r"[^\W\d_]", ahead):
            return False, None
    own = words(bare)
    stops = bool(own) and own[-1] in function_words
    if item:
        others = [m[1].strip() for line in lines[:-1] if (m := _ITEM.match(line))]
        if stops or others and all(_ends(o) for o in others):
            return True, None
        return False, item[1].strip()
    if len(lines) == 1 and len(own) <= 3:
        return stops and len(own) > 1, None
    if len(lines) == 1 and len(own) <= 6 and not re.search(r"[^\W\d_]{4,}\s+[^\W\d_]{2,}\s+[^\W\d_]{2,}", bare):
        return stops, None
    return True, None


def list_items(answer: str | None) -> list[str]:
    """Items of lists that another item follows."""
    items = [m[1].strip() if (m := _ITEM.match(line)) else None for line in (answer or "").split("\n")]
    return [a for a, b in zip(items, items[1:]) if a and b]


_FUNCTION = {lang: {w for w in text.split() if w not in ("no", "sí", "sì", "ja", "nein", "oui", "non", "yes", "sim", "não")} for lang, text in langwords.WORDS.items()}


def _flags(df: pd.DataFrame, reader: language.Reader) -> pd.DataFrame:
    questions = [question_of(x) for x in df["input"]]
    answers = [a or "" for a in df["final_answer"]]
    empty = [is_empty(a) for a in answers]
    other = [not e and script_differs(q, a) for q, a, e in zip(questions, answers, empty)]
    units: list[list[str]] = []
    spans = []
    for q, a, e, o in zip(questions, answers, empty, other):
        x = len(units)
        if not e and not o and not (_BEYOND.search(a) and script_of(a)[0] != "LATIN"):
            units += [ws for _, ws in language.pieces(q)]
            y = len(units)
            said = " ".join(language.tokens(q))
            units += [ws for _, ws in language.pieces("\n".join(a.split("```")[::2])) if " ".join(ws) not in said]
        else:
            y = x
        spans.append((x, y, len(units)))
    total, _, listed = reader.read(units)
    score = WORD_WEIGHT * listed
    score = score * 2 if reader.model is None else score + total
    rows = []
    for trace_id, q, a, e, o, (x, y, z) in zip(df["trace_id"], questions, answers, empty, other, spans):
        found, tail = [], None
        if e:
            found.append("empty")
        else:
            asked, given = score[x:y].sum(axis=0), score[y:z].sum(axis=0)
            q_lang = langwords.LANGUAGES[int(asked.argmax())] if y > x else None
            a_lang = langwords.LANGUAGES[int(given.argmax())] if z > y else None
            if is_refusal(a):
                found.append("refusal")
            if is_copy(words(q), a):
                found.append("copy")
            cut, tail = truncation(a, _FUNCTION.get(a_lang or q_lang, set()))
            if cut:
                found.append("truncated")
            if not o and q_lang and a_lang and sum(map(len, units[y:z])) >= 4:
                one = (asked + given).max()
                for l in langwords.requested(q):
                    one = max(one, asked.max() + given[langwords.LANGUAGES.index(l)])
                o = asked.max() + given.max() - one > LEAD
            if o:
                found.append("other_language")
        rows.append((trace_id, found, tail, list_items(a)))
    return pd.DataFrame(rows, columns=["trace_id", "defects", "tail", "items"])


def flags(traces: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(trace_id, defects): each trace with all its defects in order; an empty list for a sound one."""
    model = language.fit_on(labelled) if labelled is not None else None
    slim = traces.where("trace_id is not null").select(traces["trace_id"].cast("bigint"), traces["input"].cast("string"), traces["final_answer"].cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = language.Reader(model)
        for df in frames:
            for at in range(0, len(df), 500):
                yield _flags(df.iloc[at : at + 500], reader)

    judged, _ = spill(spread(slim).mapInPandas(run, "trace_id bigint, defects array<string>, tail string, items array<string>"), "pairs")
    followed = judged.select(F.explode("items").alias("item")).distinct()
    head = F.substring(F.col("item"), 1, SHORT)
    # A tail of SHORT characters and more meets the items with its first ones; a shorter one the beginnings of its own length.
    tails = judged.where("tail is not null").select("tail").distinct().join(followed.select(F.col("item").alias("tail")), "tail", "left_anti")
    begun = followed.where("length(item) > 3")
    starts = begun.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("item") - 1, F.lit(SHORT - 1))), lambda i: F.rtrim(F.substring(F.col("item"), F.lit(1), i)))).alias("tail")).distinct()
    brief = tails.where(F.length("tail") < SHORT).join(starts, "tail", "left_semi")
    heads = begun.where(F.length("item") > SHORT).select(head.alias("head"), "item")
    long = tails.where(F.length("tail") >= SHORT).withColumn("head", F.substring("tail", 1, SHORT)).join(heads, "head").where("startswith(item, tail)").select("tail").distinct()
    cut = brief.unionByName(long).withColumn("cut", F.lit(True))
    broken = F.array_contains("defects", "truncated")
    with_tail = judged.join(cut, "tail", "left").withColumn("defects", F.when(F.col("cut") & ~broken, F.array_append("defects", F.lit("truncated"))).otherwise(F.col("defects")))
    every = with_tail.groupBy("trace_id").agg(F.array_distinct(F.flatten(F.collect_list("defects"))).alias("d"))
    return every.select("trace_id", F.filter(F.array(*[F.lit(x) for x in ORDER]), lambda x: F.array_contains(F.col("d"), x)).alias("defects"))


def found(traces: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(trace_id, defect) of each defective trace."""
    return flags(traces, labelled).where("size(defects) > 0").select("trace_id", F.col("defects")[0].alias("defect"))


def report(traces: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Defective traces by task type and defect."""
    kinds = traces.groupBy("trace_id").agg(F.min("task_type").alias("task_type"))
    return found(traces, labelled).join(kinds, "trace_id").groupBy("task_type", "defect").count().withColumnRenamed("count", "n")
